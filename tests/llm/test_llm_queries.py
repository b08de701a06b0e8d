"""The subpackage's queries run on the smallest tables; those with SQL give the same rows."""

from pathlib import Path

import pytest

pytest.importorskip("filamento.llm")
duckdb = pytest.importorskip("duckdb")

from filamento.llm import queries as book  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
COLUMNS = {
    "p1_found": ["corp_code", "fy", "rcept_no"],
    "p4_found": ["section_key_a", "section_key_b"],
    "p5_found": ["field", "rec_id"],
    "p6_found": ["section_key", "para_no"],
    "p7_found": ["section_key"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(book.queries()))
def test_query(spark, name):
    df = book.queries()[name](spark, str(DATA))
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows) and None not in {v for r in rows for v in r}
    if name in book.oracle_sql():
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cursor = c.execute(book.oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert {tuple(r[n] for n in names) for r in rows} == set(cursor.fetchall())


def test_residue_of_unflagged_sections_counts(spark, tmp_path):
    seed = "Please enable JavaScript in your browser to continue."
    near = "Please enable JvaScript in your browser to continue"
    prose = ["회사는 새 공장을 지어 생산 능력을 늘렸습니다.", "매출이 전기보다 크게 늘어 이익도 함께 늘었습니다."] * 4
    rows = [(1, [*prose, seed], None), (2, ["합계", "1,234", "- 황산", near], None), (3, ["합계", "1,234", "- 황산"], None)]
    spark.createDataFrame(rows, "section_key bigint, paragraphs array<string>, text string").write.parquet(str(tmp_path / "section_contents.parquet"))
    q = book.queries()
    residue = {r.section_key for r in q["p6_found"](spark, str(tmp_path)).collect()}
    flagged = {r.section_key for r in book.prose.not_prose(spark.read.parquet(str(tmp_path / "section_contents.parquet")), "section_key", "paragraphs").collect()}
    assert 2 in residue and {2, 3} <= flagged and 1 not in flagged
    assert {r.section_key for r in q["p7_found"](spark, str(tmp_path)).collect()} == {3}
