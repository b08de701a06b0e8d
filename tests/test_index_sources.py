"""Index selection, universe look-ups, archives, files, sinks, quota and queries without the subpackage."""

import datetime as dt
import io
import json
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filamento.operators import index as I
from filamento.operators import quality as Q
from filamento.plans import runtime
from filamento.plans.runtime import hot_keys, key_counts, salted_join
from filamento.sources import archive as A
from filamento.sources import config, files, remote, reports
from filamento.sources import sinks as K

D = lambda s: dt.date.fromisoformat(s)


def test_annual_rows_and_pick(spark):
    rows = [("1", "사업보고서 (2024.12)", "20250320", "A"), ("2", "[기재정정]사업보고서 (2024.12)", "20250301", "A"), ("3", "[첨부추가]사업보고서 (2024.12)", "20250301", "A"), ("4", "사업보고서제출기한연장신고서 (2024.12)", "20250301", "A"), ("5", "반기보고서 (2024.06)", "x", "A"), ("6", "사업보고서 (2024.03)", None, "B"), ("7", None, "x", "A")]
    df = spark.createDataFrame(rows, "no string, report_nm string, dt string, corp string")
    assert {r.no for r in I.annual_rows(df).collect()} == {"1", "2", "3", "6"}
    assert {r.no for r in I.annual_rows(df, (2024, 2024), True).collect()} == {"1", "2", "3"}
    got = {r.corp: (r.no, r.is_correction, r.is_correction_exists) for r in I.pick_original(I.annual_rows(df), ["corp"], "report_nm", "dt", "no").collect()}
    assert got == {"A": ("1", False, True), "B": ("6", False, False)}
    only = I.pick_original(I.annual_rows(df).where("no in ('2', '3')"), ["corp"], "report_nm", "dt", "no").first()
    assert only.no == "3"


def test_listed_at(spark):
    spans = spark.createDataFrame([("111111", D("2010-01-01"), D("2018-01-01")), ("222222", D("2010-01-01"), D("2023-01-01")), ("333333", D("2022-01-01"), D("2024-01-01")), ("444444", None, None), (None, None, None)], "c string, l date, x date")
    at = spark.createDataFrame([(D("2016-12-29"),), (D("2020-12-30"),), (None,)], "at date")
    got = {(str(r.at), r.c) for r in I.listed_at(at, spans, at="at", code="c", listed="l", delisted="x").collect()}
    assert got == {("2016-12-29", "111111"), ("2016-12-29", "222222"), ("2016-12-29", "444444"), ("2020-12-30", "222222"), ("2020-12-30", "444444")}


def test_previous_years(spark):
    df = spark.createDataFrame([("A", 2015), ("A", 2017), ("B", 2016), (None, 2016), ("A", 2017)], "c string, y int")
    assert {(r.c, r.y) for r in I.missing_previous(df, "c", "y").collect()} == {("A", 2016), ("B", 2015)}


def test_salted_join_keeps_every_row(spark):
    big = spark.range(2000).select(F.when(F.col("id") < 900, 1).when(F.col("id") < 950, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(1, "a"), (1, "b"), (960, "c")], "k bigint, w string")
    assert {r.k for r in hot_keys(key_counts(big, ["k"]), ["k"]).collect()} == {1}
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(small, ["k"], how).collect()))
        assert sorted(map(str, salted_join(big, small, ["k"], how).collect())) == want
    assert salted_join(big.limit(0), small, ["k"]).isEmpty()


def archive(*members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return b.getvalue()


def test_body_choice_and_failures(spark):
    big, body = "x" * 9000, "II. 사업의 내용"
    rows = [(1, archive(("감사보고서.html", big), ("본문.html", body))), (2, archive(("a.html", big), ("b.xml", body))), (3, archive(("a.txt", "x"))), (4, b"no zip"), (5, None), (6, archive(("첨부.html", "only")))]
    got = {r.i: (r.b.member, bool(r.b.error)) for r in spark.createDataFrame(rows, "i int, z binary").select("i", A.body_of("z").alias("b")).collect()}
    assert got == {1: ("본문.html", False), 2: ("b.xml", False), 3: (None, True), 4: (None, True), 5: (None, True), 6: ("첨부.html", False)}


def test_decoding():
    text = "한글 문서 본문입니다. " * 50
    wrong = b'<?xml encoding="utf-8"?>' + text.encode("cp949")
    assert A.decode(wrong).endswith(text)
    broken = bytearray(wrong)
    broken[300:302] = b"\xff\xff"
    assert A.decode(bytes(broken)).count("�") <= 4
    assert A.decode(text.encode("utf-16")) .endswith(text) and A.decode(b"") == ""


def test_firm_codes(spark):
    xml = "<r><list><corp_code>00000001</corp_code><corp_name>a</corp_name><stock_code>005930</stock_code></list><list><corp_code>2</corp_code><stock_code> </stock_code></list></r>"
    got = {(r.corp_code, r.is_listed) for r in A.firm_codes(spark.createDataFrame([(archive(("C.xml", xml)),), (None,)], "z binary"), "z").collect()}
    assert got == {("00000001", True), ("2", False)}


def test_files(spark, tmp_path):
    (tmp_path / "groups_2020.csv").write_text("code,name\n005930,가\n,나\n", encoding="utf-8")
    df = files.read_snapshots(spark, f"file://{tmp_path}/groups_*.csv", "code string, name string", ["code", "name"])
    assert [tuple(r) for r in df.collect()] == [("005930", "가", 2020)]
    with pytest.raises(files.MissingColumns):
        files.read_snapshots(spark, "x", "code string", ["name"])
    with pytest.raises(files.MissingData):
        files.read_snapshots(spark, f"file://{tmp_path}/none_*.csv", "code string", ["code"])
    assert files.read_snapshots(spark, f"file://{tmp_path}/none_*.csv", "code string", ["code"], require=False).columns == ["code", "year"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "00126380_2020_S1.txt").write_text("가\n나", encoding="utf-8")
    (tmp_path / "t" / "other.txt").write_text("x")
    assert [tuple(r) for r in files.read_keyed_texts(spark, f"file://{tmp_path}/t").collect()] == [("00126380", 2020, "S1", "가\n나")]


def test_files_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("00126380_2020_S1.txt", "가\n나"), ("00126380_2021_S2.txt", ""), ("note.txt", "x")], "name string, text string")
    for _ in range(2):  # a second run replaces the files
        assert {(r.name, r.n_bytes) for r in K.write_files(rows, f"file://{tmp_path}/out", "name", "text").collect()} == {("00126380_2020_S1.txt", 7), ("00126380_2021_S2.txt", 0), ("note.txt", 1)}
    assert {tuple(r) for r in files.read_keyed_texts(spark, f"file://{tmp_path}/out").collect()} == {("00126380", 2020, "S1", "가\n나"), ("00126380", 2021, "S2", "")}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["00126380_2020_S1.txt", "00126380_2021_S2.txt", "note.txt"]
    for bad in ((None, "x"), ("a/b", "x"), ("a", None)):
        with pytest.raises(Exception, match="no file can be written"):
            K.write_files(spark.createDataFrame([bad], "name string, text string"), f"file://{tmp_path}/bad", "name", "text")


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1234, 0.5), (None, None, 2.0)], "name string, n int, v double").coalesce(1)
    assert reports.markdown(df, "T") == "## T\n\n| name | n | v |\n|---|---:|---:|\n| a\\|b | 1,234 | 0.5 |\n|  |  | 2 |\n"
    assert reports.markdown(df.limit(0)).count("\n") == 2
    with pytest.raises(reports.TooManyRows):
        reports.markdown(df, most=1)
    lines = spark.createDataFrame([(2015, 1.0, "x"), (2016, 3.0, "x"), (2015, 2.0, "<y>"), (2016, None, "x")], "y int, v double, s string")
    svg = reports.line_svg(lines, "y", "v", "s")
    assert svg.count("<polyline") == 2 and "&lt;y&gt;" in svg and "40,280 600,40" in svg and "<svg" in reports.line_svg(lines.limit(0), "y", "v")
    page = reports.review_page(df.selectExpr("'k<1' as k", "name").limit(1), "k", ["name"])
    assert page.count("<article") == 1 and "k&lt;1" in page and "review.json" in page
    assert reports.review_answers('{"rows": [{"key": "a", "verdict": "right"}, {"key": "b", "verdict": null}, {"key": "c", "verdict": "wrong"}]}') == {"a": True, "b": None, "c": False}


def test_written_tables_can_be_dropped(spark):
    runtime.drop_written(spark)
    written = runtime.materialize(spark.range(3), "drop")
    assert written.count() == 3 and runtime.drop_written(spark) == 1 and runtime.drop_written(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST"):
        written.count()


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_upsert_cache_and_failures(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", None), (None, "n", None)], "k int, v string, w string")
    assert {(r.k, r.v) for r in K.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d"), (None, "n")}
    assert {(r.k, r.v) for r in K.upsert(old, new, ["k"], keep="first").collect()} == {(1, "a"), (2, "b"), (3, "d"), (None, "n")}
    made = []
    make = lambda: made.append(1) or old
    path = f"file://{tmp_path}/cache"
    for mark, times in (("m", 1), ("m", 1), ("other", 2)):
        assert K.cached(spark, path, mark, make).count() == 3 and len(made) == times
    good, bad = K.split_failures(new.withColumn("e", F.when(F.col("k") == 2, "ValueError: broken")), "e", "stage", "k")
    assert good.count() == 2 and [(r.key, r.reason) for r in bad.collect()] == [("2", "ValueError")]


def test_quota_and_config(tmp_path, spark):
    q = remote.DailyQuota(tmp_path / "q.json", 3)
    assert q.consume(2, "2025-01-01") == 1 and remote.DailyQuota(tmp_path / "q.json", 3).used("2025-01-01") == 2
    with pytest.raises(remote.QuotaExceeded):
        q.consume(2, "2025-01-01")
    assert q.consume(3, "2025-01-02") == 0 and json.loads((tmp_path / "q.json").read_text())["2025-01-01"] == 2
    (tmp_path / "c.yaml").write_text(json.dumps({"paths": {"out": "o"}, "sections": {"S2": {"name": "b"}, "S1": {"name": "a", "aliases": ["a", "aa"]}}}))
    c = config.load_config(tmp_path / "c.yaml")
    assert c.section_ids == ["S1", "S2"] and c.folder("out").is_dir() and c.sections(spark).count() == 3


def test_aggregates(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", None), (None, 9.0), ("h", 2.0)], "k string, v double")
    assert {(r.k, r.n, r.mean) for r in Q.describe(df, ["k"], "v").collect()} == {("g", 2, 2.0), ("h", 1, 2.0)}
    assert {(r.k, r.sd) for r in Q.cross_section(df, ["k"], "v").where("k = 'h'").collect()} == {("h", None)}
    paras = spark.createDataFrame([(1, "x" * n) for n in (10, 20, 30)] + [(2, "x" * n) for n in (5, 9, 40)] + [(3, None)], "d int, p string")
    got = {r.d: (r.median, r.n_under_10) for r in Q.paragraph_length_stats(paras, ["d"], "p").collect()}
    assert got == {1: (20.0, 0), 2: (9.0, 2)}
    verdicts = {r.metric: r.verdict for r in Q.gate(spark.createDataFrame([(0.9, None, 5.0)], "a double, b double, c double"), {"a": (">=", 0.85), "b": (">=", 1), "c": ("<=", 4)}).collect()}
    assert verdicts == {"a": "PASS", "b": "undecided", "c": "FAIL"}


def test_snapshot_needs_a_source_of_market_values(spark):
    listed = spark.createDataFrame([("1", "가"), ("2", "나은행"), ("3", "다스팩"), (None, "x"), ("1", None)], "code string, name string")
    caps = spark.createDataFrame([("1", 5.0), ("2", 7.0), ("4", 3.0), ("3", 1.0)], "code string, cap double")
    bank = spark.createDataFrame([("2",), ("2",), (None,)], "code string")
    opts = {"code": "code", "name": "name", "value": "cap", "patterns": ("스팩",)}
    got = {r.code: r.excluded_reason for r in I.snapshot(listed, caps, bank, method="file", **opts).collect()}
    assert got == {"1": None, "2": "sector", "3": "name", "4": None}
    with pytest.raises(remote.MarketCapSourceUnavailable):
        I.snapshot(listed, caps, bank, method=None, **opts)


def test_core_never_imports_the_subpackage():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['filamento.llm'] = None\nimport __spark_entry__ as e\nassert 'p2_found' in e.queries() and 'p1_found' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for f in (root / "filamento").rglob("*.py"):
        if "llm" not in f.parts:
            assert "filamento.llm" not in f.read_text()
