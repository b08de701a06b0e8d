"""Queries over all rows, whatever characters they hold, against plain Python."""

import itertools
import re

import pytest

from filamento.operators import sections as S
from filamento.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
BODY = ["회사는 「상법」에 따라 설립된 ‘법인’입니다·", "매출은\n늘었습니다 ① ② ％", "보통 문단입니다"]
LONG = "당사는 「자본시장법」 제１２조에 따라 공시하며 매출액은 {}백만원·영업이익은 １２３백만원으로 “증가”하였습니다"
COLUMNS = "section_key bigint, rcept_no string, corp_code string, fy int, section_id string, start_header string, paragraphs array<string>, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    rows = [(1, "d1", "1", 2020, "s0", "Ⅰ. 회사의 개요", ["개요 본문입니다"], "가나다"), (2, "d1", "1", 2020, "s1", "Ⅱ. 사업의 내용", BODY, "나라"), (3, "d1", "1", 2020, "s2", "Ⅲ. 재무에 관한 사항", ["재무 본문", None], "다라")]
    for k, corp in enumerate(("11", "12", "13")):
        rows += [(10 + 2 * k, f"e{k}", corp, 2020, "s3", None, ["작년 문단으로 서른 글자를 넘도록 길게 적은 「보통」 문단입니다 그리고 더"], "가나다라 2020"), (11 + 2 * k, f"f{k}", corp, 2021, "s3", None, [LONG.format(k * 111), "삼십 자 미만·"], f"마바사아 2020{'자' * k}")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(d / "section_contents.parquet"))
    spark.createDataFrame([(1, "가 나　다"), (2, "a b"), (3, "하나")], "doc_id bigint, text string").write.parquet(str(d / "documents.parquet"))
    return str(d)


def rows(spark, folder, name):
    assert name not in SQL
    return QUERIES[name](spark, folder).collect()


def test_sections_hold_every_block(spark, folder):
    got = {r.section_id: r for r in rows(spark, folder, "d07_extracted_sections_whole") if r.doc == "d1"}
    assert got["S1"].found and got["S1"].end_reason == "재무에 관한 사항"
    head = {(r.name, r.style) for r in rows(spark, folder, "d04_header_candidates_whole")}
    assert head == {("회사의 개요", "roman"), ("사업의 내용", "roman"), ("재무에 관한 사항", "roman")}
    spans = {r.name: (r.start, r.end) for r in rows(spark, folder, "d05_section_spans_whole")}
    assert spans == {"회사의 개요": (0, 2), "사업의 내용": (2, 6), "재무에 관한 사항": (6, 8)}
    chars = {r.name: (r.n_blocks, r.chars) for r in rows(spark, folder, "d06_collected_span_whole")}
    assert chars["사업의 내용"] == (3, sum(map(len, BODY)))
    assert {r.name for r in rows(spark, folder, "d03_section_name_exact_whole")} >= {"회사의 개요", "사업의 내용"}
    old = {(r.doc, r.section_id): r for r in rows(spark, folder, "d08_extracted_sections_old")}
    assert old["d1", "S1"].chars == sum(map(len, BODY))
    audit = {(r.variant, r.section_id): r.found for r in rows(spark, folder, "d22_variant_audit") if r.doc == "d1"}
    assert audit["new", "S1"] and audit["old", "S1"] and set(S.TARGETS) == {s for v, s in audit if v == "new"}


def mask(p):
    return re.sub(r"\d[\d,.]*", "<NUM>", p)


def test_paragraph_changes_hold_every_paragraph(spark, folder):
    want = {(f"{c:08d}", "S3", 2021, mask(LONG.format(k * 111))) for k, c in enumerate((11, 12, 13))}
    assert {tuple(r) for r in rows(spark, folder, "m06_set_changes_whole")} == want
    assert len(rows(spark, folder, "m06_set_removals_whole")) == 3
    pairs = {(r.a_entity, r.b_entity, r.similarity) for r in rows(spark, folder, "m07_near_duplicate_pairs_whole")}
    assert pairs == {(a[0], b[0], 1.0) for a, b in itertools.combinations(sorted(want), 2)}
    assert [(r.n_pairs, r.n_corps) for r in rows(spark, folder, "m09_common_paragraphs_whole")] == [(3, 3)]
    assert [(r.n_pairs, r.n_clean, r.reduction) for r in rows(spark, folder, "m10_recounted_pairs_whole")] == [(3, 3, 0.0)]
    assert [tuple(r) for r in rows(spark, folder, "m11_pair_taxonomy_whole")] == [("S3", "law", 3)]
    assert {r.n_partners for r in rows(spark, folder, "m12_partner_counts_whole")} == {2}
    assert [tuple(r) for r in rows(spark, folder, "j09_cross_group_pairs_whole")] == [(2021, 3)]


def test_texts_hold_every_character(spark, folder):
    assert {r.doc_id: r.n_words for r in rows(spark, folder, "t07_words_whole")} == {1: 3, 2: 2, 3: 1}
    masked = {(r.p, r.masked) for r in rows(spark, folder, "t09_mask_numbers_whole")}
    assert all(m == mask(p) for p, m in masked) and (LONG.format(111), mask(LONG.format(111))) in masked


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_levenshtein_of_whole_texts(spark, folder):
    got = {r.corp: r.sim for r in rows(spark, folder, "m03_levenshtein_whole")}
    for k, c in enumerate((11, 12, 13)):
        a, b = "가나다라 2020", f"마바사아 2020{'자' * k}"
        assert got[f"{c:08d}"] == pytest.approx(1 - distance(a, b) / max(len(a), len(b)), abs=1e-6) and got[f"{c:08d}"] < 0.6


def test_misspelt_filers_meet_their_listing(spark, tmp_path):
    filers, listed = ["주식회사 한빛에너지솔루션홀딩스", "한빛에너지솔류션홀딩스제일", "무관한 이름", None], ["한빛에너지솔루션홀딩스", "한빛에너지솔루션홀딩스제일", "다른 상장사", None]
    spark.createDataFrame([(n,) for n in filers], "corp_name string").write.parquet(str(tmp_path / "filings_index.parquet"))
    spark.createDataFrame([(n,) for n in listed], "name string").write.parquet(str(tmp_path / "universe.parquet"))
    got = {(r.name, r.choice, r.match_type) for r in rows(spark, str(tmp_path), "m15_matched_names")}
    assert got == {(filers[0], listed[0], "exact"), (filers[1], listed[1], "fuzzy")}
