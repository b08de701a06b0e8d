"""HTML walking, section extraction, paragraph merging and tables."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.operators import html as H
from filamento.operators import sections as S
from filamento.operators import tables as TB
from filamento.plans import q_sections


def extract(spark, html, **kw):
    docs = spark.createDataFrame([("d", html)], "doc string, html string")
    b = docs.select("doc", F.posexplode(H.blocks(F.col("html"))).alias("idx", "b")).select("doc", "idx", "b.kind", X.clean_text(F.col("b.text")).alias("text"))
    return {r.section_id: r for r in S.extract(b, **kw).collect()}


BODY = "<p>회사는 여러 제품을 만들고 팝니다.</p><p>매출이 전기보다 크게 늘었습니다.</p>"
ROMAN = "<html><body><p>I. 회사의 개요</p><p>개요 본문이 여기에 있습니다.</p><p>II. 사업의 내용</p>" + BODY + "<p>III. 재무에 관한 사항</p><p>재무 본문이 여기에 있습니다.</p></body></html>"
ARABIC = ROMAN.replace("III.", "3.").replace("II.", "2.").replace("I.", "1.")


def test_numbering_does_not_matter(spark):
    a, b = (extract(spark, h)["S1"] for h in (ROMAN, ARABIC))
    assert a.found and a.text == b.text == "회사는 여러 제품을 만들고 팝니다.\n매출이 전기보다 크게 늘었습니다." and a.end_reason == "재무에 관한 사항"


def test_contents_page_is_not_the_section(spark):
    toc = "<p>I. 회사의 개요</p><p>II. 사업의 내용</p><p>III. 재무에 관한 사항</p>"
    assert extract(spark, ROMAN.replace("<body>", "<body>" + toc))["S1"].text.startswith("회사는")


def test_custom_containers_keep_tables_out(spark):
    html = "<body><section-2><title>II. 사업의 내용</title><table-group><table><tr><td>셀 하나</td></tr></table></table-group><p>본문 문단이 여기 있습니다.</p><section-3><p>둘째 문단도 여기에 있습니다.</p><table><tr><td>셀 둘</td></tr></table></section-3></section-2><p>III. 주주에 관한 사항</p></body>"
    s = extract(spark, html)["S1"]
    assert s.n_tables == 2 and "셀" not in s.text and "둘째" in s.text
    leaked = " ".join(b["text"] for b in H.walk(html, True) if b["kind"] == "text")
    assert "셀" in leaked


def test_subheadings_do_not_end_a_section(spark):
    html = ROMAN.replace("<p>매출이", "<p>2. 재무 등에 관한 사항</p><p>1. 사업의 내용</p><p>매출이")
    s = extract(spark, html)["S1"]
    assert s.found and "매출이" in s.text


def test_without_terminator(spark):
    html = "<body><p>II. 사업의 내용</p>" + BODY + "</body>"
    s = extract(spark, html)["S1"]
    assert not s.found and s.has_body and s.end_reason == "EOF" and s.text
    assert extract(spark, html, require_terminator=False)["S1"].found
    missing = extract(spark, "<body><p>본문</p></body>")
    assert set(missing) == {"S1", "S2", "S3", "S4"} and not missing["S1"].found and missing["S1"].end_reason == "no start header"


def test_every_standard_name_ends_a_section(spark):
    for name in S.STANDARD:
        if name != "사업의 내용":
            assert extract(spark, f"<body><p>II. 사업의 내용</p>{BODY}<p>1. {name}</p></body>")["S1"].end_reason == name


def test_similar_names(spark):
    assert S.best_key("업의내용", 97) == "사업의 내용" and S.best_key("업내용", 97) is None and S.best_key(None, 97) is None
    assert S.indel_ratio("abcd", "abd") == 200 * 3 / 7


def test_walk_handles_broken_markup():
    blocks = H.walk("<div>가<b>나</b><br>다<script>x</script><!-- y --><p>라<table><tr><td>마</table>바")
    assert [(b["kind"], b["text"].split()) for b in blocks] == [("text", ["가", "나"]), ("text", ["다"]), ("text", ["라"]), ("table", ["마"]), ("text", ["바"])]
    assert H.walk("") == [] and H.walk(None) == []


def merge(values, min_chars=10, most=2000):
    """The folding rule, written plainly."""
    out, head = [], []
    punct = set(" ()[]{}<>·ㆍ・,.:;-–—_/\\|~!@#$%^&*+='\"’‘“”\t\n")
    for raw in values:
        p = raw.strip()
        if not p:
            continue
        if len(p) >= min_chars and not set(p) <= punct:
            out.append(" ".join([*head, p]))
            head = []
        elif out and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += " " + p
        elif out:
            out.append(p)
        else:
            head.append(p)
    return out if not head else [" ".join(head)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab(.- ", max_size=14), max_size=8), st.integers(12, 40))
def test_merging_against_a_plain_fold(spark, values, most):
    df = spark.createDataFrame([(values,)], "p array<string>")
    assert df.select(S.merged(F.col("p"), 6, most)).first()[0] == merge(values, 6, most)


def test_merging_of_nothing(spark):
    df = spark.createDataFrame([(None,), ([],), ([""],)], "p array<string>")
    assert [r[0] for r in df.select(S.merged(F.col("p"))).collect()] == [[], [], []]


def test_derived_clean(spark):
    df = spark.createDataFrame([(["◆click◆『a』 삽입", "본문 문단이 충분히 깁니다&cr", "짧다"],)], "p array<string>")
    assert df.select(S.derived_clean(F.col("p"))).first()[0] == ["본문 문단이 충분히 깁니다 짧다"]


def test_grid_spans():
    assert H.grid("<table><tr><td rowspan=3>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d<table><tr><td>n</td></tr></table></td></tr></table>") == [["a", "b", "b"], ["a", "c", "d n"]]
    assert H.grid("") == [] and H.grid("<table></table>") == []


def test_layout_and_nested_tables(spark):
    wide, plain = "<table><tr><td>" + "x" * 250 + "</td></tr></table>", "<table>" + "<tr><td>a</td><td>b</td></tr>" * 4 + "</table>"
    df = spark.createDataFrame([(1, wide), (2, plain), (3, "<table><tr><td><table></table></td></tr></table>"), (4, None)], "i int, h string")
    got = {r.i: (r.l, r.n) for r in df.select("i", H.is_layout(H.grids("h")).alias("l"), H.nested_table("h").alias("n")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (False, None)}


OFFICERS = "<table><tr><th rowspan=2>성명</th><th rowspan=2>직위</th><th rowspan=2>등기임원여부</th><th rowspan=2>담당업무</th><th colspan=2>소유주식수</th><th rowspan=2>재직기간</th></tr><tr><th>의결권있는 주식</th><th>의결권없는 주식</th></tr><tr><td>가나다</td><td>대표이사</td><td>등기임원</td><td>총괄</td><td>1</td><td>-</td><td>3년 2개월</td></tr><tr><td>라마바</td><td>상무</td><td>미등기</td><td>생산</td><td>-</td><td>-</td><td>12개월</td></tr><tr><td>합계</td></tr></table>"


def test_officers(spark):
    employees = "<table><tr><td>성명</td><td>직위</td><td>재직기간</td><td>직원수</td></tr><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table>"
    df = spark.createDataFrame([(1, OFFICERS), (1, OFFICERS), (2, employees), (3, None), (4, "")], "doc int, h string")
    rows = {(r.doc, r.name): (r.is_registered, r.tenure_months) for r in TB.officer_rows(df, "doc", "h").collect()}
    assert rows == {(1, "가나다"): (True, 38.0), (1, "라마바"): (False, 12.0)}


def test_lawsuits(spark):
    law = "<table><tr><th>사건번호</th><th>원고</th><th>소송가액(억원)</th><th>진행상황</th></tr><tr><td>1</td><td>가</td><td>50,488</td><td>1심</td></tr><tr><td>사건번호</td><td>원고</td><td>소송가액(억원)</td><td>진행상황</td></tr><tr><td>해당사항 없음</td><td></td><td></td><td></td></tr></table>"
    df = spark.createDataFrame([(1, 0, law), (2, 0, "<table><tr><td>해당사항 없음</td></tr></table>"), (3, 0, "<table><tr><td>과징금 부과</td></tr></table>"), (4, 0, None)], "doc int, table_index int, h string")
    c = TB.lawsuit_tables(df, "doc", "h")
    assert [r.amount_krw for r in TB.lawsuit_rows(c, "doc").collect()] == [5048800000000.0]
    got = {r.doc: (r.n_lawsuit_tables, r.n_sanction_tables, r.n_lawsuit_rows, r.explicit_none) for r in TB.lawsuit_summary(c, "doc").collect()}
    assert got == {1: (1, 0, 1, False), 2: (0, 0, 0, True), 3: (0, 1, 0, False)}


def test_officer_and_lawsuit_queries_read_every_table(spark, tmp_path):
    law = "<table><tr><th>사건번호</th><th>원고</th><th>소송가액(억원)</th><th>진행상황</th></tr><tr><td>2023가합7</td><td>다</td><td>3</td><td>1심</td></tr></table>"
    rows = [(7, [OFFICERS.replace("가나다", "아자차"), None]), (8, [law]), (9, None)]
    spark.createDataFrame(rows, "section_key bigint, tables_html array<string>").write.parquet(str(tmp_path / "section_contents.parquet"))
    spark.createDataFrame([(5, "Supplier#5")], "s_suppkey bigint, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(60, "Customer#60", 12.7), (61, "Customer#61", -3.0)], "c_custkey bigint, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    names = {r.name for r in q_sections.d13(spark, str(tmp_path)).collect()}
    assert names == {"아자차", "라마바", "Supplier#5"}
    cases = {(r.case_no, r.amount_krw) for r in q_sections.d16(spark, str(tmp_path)).collect()}
    assert cases == {("2023가합7", 300000000.0), ("2020가합60", 12000.0), ("2020가합61", 300000000.0)}


def test_tables_of_odd_shapes(spark):
    ragged = "<table><tr><td>성명<td>직위<td>재직기간<tr><td>가(주1)<td>상무<tr><td>합계<tr></table>"
    renamed = "<table><tr><th>임원명</th><th>직위</th><th>재직기간</th></tr><tr><td>나</td><td>이사</td><td>2년</td></tr></table>"
    df = spark.createDataFrame([(1, ragged), (2, renamed), (3, "<p>글</p>"), (4, None), (5, "")], "doc int, h string")
    assert {(r.doc, r.name, r.tenure_months) for r in TB.officer_rows(df, "doc", "h").collect()} == {(1, "가", None)}
    own = {**TB.OFFICER_COLUMNS, "name": ("임원명",)}
    assert {(r.doc, r.name, r.tenure_months) for r in TB.officer_rows(df, "doc", "h", own).collect()} == {(2, "나", 24.0)}
    law = df.where("doc = 3").selectExpr("doc", "0 as table_index", "'<table><tr><td>원고</td><td>피고</td></tr><tr><td>a</td><td>b</td></tr></table>' as h", "'소송 현황' as c")
    assert [r.i.is_lawsuit for r in TB.lawsuit_tables(law, "doc", "h").select(F.col("info").alias("i")).collect()] == [False]
    assert [(r.i.is_lawsuit, r.i.rows[0].defendant) for r in TB.lawsuit_tables(law, "doc", "h", "c").select(F.col("info").alias("i")).collect()] == [(True, "b")]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="가A1 \u3000\u00a0\u200b&cr;◆click『』(주)※*\n\t", max_size=30))
def test_clean_text_is_the_same_in_python(spark, value):
    got = spark.createDataFrame([(value,)], "s string").select(X.clean_text(F.col("s"))).first()[0]
    assert X.plain_clean(value) == got
