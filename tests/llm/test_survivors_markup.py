"""Surviving records, markup residue and clean text."""

import itertools
import random

import pytest

pytest.importorskip("filamento.llm")

from filamento.llm import marks, markup, survivors  # noqa: E402
from filamento.llm.cart import Tree  # noqa: E402

F = "corp_code string, stock_code string, corp_name string, market string, fy int, rcept_no string, report_nm string, rcept_dt string, rcept_time string, is_correction boolean, orig_rcept_no string, flr_nm string, period_month int, collected_at timestamp, trust string"


def row(no, name, corp="00000001", stock="000001", fy=2020, dt=None, flag=None, month=12):
    return (corp, stock, None, None, fy, no, name, dt, None, flag, None, None, month, None, "extra")


def survive(spark, rows):
    return {(r.corp_code, r.fy): r.rcept_no for r in survivors.survivors(spark.createDataFrame(rows, F)).collect()}


def test_survivors(spark):
    rows = [row("20210401000002", "[기재정정]사업보고서 (2020.12)"), row("20210320000001", "［첨부추가］사업보고서（2020.12）", corp=None), row("20210401000002", None)]
    assert survive(spark, rows) == {("00000001", 2020): "20210320000001"}
    rows += [row("20210501000009", "사업보고서 (2020/12)", corp="1 ", fy=None)]
    assert survive(spark, rows) == {("00000001", 2020): "20210501000009"}
    other = [row("20210801000001", "반기보고서 (2020.06)", month=6), row("20210801000002", "사업보고서제출기한연장신고서 (2020.12)")]
    assert survive(spark, rows[:1] + other) == {}
    assert survive(spark, rows[:1] * 2) == {("00000001", 2020): "20210401000002"}
    assert survive(spark, []) == {}


def test_flag_and_days(spark):
    rows = [row("20210310000001", None, flag=True), row("20210320000001", None, dt="2021/03/09"), row("20210315000001", None)]
    assert survive(spark, rows) == {("00000001", 2020): "20210320000001"}
    assert survive(spark, [row("20210310000001", "사업보고서 (2020.12)", flag=True), row("20210311000001", "[기재정정]사업보고서 (2020.12)", flag=False)]) == {("00000001", 2020): "20210310000001"}
    assert survive(spark, [row(None, "사업보고서 (2020.12)"), row("2", "사업보고서", corp=None, stock=None), row("3", "사업보고서", fy=None)]) == {}


def test_the_order_of_filings_beats_any_number_of_rows(spark):
    early, late = row("20200301000001", "사업보고서 (2019.12)", stock="000001", fy=2019, dt="20200301"), row("20200401000001", "사업보고서 (2019.12)", stock="000002", fy=2019, dt="20200401")
    got = survivors.survivors(spark.createDataFrame([early, *[late] * 5], F)).collect()
    assert [(r.rcept_no, r.stock_code, r.n) for r in got] == [("20200301000001", "000001", 6)]


def test_fields_come_in_whole_bundles(spark):
    names = F.split(", ")
    make = lambda no, **more: tuple({"corp_code": "1", "fy": 2019, "rcept_no": no, "report_nm": "사업보고서 (2019.12)", **more}.get(n.split()[0]) for n in names)
    rows = [make("20200301000001", rcept_time=" "), make("20200301000001", flr_nm="갑", rcept_time="09:00"), make("20200402000001", report_nm="[기재정정]사업보고서 (2019.12)", stock_code="7", corp_name="갑", market="KOSPI", period_month=12)]
    rows += [make("20200403000001", stock_code="8", corp_name="을"), make("20200404000001", stock_code="8", corp_name="을")]
    (got,) = survivors.survivors(spark.createDataFrame(rows, F)).collect()
    assert (got.rcept_no, got.rcept_dt, got.rcept_time, got.flr_nm, got.is_correction, got.corrected) == ("20200301000001", "20200301", "09:00", "갑", False, True)
    # the firm told in full beats the one told more often, and its name and market are its own
    assert (got.stock_code, got.corp_name, got.market, got.period_month, got.n) == ("000007", "갑", "KOSPI", 12, 5)


def test_branch_and_bound_against_all_choices():
    rnd = random.Random(4)
    total = lambda cs: tuple(sum(c["trust"][level] for c in cs) for level in (0, 1))
    for _ in range(200):
        bundles = []
        for b in range(rnd.randint(1, 3)):
            c = [{"id": f"{b}{i}", "trust": (float(rnd.randint(0, 2)), float(rnd.randint(0, 9))), "tie": f"{i}", "firm": rnd.choice([None, "x", "y"]), "month": rnd.choice([None, 6, 12])} for i in range(rnd.randint(1, 5))]
            bundles.append(sorted(c, key=lambda x: (-x["trust"][0], -x["trust"][1], x["tie"])))
        ok = lambda cs: all(a[f] is None or b[f] is None or a[f] == b[f] for a, b in itertools.combinations(cs, 2) for f in ("firm", "month"))
        fits = [cs for cs in itertools.product(*bundles) if ok(cs)]
        got = survivors.choose(bundles)
        assert (got is None) == (not fits)
        if fits:
            assert ok(got) and total(got) == max(map(total, fits))


RESIDUE = ["<b>굵게</b> 본문", "본문&nbsp;", "본문&cr 끝", "**굵게** 본문", "# 제목", "== 제목 ==", "[[문서|이름]] 본문", "'''굵게''' 본문", "\\textbf{가} 본문", "$\\frac{a}{b}$ 본문", "`코드` 본문", "~~취소~~ 본문", "![그림](a.png)", "<!-- 주석 -->", "본문</p>", "{| class=\"wikitable\"", "| a | b |"]
CONTENT = ["R&D 조직입니다.", "R&D; 생산; 판매", "3 < x 이고 y > 5", "US$ 22에서 US$ 341", "A*에서 B*로", "#2 라인", "[단위 : 백만원]", "<표 3>의 금액", "<ESG 사업> 요약", "- 항목", "1. 항목", "{{corp_name}}의 매출", "${unit} 기준", "<%= ceo %>", "[[대표자을(를) 여기에 기재]]", "____년 __월", "도면 가_3_B", "{주석 3} 참조", "Q&A 자료", "", "'404 Not Found' 화면"]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert markup.residue(text) and markup.residue("회사는 제품을 팝니다.\n" + text)


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_not_residue(text):
    assert not markup.residue(text)


def test_html_is_resolved_once():
    assert not markup.residue(marks.visible("<p>R&amp;D &lt; 3%<br><!-- x --><style>b{}</style></p>"))
    assert markup.residue(marks.visible("<p>&lt;b&gt;굵게</p>")) and markup.residue(marks.visible("<p>a&amp;nbsp;b</p>"))


def test_clean_text_keeps_structure():
    html = "<h2>제목</h2><p>가<br>나</p><ul><li>하나<li>둘</ul><table><tr><td>1</td><th>2&nbsp;</th></tr></table><pre>x = 1\n y</pre>"
    assert markup.from_html(html).split("\n") == ["## 제목", "가", "나", "- 하나", "- 둘", "1 | 2", "```", "x = 1", " y", "```"]
    text = "== 제목 ==\n**가** [[나|다]] $\\frac{a}{b}$ `코드` {{corp_name}}\n{|\n|-\n! x !! y\n|-\n| 1 || 2\n|}\n```\na = 1\n```"
    out = markup.from_text(text)
    assert out.startswith("## 제목\n가 다 $\\frac{a}{b}$ 코드 {{corp_name}}") and "x | y" in out and "```\na = 1\n```" in out
    assert markup.from_text("") == "" and markup.from_html("") == ""


def test_clean_text_of_latex_and_nested_tables():
    tex = "\\section{개요} 본문\n\\begin{equation}\na = b\n\\end{equation}\n\\begin{verbatim}\nx_1 = 2\n\\end{verbatim}\n\\begin{itemize}\n\\item 하나\n\\end{itemize}\n\\begin{tabular}{ll}\n가 & 나 \\\\\n다 & 라\n\\end{tabular}"
    out = markup.from_text(tex)
    assert "# 개요\n" in out and "$$a = b$$" in out and "```\nx_1 = 2\n```" in out and "- 하나" in out and "가 | 나" in out and "다 | 라" in out and "\\" not in out
    html = "<table><tr><td>가</td><td>나<table><tr><td>안</td><td>쪽</td></tr><tr><td>둘째</td></tr></table></td><td>다</td></tr><tr><td>라</td></tr></table>"
    assert markup.from_html(html).split("\n") == ["가 | 나; 안 쪽; 둘째 | 다", "라"]


def test_the_tree_shapes_clean_text(monkeypatch):
    nav = '<p><a href="/">처음</a> <a href="/b">목록</a> <a href="/c">다음</a></p>'
    body = '<p>회사는 새 공장을 지어 <a href="/d">생산 능력</a>을 늘렸습니다.</p><p>A등급은 A*에서 B*로 바뀌었습니다.</p>'
    kept = "회사는 새 공장을 지어 생산 능력을 늘렸습니다.\nA등급은 A*에서 B*로 바뀌었습니다."
    assert markup.from_html(nav + body) == kept
    assert markup.from_text("A등급은 A*에서 B*로\n당기 **매출**") == "A등급은 A*에서 B*로\n당기 매출"

    class Content:
        @staticmethod
        def label(row):
            return "content"

    monkeypatch.setattr(markup, "TREE", Content)
    assert markup.from_html(nav + body) != kept and not markup.residue("당기 **매출**")


def test_markup_over_tables(spark):
    rows = [(1, "**가**", ["<p>&lt;b&gt;</p>", None], "x"), (1, "**가**", ["<p>&lt;b&gt;</p>", None], "x"), (2, None, None, None), (3, "", [], ""), (None, "**", None, None), (4, "가" * 200000, ["<td>"], None)]
    df = spark.createDataFrame(rows, "k bigint, t string, h array<string>, field string")
    assert {(r.field, r.rec_id) for r in markup.found(df, "k", "t", False, "text").unionByName(markup.found(df, "k", "h", True, "h")).distinct().collect()} == {("text", 1), ("h", 1)}
    got = {(r.rec_id, r.part): r.clean_text for r in markup.clean(df.where("k is not null"), "k", "h", True, "h").distinct().collect()}
    assert got == {(1, 1): "", (1, 2): None, (4, 1): ""}


def test_tree():
    import numpy as np

    x = np.array([[0, 1], [0, 2], [1, 1], [1, 2], [1, 3]])
    y = ["a", "b", "c", "c", "b"]
    t = Tree().fit(x, np.array(y))
    assert [t.label(r) for r in x] == y and Tree(max_depth=0).fit(x, np.array(y)).label(x[0]) == "b"
