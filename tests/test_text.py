"""Text functions: pinned behaviours of section names, residue, amounts, flags and dates."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.functions.codes import corp_code, day8, stock_code
from filamento.functions.unicode import canonical


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", expr(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def test_names_in_any_numbering_share_a_key(spark):
    variants = ["XI. 그 밖에 투자자 보호를 위하여 필요한 사항", "11.그밖에 투자자보호를 위하여 필요한 사항", "Ⅺ. 그 밖에　투자자 보호를 위하여 필요한 사항", "(11) 그 밖에 투자자 보호를 위하여 필요한 사항", "가. 그 밖에 투자자 보호를 위하여 필요한 사항"]
    assert len(set(col(spark, variants, X.norm_name))) == 1


def test_leading_number_at_most_twice(spark):
    assert col(spark, ["II. 1. 개요", "1. 2. 3. 개요", "개요"], X.strip_leading_number) == ["개요", "3. 개요", "개요"]


def test_residue_goes_and_names_stay(spark):
    texts = ["◆click◆『수주상황』 삽입 본문", "가&cr나", "R&D 조직 &credit;", "11011#*_수주상황.dsl 본문", "『백서』 인용", None, ""]
    assert col(spark, texts, X.strip_artifacts) == ["본문", "가 나", "R&D 조직 &credit;", "본문", "『백서』 인용", "", ""]


def test_clean_text(spark):
    out = col(spark, ["  가  나 \n 다\t라 (주1) \n\n\n\n마​", "ＡＢＣ　１２", None], X.clean_text)
    assert out == ["가 나\n다 라\n\n마", "ABC 12", ""]


def test_footnotes(spark):
    assert col(spark, ["가 주1) 나", "가 ※ 나", "가 *1) 나", "가 (주) 나"], X.clean_text) == ["가 나"] * 4


def test_words_and_ngrams(spark):
    assert col(spark, [" 가나 다라  마 "], X.words) == [["가나", "다라", "마"]]
    assert [sorted(x) for x in col(spark, ["가나 다라", "가", "", None], X.char_ngrams)] == [["가나다", "나다라"], ["가"], [], []]


def test_paragraphs(spark):
    assert col(spark, ["가\n\n 나다 \n", "", None], lambda c: X.paragraphs(c, 2)) == [["나다"], [], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n가", max_size=12), min_size=1, max_size=6))
def test_ngrams_against_python(spark, values):
    def want(s):
        s = "".join(s.split())
        return sorted({s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set()))

    assert [sorted(x) for x in col(spark, values, X.char_ngrams)] == [want(v) for v in values]


def test_tenure_and_flags(spark):
    assert col(spark, ["3년 2개월", "12개월", "2년", "3년0월", "-", "", None, "약 3년"], X.tenure_months) == [38.0, 12.0, 24.0, 36.0, None, None, None, None]
    assert col(spark, ["등기임원", "미등기임원", "상근", "비상근", "", None, "-"], X.tri_bool) == [True, False, True, False, None, None, False]


def test_amounts(spark):
    rows = spark.createDataFrame([("50,488", "소송가액(억원)"), ("297,641백만원", "소송가액(억원)"), ("-", "소가"), ("", ""), ("1,000", "소송가액(원화단위: 천원)")], "c string, h string")
    out = [r[0] for r in rows.select(X.amount(F.col("c"), X.amount_unit(F.col("h")))).collect()]
    assert out == [5048800000000.0, 297641000000.0, None, None, 1000000.0]


def test_none_markers_do_not_match_everything(spark):
    assert col(spark, ["해당사항 없음", "-", "", None, "해당사항없음.", "소송은 없습니다", "소송이 진행 중인 사건의 개요와 금액을 아래에 적었으며 해당 법원은 다음과 같으나 결과가 나온 바 없음 그러합니다 그러합니다"], X.none_marker) == [True, True, False, False, True, True, False]


def test_report_types(spark):
    names = ["사업보고서 (2024.12)", "[첨부추가]사업보고서 (2024.12)", "[첨부정정]사업보고서", "[기재정정]사업보고서", "[연장결정]사업보고서", "[첨부추가][기재정정]사업보고서", None]
    kinds = col(spark, names, X.report_type)
    assert kinds == ["original", "attachment_added", "attachment_added", "material_amendment", "original", "material_amendment", "original"]
    assert col(spark, kinds, X.is_body_original) == [True, True, True, False, True, False, True]


def test_periods(spark):
    assert col(spark, ["사업보고서 (2024.12)", "사업보고서", None], lambda c: X.period_part(c, 1)) == [2024, None, None]
    assert col(spark, ["[기재정정]사업보고서 (2024.12)", "반기보고서 (2024.06)", "분기보고서"], X.matches_annual) == [True, False, False]


def test_paragraph_classes(spark):
    assert col(spark, ["상세표 참조", "K-IFRS 제1116호", "상법 제3조", "가. 개요", "1. 회사입니다.", "", None], X.paragraph_class) == ["moved", "standards", "law", "heading", "other", "other", "other"]


def test_days(spark):
    assert [str(x) for x in col(spark, ["20240304", "2024-03-04", "2024-03-04 10:00:00", "20241399", "x", None], X.to_day)] == ["2024-03-04"] * 3 + ["None"] * 3


def test_snippet(spark):
    assert col(spark, ["abcdef", "ab\ncd", None], lambda c: X.snippet(c, 2)) == ["ab … ef", "ab … cd", ""]


def test_codes(spark):
    assert col(spark, ["39256", " 00039256", "A00039256", "", None, "123456789"], corp_code) == ["00039256"] * 3 + [None] * 3
    assert col(spark, ["A003116", "'005322", "5322"], stock_code) == ["003116", "005322", "005322"]
    assert col(spark, ["2018.09.18", "2018/09/18", "20180918000001", "2018", None], day8) == ["20180918"] * 3 + [None, None]


def test_canonical(spark):
    assert col(spark, ["ａ​ b\n c ", "각", None], canonical) == ["a b c", "각", None]
