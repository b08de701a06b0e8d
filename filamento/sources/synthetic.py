"""Invented filings for trials without a remote source: the same parameters give the same filings on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of a filing in order, with the header that opens each.
HEADERS = {"S1": "II. 사업의 내용", "S2": "IV. 이사의 경영진단 및 분석의견", "S4": "VIII. 임원 및 직원 등에 관한 사항", "S3": "XI. 그 밖에 투자자 보호를 위하여 필요한 사항"}
#: What every firm writes alike from one year on, as a revised form asks for it.
TEMPLATES = (
    "회사는 개정된 서식에 따라 이 항목에 영업의 개황과 경쟁 요소를 나누어 적었으며 앞선 보고서와 구성이 다를 수 있습니다.",
    "이 항목의 금액은 별도의 표시가 없으면 연결 기준이며 단위는 백만원이고 반올림으로 합계가 맞지 않을 수 있습니다.",
    "회사가 판단한 전망은 작성일에 알고 있던 사실에 따른 것으로 실제 결과와 다를 수 있으며 이를 고칠 의무를 지지 않습니다.",
)
_SUBJECTS = ("설비 투자", "원료 조달", "수출 판매", "품질 관리", "연구 개발", "환경 규제", "인력 충원", "계열 거래")
_VERBS = ("늘렸습니다", "줄였습니다", "새로 정하였습니다", "미루었습니다", "마쳤습니다")


def _pick(values: tuple[str, ...], *seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(*seed), F.lit(len(values))).cast("int") + 1)


def filings(spark: SparkSession, firms: int, years: tuple[int, int], *, revised: int = 2020, paragraphs: int = 12, seed: int = 1) -> DataFrame:
    """(corp_code, fy, rcept_no, report_nm, rcept_dt, html) of ``firms`` firms in each year of a range.

    A section has a header of its own and ``paragraphs`` paragraphs, of which one in four differs from
    year to year; from ``revised`` on all firms open it with the same template paragraphs. The last
    section is followed by a closing header. Nothing is drawn from the driver: rows come from a range.
    """
    span = years[1] - years[0] + 1
    ids = spark.range(firms * span).select((F.floor(F.col("id") / span) + 1).cast("int").alias("firm"), (F.col("id") % span + years[0]).cast("int").alias("fy"))

    def paragraph(section: str) -> Column:
        def one(i: Column) -> Column:
            # the seed of a paragraph holds the year only where it changes from year to year
            when = F.when(i % 4 == 0, F.col("fy")).otherwise(0)
            at = [F.lit(seed), F.col("firm"), when, F.lit(section), i]
            amount = F.pmod(F.xxhash64(*at, F.lit("n")), F.lit(9000)) + 1000
            return F.concat(F.lit("<p>"), _pick(_SUBJECTS, *at), F.lit(" 금액 "), amount.cast("string"), F.lit("백만원에 대하여 회사는 계획을 "), _pick(_VERBS, *at, F.lit("v")), F.lit(".</p>"))

        same = F.when(F.col("fy") >= revised, F.lit("".join(f"<p>{t}</p>" for t in TEMPLATES))).otherwise("")
        return F.concat(F.lit(f"<p>{HEADERS[section]}</p>"), same, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(paragraphs)), one), ""))

    html = F.concat(F.lit("<html><body>"), *[paragraph(s) for s in HEADERS], F.lit("<p>XII. 상세표</p></body></html>"))
    day = F.concat((F.col("fy") + 1).cast("string"), F.lit("03"), F.lpad((F.pmod(F.xxhash64(F.lit(seed), "firm", "fy"), F.lit(28)) + 1).cast("string"), 2, "0"))
    number = F.concat(day, F.lpad(F.col("firm").cast("string"), 6, "0"))
    return ids.select(F.lpad(F.col("firm").cast("string"), 8, "0").alias("corp_code"), "fy", number.alias("rcept_no"), F.concat(F.lit("사업보고서 ("), "fy", F.lit(".12)")).alias("report_nm"), day.alias("rcept_dt"), html.alias("html"))
