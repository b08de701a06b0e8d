"""Panel, as-of and window queries (J1, J2, W rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamento.functions.codes import day8, stock_code
from filamento.operators import panel as P
from filamento.plans.base import Book
from filamento.plans.runtime import table

book = Book()
q = book.query
KEY = {"key": "stock_code", "date": "date"}

_CODE = "lpad(regexp_replace(stock_code, '[^0-9]', '', 'g'), 6, '0')"
DAILY = f"(SELECT {_CODE} AS stock_code, date, max(px) AS px FROM panel WHERE stock_code IS NOT NULL AND date IS NOT NULL GROUP BY ALL)"
OVER = "OVER (PARTITION BY stock_code ORDER BY date)"
DAY = "CAST(date AS VARCHAR) AS day"


def daily(spark, d):
    rows = table(spark, d, "panel").select(stock_code(F.col("stock_code")).alias("stock_code"), "date", "px")
    return P.daily(rows, "stock_code", "date", "px")


def _out(df, *columns):
    return df.select("stock_code", F.col("date").cast("string").alias("day"), *[F.round(c, 6).alias(c) for c in columns])


@q("w01_shift", f"SELECT stock_code, {DAY}, round(lag(px, 1) {OVER}, 6) AS prev, round(lead(px, 2) {OVER}, 6) AS ahead FROM {DAILY}")
def w01(spark, d):
    df = P.shifted(daily(spark, d), "px", 1, out="prev", **KEY)
    return _out(P.shifted(df, "px", -2, out="ahead", **KEY), "prev", "ahead")


@q("w02_difference", f"SELECT stock_code, {DAY}, round(px - lag(px, 1) {OVER}, 6) AS diff FROM {DAILY}")
def w02(spark, d):
    return _out(P.difference(daily(spark, d), "px", 1, out="diff", **KEY), "diff")


@q("w03_pct_change", f"SELECT stock_code, {DAY}, round((px - lag(px, 1) {OVER}) / nullif(lag(px, 1) {OVER}, 0), 6) AS pct FROM {DAILY}")
def w03(spark, d):
    return _out(P.pct_change(daily(spark, d), "px", 1, out="pct", **KEY), "pct")


_ROLL = "OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@q("w04_rolling", f"SELECT stock_code, {DAY}, CASE WHEN count(px) {_ROLL} >= 3 THEN round(avg(px) {_ROLL}, 4) END AS mean3, CASE WHEN count(px) {_ROLL} >= 2 THEN round(stddev_samp(px) {_ROLL}, 4) END AS std2, CASE WHEN count(px) {_ROLL} >= 3 THEN round(max(px) {_ROLL}, 4) END AS max3 FROM {DAILY}")
def w04(spark, d):
    df = P.rolling(daily(spark, d), "px", 3, "mean", out="mean3", **KEY)
    df = P.rolling(df, "px", 3, "std", out="std2", min_periods=2, **KEY)
    df = P.rolling(df, "px", 3, "max", out="max3", **KEY)
    return df.select("stock_code", F.col("date").cast("string").alias("day"), *[F.round(c, 4).alias(c) for c in ("mean3", "std2", "max3")])


@q("w05_forward_return", f"SELECT stock_code, {DAY}, round(lead(px, 1) {OVER} / nullif(px, 0) - 1, 6) AS fwd FROM {DAILY}")
def w05(spark, d):
    return _out(P.forward_return(daily(spark, d), "px", 1, out="fwd", **KEY), "fwd")


@q("w06_group_demean", f"SELECT stock_code, {DAY}, round(px - avg(px) OVER (PARTITION BY stock_code), 4) AS demeaned, round((px - avg(px) OVER (PARTITION BY stock_code)) / nullif(stddev_samp(px) OVER (PARTITION BY stock_code), 0), 4) AS z FROM {DAILY}")
def w06(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("stock_code")
    dev = F.col("px") - F.avg("px").over(w)
    return daily(spark, d).select("stock_code", F.col("date").cast("string").alias("day"), F.round(dev, 4).alias("demeaned"), F.round(dev / F.nullif(F.stddev_samp("px").over(w), F.lit(0.0)), 4).alias("z"))


@q("w07_group_share", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def w07(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", "lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6).alias("share"))


_CHARS = "(SELECT lpad(regexp_replace(corp_code,'[^0-9]','','g'),8,'0') AS corp, upper(section_id) AS sid, fy, max(length(text)) AS chars FROM section_contents WHERE corp_code IS NOT NULL AND text IS NOT NULL AND length(text) > 0 GROUP BY ALL)"


def section_chars(spark, d):
    from filamento.functions.codes import corp_code

    s = table(spark, d, "section_contents").where("corp_code is not null and text is not null and length(text) > 0")
    return s.groupBy(corp_code(F.col("corp_code")).alias("corp"), F.upper("section_id").alias("sid"), "fy").agg(F.max(F.length("text")).alias("chars"))


@q("w08_log_difference", f"SELECT corp, sid, fy, lag(fy) OVER (PARTITION BY corp, sid ORDER BY fy) AS prev_fy, round(ln(chars) - lag(ln(chars)) OVER (PARTITION BY corp, sid ORDER BY fy), 6) AS dlog FROM {_CHARS}")
def w08(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("corp", "sid").orderBy("fy")
    log = F.ln("chars")
    return section_chars(spark, d).select("corp", "sid", "fy", F.lag("fy").over(w).alias("prev_fy"), F.round(log - F.lag(log).over(w), 6).alias("dlog"))


@q("w09_rank", f"SELECT fy, code, CAST(row_number() OVER (PARTITION BY fy ORDER BY mcap DESC, code) AS BIGINT) AS rank_mcap FROM (SELECT fy, {_CODE} AS code, max(mcap) AS mcap FROM universe WHERE mcap IS NOT NULL AND stock_code IS NOT NULL GROUP BY ALL)")
def w09(spark, d):
    from filamento.operators.index import ranked_top

    return ranked_top(_mcaps(spark, d), "fy", "mcap", "code", None, "rank_mcap").select("fy", "code", F.col("rank_mcap").cast("bigint").alias("rank_mcap"))


def _mcaps(spark, d):
    u = table(spark, d, "universe").where("mcap is not null and stock_code is not null")
    return u.groupBy("fy", stock_code(F.col("stock_code")).alias("code")).agg(F.max("mcap").alias("mcap"))


_FACTS = f"(SELECT {_CODE} AS stock_code, CAST(strptime(coalesce(substr(nullif(regexp_replace(coalesce(rcept_dt,''),'[^0-9]','','g'),''),1,8), substr(rcept_no,1,8)), '%Y%m%d') AS DATE) AS avail, max(rcept_no) AS rcept_no FROM filings_index WHERE stock_code IS NOT NULL GROUP BY ALL)"


def facts(spark, d):
    f = table(spark, d, "filings_index").select(stock_code(F.col("stock_code")).alias("stock_code"), F.to_date(F.coalesce(day8(F.col("rcept_dt")), day8(F.col("rcept_no"))), "yyyyMMdd").alias("avail"), "rcept_no")
    return f.where("stock_code is not null")


@q("j01_as_of", f"SELECT p.stock_code, CAST(p.date AS VARCHAR) AS day, CAST(f.avail AS VARCHAR) AS avail, f.rcept_no FROM {DAILY} p ASOF LEFT JOIN {_FACTS} f ON p.stock_code = f.stock_code AND p.date >= f.avail")
def j01(spark, d):
    out = P.as_of(daily(spark, d), facts(spark, d), key="stock_code", date="date", available="avail", values=["rcept_no"])
    return out.select("stock_code", F.col("date").cast("string").alias("day"), F.col("avail").cast("string").alias("avail"), "rcept_no")


_CAL = "(SELECT DISTINCT CAST(date AS DATE) AS day FROM panel WHERE date IS NOT NULL AND isodow(date) <= 5 AND dayofmonth(date) % 5 <> 0)"


@q("j02_next_trading_day", f"SELECT f.rcept_no, CAST(f.avail AS VARCHAR) AS day, CAST((SELECT min(c.day) FROM {_CAL} c WHERE c.day > f.avail) AS VARCHAR) AS event_day FROM (SELECT rcept_no, min(CAST(strptime(coalesce(substr(nullif(regexp_replace(coalesce(rcept_dt,''),'[^0-9]','','g'),''),1,8), substr(rcept_no,1,8)), '%Y%m%d') AS DATE)) AS avail FROM filings_index GROUP BY 1) f")
def j02(spark, d):
    f = table(spark, d, "filings_index").groupBy("rcept_no").agg(F.min(F.to_date(F.coalesce(day8(F.col("rcept_dt")), day8(F.col("rcept_no"))), "yyyyMMdd")).alias("avail"))
    calendar = table(spark, d, "panel").select(F.col("date").cast("date").alias("day")).where("weekday(day) <= 4 and day(day) % 5 <> 0")
    out = P.next_trading_day(f, calendar, "avail", "day", "event_day")
    return out.select("rcept_no", F.col("avail").cast("string").alias("day"), F.col("event_day").cast("string").alias("event_day"))


_SEEN = f"(SELECT p.stock_code, p.date, max(f.avail) AS avail FROM {DAILY} p JOIN {_FACTS} f ON p.stock_code = f.stock_code AND f.avail <= CAST(p.date AS DATE) + {{}} GROUP BY ALL)"


@q(
    "w10_lookahead_violations",
    f"SELECT (SELECT count(*) FROM {_SEEN.format(0)} WHERE avail > CAST(date AS DATE)) AS violations, (SELECT count(*) FROM {_SEEN.format(30)} WHERE avail > CAST(date AS DATE)) AS planted, "
    f"(SELECT count(*) FROM {DAILY} p JOIN (SELECT DISTINCT stock_code, avail FROM {_FACTS}) f ON p.stock_code = f.stock_code AND f.avail > CAST(p.date AS DATE) AND f.avail <= CAST(p.date AS DATE) + 30) AS later_facts",
)
def w10(spark, d):
    """Look-ahead in an as-of join (none), in one that is 30 days wrong, and facts within 30 days after a price.

    Facts and prices meet in the months of those 30 days."""
    days = daily(spark, d).select("stock_code", F.col("date").cast("date").alias("date"))
    join = lambda rows: P.as_of(rows, facts(spark, d), key="stock_code", date="date", available="avail", values=["rcept_no"])
    late = P.lookahead_violations(join(days), "date", "avail").agg(F.count(F.lit(1)).alias("violations")).scalar()
    wrong = join(days.withColumn("date", F.date_add("date", 30))).withColumn("date", F.date_sub("date", 30))
    planted = P.lookahead_violations(wrong, "date", "avail").agg(F.count(F.lit(1)).alias("planted")).scalar()
    month = lambda c: F.trunc(c, "month")
    ahead = days.withColumn("_m", F.explode(F.sequence(month(F.date_add("date", 1)), month(F.date_add("date", 30)), F.expr("interval 1 month"))))
    known = facts(spark, d).select("stock_code", "avail").distinct().withColumn("_m", month("avail"))
    met = ahead.join(known, ["stock_code", "_m"]).where("avail > date and avail <= date_add(date, 30)").agg(F.count(F.lit(1)).alias("later_facts"))
    return met.select(late.alias("violations"), planted.alias("planted"), "later_facts")


queries, oracle_sql = book.queries, book.oracle_sql
