"""Selection, join, ranking, sampling and set queries (F, J, L, U rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.functions.codes import corp_code, day8, stock_code
from filamento.operators import index as I
from filamento.plans.base import Book
from filamento.plans.runtime import table

book = Book()
q = book.query

_CORP = "lpad(regexp_replace(corp_code, '[^0-9]', '', 'g'), 8, '0')"
_STOCK = "lpad(regexp_replace(stock_code, '[^0-9]', '', 'g'), 6, '0')"
_ANNUAL = """(SELECT *, TRY_CAST(nullif(regexp_extract(report_nm, '\\((\\d{4})\\.(\\d{1,2})\\)', 1), '') AS INT) AS period_year, TRY_CAST(nullif(regexp_extract(report_nm, '\\((\\d{4})\\.(\\d{1,2})\\)', 2), '') AS INT) AS month FROM
 (SELECT *, trim(regexp_replace(report_nm, '^\\[[^\\]]*\\]\\s*', '')) AS bare FROM filings_index WHERE report_nm IS NOT NULL) WHERE regexp_matches(bare, '^사업보고서\\s*\\(') AND NOT contains(bare, '분기') AND NOT contains(bare, '반기') AND regexp_matches(report_nm, '\\(\\d{4}\\.\\d{1,2}\\)'))"""
_RANK = "CASE WHEN contains(report_nm, '기재정정') AND regexp_matches(report_nm, '\\[[^\\]]*기재정정') THEN 2 WHEN regexp_matches(report_nm, '\\[[^\\]]*(첨부추가|첨부정정)') THEN 1 ELSE 0 END"


@q("f01_annual_rows", f"SELECT DISTINCT rcept_no, report_nm, period_year, month FROM {_ANNUAL} WHERE month = 12 AND period_year BETWEEN 2016 AND 2022")
def f01(spark, d):
    return I.annual_rows(table(spark, d, "filings_index"), (2016, 2022), True).select("rcept_no", "report_nm", "period_year", "month").distinct()


_PATTERNS = ("스팩", "제[0-9]+호", "우$", "우[BC]$", "[0-9]우$", "리츠")


@q("f02_excluded_reason", f"SELECT DISTINCT universe_id, CASE WHEN market = 'KOSPI' AND rank_mcap % 9 = 0 THEN 'sector' WHEN regexp_matches(name, '{'|'.join(_PATTERNS)}') THEN 'name' WHEN mcap IS NULL OR mcap <= 0 THEN 'mcap' END AS reason FROM universe WHERE name IS NOT NULL AND market IS NOT NULL")
def f02(spark, d):
    sector = F.when((F.col("market") == "KOSPI") & (F.col("rank_mcap") % 9 == 0), "금융업")
    reason = I.excluded_reason(F.col("name"), sector, F.col("mcap"), ("금융업",), _PATTERNS)
    return table(spark, d, "universe").where("name is not null and market is not null").select("universe_id", reason.alias("reason")).distinct()


@q("f03_consecutive_years", "SELECT corp, fy, prev_fy FROM (SELECT corp, fy, lag(fy) OVER (PARTITION BY corp ORDER BY fy) AS prev_fy FROM (SELECT DISTINCT " + _CORP + " AS corp, fy FROM filings_index WHERE corp_code IS NOT NULL AND fy IS NOT NULL)) WHERE fy - prev_fy = 1")
def f03(spark, d):
    from pyspark.sql import Window

    f = _corp_years(spark, d).withColumn("prev_fy", F.lag("fy").over(Window.partitionBy("corp").orderBy("fy")))
    return f.where("fy - prev_fy = 1")


def _corp_years(spark, d):
    return table(spark, d, "filings_index").where("corp_code is not null and fy is not null").select(corp_code(F.col("corp_code")).alias("corp"), "fy").distinct()


@q("f04_period_window", "SELECT DISTINCT rcept_no, fy FROM filings_index WHERE fy IS NOT NULL AND substr(rcept_no, 1, 8) BETWEEN (fy + 1)::VARCHAR || '0101' AND (fy + 2)::VARCHAR || '0630'")
def f04(spark, d):
    bgn, fin = X.search_window(F.col("fy"))
    return table(spark, d, "filings_index").where(F.substring("rcept_no", 1, 8).between(bgn, fin)).select("rcept_no", "fy").distinct()


@q("f05_membership", "SELECT section_key, count(*) AS n FROM section_contents WHERE upper(section_id) IN ('S1', 'S3') AND rcept_no IN (SELECT rcept_no FROM filings_index WHERE is_correction) GROUP BY 1")
def f05(spark, d):
    keys = table(spark, d, "filings_index").where("is_correction").select("rcept_no").distinct()
    return table(spark, d, "section_contents").where(F.upper("section_id").isin("S1", "S3")).join(keys, "rcept_no", "left_semi").groupBy("section_key").agg(F.count(F.lit(1)).alias("n"))


@q("f06_problem_sections", "SELECT DISTINCT rcept_no, section_id FROM section_contents WHERE end_reason = 'EOF' OR len(list_filter(paragraphs, lambda p: contains(p, '해당사항'))) * 10 > len(paragraphs)")
def f06(spark, d):
    dirty = F.size(F.filter("paragraphs", lambda p: F.contains(p, F.lit("해당사항")))) * 10 > F.size("paragraphs")
    return table(spark, d, "section_contents").where((F.col("end_reason") == "EOF") | (F.col("paragraphs").isNotNull() & dirty)).select("rcept_no", "section_id").distinct()


_WHY = "CASE WHEN end_reason = 'EOF' THEN 'no terminator' WHEN end_reason IS NULL OR end_reason = '' THEN 'no start header' WHEN coalesce(length(text), 0) = 0 THEN 'empty body' ELSE 'other' END"


@q("f07_missing_reasons", f"SELECT upper(section_id) AS section, {_WHY} AS reason, count(*) AS n FROM section_contents WHERE NOT coalesce(found, false) GROUP BY ALL")
def f07(spark, d):
    why = F.when(F.col("end_reason") == "EOF", "no terminator").when(F.coalesce("end_reason", F.lit("")) == "", "no start header").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty body").otherwise("other")
    return table(spark, d, "section_contents").where(~F.coalesce("found", F.lit(False))).groupBy(F.upper("section_id").alias("section"), why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@q("f08_unpivot", "SELECT section_key, metric, max(value) AS value FROM (SELECT section_key, unnest(['n', 'mean', 'median', 'p10', 'p90']) AS metric, unnest([CAST(n AS DOUBLE), round(mean, 6), round(median, 6), round(p10, 6), round(p90, 6)]) AS value FROM paragraph_stats) GROUP BY ALL")
def f08(spark, d):
    s = table(spark, d, "paragraph_stats").select("section_key", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("n", "mean", "median", "p10", "p90")])
    return s.unpivot("section_key", ["n", "mean", "median", "p10", "p90"], "metric", "value").groupBy("section_key", "metric").agg(F.max("value").alias("value"))


_INDEX1 = "(SELECT rcept_no, max(corp_name) AS corp_name, max(market) AS market, max(fy) AS fy FROM filings_index GROUP BY 1)"


def _index1(spark, d):
    return table(spark, d, "filings_index").groupBy("rcept_no").agg(F.max("corp_name").alias("corp_name"), F.max("market").alias("market"), F.max("fy").alias("fy"))


@q("j03_left_lookup", f"SELECT DISTINCT s.section_key, s.rcept_no, i.corp_name, i.market FROM section_contents s LEFT JOIN {_INDEX1} i USING (rcept_no)")
def j03(spark, d):
    s = table(spark, d, "section_contents").select("section_key", "rcept_no").distinct()
    return I.with_lookup(s, _index1(spark, d).drop("fy"), ["rcept_no"]).select("section_key", "rcept_no", "corp_name", "market")


@q("j04_inner_join", f"SELECT i.market, count(*) AS n, sum(length(s.text)) AS chars FROM (SELECT DISTINCT section_key, rcept_no, text FROM section_contents) s JOIN {_INDEX1} i USING (rcept_no) GROUP BY 1")
def j04(spark, d):
    s = table(spark, d, "section_contents").select("section_key", "rcept_no", "text").distinct().select("rcept_no", F.length("text").alias("chars"))
    per = s.groupBy("rcept_no").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    return per.join(_index1(spark, d), "rcept_no").groupBy("market").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@q("j05_semi_join", f"SELECT DISTINCT {_STOCK} AS code, fy FROM filings_index f WHERE fy IS NOT NULL AND stock_code IS NOT NULL AND ({_STOCK}, fy) IN (SELECT ({_STOCK}, fy) FROM universe WHERE stock_code IS NOT NULL)")
def j05(spark, d):
    u = table(spark, d, "universe").where("stock_code is not null").select(stock_code(F.col("stock_code")).alias("code"), "fy").distinct()
    return table(spark, d, "filings_index").where("fy is not null and stock_code is not null").select(stock_code(F.col("stock_code")).alias("code"), "fy").distinct().join(u, ["code", "fy"], "left_semi")


@q("j06_missing_previous", "WITH k AS (SELECT DISTINCT " + _CORP + " AS corp, fy FROM filings_index WHERE corp_code IS NOT NULL AND fy IS NOT NULL) SELECT corp, fy - 1 AS fy FROM k a WHERE fy > (SELECT min(fy) FROM k) AND NOT EXISTS (SELECT 1 FROM k b WHERE b.corp = a.corp AND b.fy = a.fy - 1)")
def j06(spark, d):
    return I.missing_previous(_corp_years(spark, d), "corp", "fy")


_LIST = f"(SELECT {_STOCK} AS code, min(CAST(snapshot_date AS DATE)) AS listed, max(delist_date) AS delisted FROM universe WHERE stock_code IS NOT NULL GROUP BY 1)"


@q("j07_listed_at", f"SELECT DISTINCT CAST(s.at AS VARCHAR) AS at, l.code FROM (SELECT DISTINCT CAST(snapshot_date AS DATE) AS at FROM universe) s JOIN {_LIST} l ON l.listed <= s.at AND (l.delisted IS NULL OR CAST(l.delisted AS DATE) > s.at)")
def j07(spark, d):
    u = table(spark, d, "universe").withColumn("code", stock_code(F.col("stock_code"))).withColumn("at", F.col("snapshot_date").cast("date"))
    spans = u.where("code is not null").groupBy("code").agg(F.min("at").alias("listed"), F.max(F.col("delist_date").cast("date")).alias("delisted"))
    return I.listed_at(u, spans, at="at", code="code", listed="listed", delisted="delisted").select(F.col("at").cast("string").alias("at"), "code")


@q("j08_same_group_pairs", "SELECT a.n_regionkey AS region, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j08(spark, d):
    return I.same_group_pairs(table(spark, d, "nation"), [], "n_regionkey", "n_nationkey").select(F.col("n_regionkey").alias("region"), "a", "b")


_TEXTS = "(SELECT " + _CORP + " AS corp, upper(section_id) AS sid, fy, max(text) AS text FROM section_contents WHERE corp_code IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"


@q("j10_adjacent_periods", f"SELECT c.corp, c.sid, c.fy, p.fy AS prev_fy, length(c.text) - length(p.text) AS grown FROM {_TEXTS} c JOIN {_TEXTS} p ON c.corp = p.corp AND c.sid = p.sid AND c.fy = p.fy + 1")
def j10(spark, d):
    s = table(spark, d, "section_contents").where("corp_code is not null and text is not null").groupBy(corp_code(F.col("corp_code")).alias("corp"), F.upper("section_id").alias("sid"), "fy").agg(F.max("text").alias("text")).select("corp", "sid", "fy", F.length("text").alias("n"))
    prev = s.select("corp", "sid", (F.col("fy") + 1).alias("fy"), F.col("fy").alias("prev_fy"), F.col("n").alias("m"))
    return s.join(prev, ["corp", "sid", "fy"]).select("corp", "sid", "fy", "prev_fy", (F.col("n") - F.col("m")).alias("grown"))


@q("j11_earliest_delisting", f"SELECT DISTINCT u.universe_id, CAST(m.first_delist AS VARCHAR) AS first_delist FROM universe u LEFT JOIN (SELECT {_STOCK} AS code, min(CAST(delist_date AS DATE)) AS first_delist FROM universe GROUP BY 1) m ON {_STOCK.replace('stock_code', 'u.stock_code')} = m.code")
def j11(spark, d):
    u = table(spark, d, "universe").select("universe_id", stock_code(F.col("stock_code")).alias("code"), F.col("delist_date").cast("date").alias("dd"))
    first = u.where("code is not null").groupBy("code").agg(F.min("dd").alias("first_delist"))
    return I.with_lookup(u.select("universe_id", "code").distinct(), first, ["code"]).select("universe_id", F.col("first_delist").cast("string").alias("first_delist"))


@q("j12_latest_row", f"SELECT code, arg_max(universe_id, (snapshot_date, known_at, universe_id)) AS universe_id FROM (SELECT {_STOCK} AS code, * FROM universe WHERE stock_code IS NOT NULL) GROUP BY 1")
def j12(spark, d):
    u = table(spark, d, "universe").withColumn("code", stock_code(F.col("stock_code")))
    return I.latest_by(u, "code", ["snapshot_date", "known_at", "universe_id"], ["universe_id"])


@q("j13_last_seen", f"SELECT {_STOCK} AS code, max(fy) AS last_seen_fy FROM universe WHERE stock_code IS NOT NULL GROUP BY 1")
def j13(spark, d):
    return table(spark, d, "universe").where("stock_code is not null").groupBy(stock_code(F.col("stock_code")).alias("code")).agg(F.max("fy").alias("last_seen_fy"))


@q("a08_amendments", """WITH k AS (SELECT DISTINCT rcept_no, """ + _CORP + f""" AS corp, fy, strptime(substr(rcept_no, 1, 8), '%Y%m%d')::DATE AS day, {_RANK} AS r FROM filings_index WHERE report_nm IS NOT NULL AND corp_code IS NOT NULL AND fy IS NOT NULL)
SELECT corp, fy, count(*) FILTER (WHERE r = 2) AS n_material, count(*) FILTER (WHERE r = 1) AS n_attached, date_diff('day', min(day) FILTER (WHERE r < 2), min(day) FILTER (WHERE r = 2)) AS lag_days FROM k GROUP BY 1, 2""")
def a08(spark, d):
    k = table(spark, d, "filings_index").where("report_nm is not null and corp_code is not null and fy is not null").select("rcept_no", corp_code(F.col("corp_code")).alias("corp"), "fy", F.to_date(day8(F.col("rcept_no")), "yyyyMMdd").alias("day"), X.report_type(F.col("report_nm")).alias("kind")).distinct()
    material = F.col("kind") == "material_amendment"
    g = k.groupBy("corp", "fy").agg(F.count_if(material).alias("n_material"), F.count_if(F.col("kind") == "attachment_added").alias("n_attached"), F.min(F.when(~material, F.col("day"))).alias("o"), F.min(F.when(material, F.col("day"))).alias("m"))
    return g.select("corp", "fy", "n_material", "n_attached", F.datediff("m", "o").cast("bigint").alias("lag_days"))


@q("a23_pick_original", f"""SELECT corp, period_year, rcept_no, r = 2 AS is_correction, bool_or(r = 2) OVER g AS is_correction_exists FROM (SELECT {_CORP} AS corp, period_year, rcept_no, {_RANK} AS r, coalesce(rcept_dt, '') AS dt FROM {_ANNUAL} WHERE corp_code IS NOT NULL)
 WINDOW g AS (PARTITION BY corp, period_year) QUALIFY row_number() OVER (PARTITION BY corp, period_year ORDER BY r, dt, rcept_no) = 1""")
def a23(spark, d):
    rows = I.annual_rows(table(spark, d, "filings_index")).where("corp_code is not null").withColumn("corp", corp_code(F.col("corp_code")))
    return I.pick_original(rows, ["corp", "period_year"], "report_nm", "rcept_dt", "rcept_no").select("corp", "period_year", "rcept_no", "is_correction", "is_correction_exists")


_MCAP = f"(SELECT fy, {_STOCK} AS code, max(mcap) AS mcap FROM universe WHERE mcap IS NOT NULL AND stock_code IS NOT NULL GROUP BY ALL)"


def _mcap(spark, d):
    return table(spark, d, "universe").where("mcap is not null and stock_code is not null").groupBy("fy", stock_code(F.col("stock_code")).alias("code")).agg(F.max("mcap").alias("mcap"))


@q("l01_top_per_year", f"SELECT fy, code, mcap FROM {_MCAP} QUALIFY row_number() OVER (PARTITION BY fy ORDER BY mcap DESC, code) <= 20")
def l01(spark, d):
    return I.ranked_top(_mcap(spark, d), "fy", "mcap", "code", 20, "rk").drop("rk")


@q("l02_global_bottom", f"SELECT fy, code, mcap FROM {_MCAP} ORDER BY mcap, code, fy LIMIT 20")
def l02(spark, d):
    return _mcap(spark, d).orderBy("mcap", "code", "fy").limit(20)


@q("l03_cap_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def l03(spark, d):
    return I.ranked_top(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 5, "rk").select("source", "doc_id")


@q("l04_newest_first", "SELECT fy, corp, CAST(row_number() OVER (PARTITION BY fy ORDER BY corp) AS BIGINT) AS place FROM (SELECT DISTINCT " + _CORP + " AS corp, fy FROM filings_index WHERE corp_code IS NOT NULL AND fy IS NOT NULL)")
def l04(spark, d):
    """Processing order: newest year first, then firm; the place within its year is the order's witness."""
    from pyspark.sql import Window

    placed = _corp_years(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("fy").orderBy("corp")).cast("bigint"))
    return placed.orderBy(F.desc("fy"), F.asc("corp"))


@q("l05_seeded_sample", "SELECT doc_id, md5('20260821' || doc_id::VARCHAR) AS h FROM documents ORDER BY h, doc_id LIMIT 30")
def l05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("20260821"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(30)


@q("u01_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'filing' AS kind FROM filings_index UNION ALL SELECT 'section' FROM section_contents) GROUP BY 1")
def u01(spark, d):
    both = table(spark, d, "filings_index").select(F.lit("filing").alias("kind")).unionByName(table(spark, d, "section_contents").select(F.lit("section").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@q("u02_distinct", "SELECT DISTINCT market, fy FROM filings_index")
def u02(spark, d):
    return table(spark, d, "filings_index").select("market", "fy").distinct()


@q("u03_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT rcept_no FROM filings_index INTERSECT SELECT rcept_no FROM section_contents) UNION ALL SELECT 'index only', count(*) FROM (SELECT rcept_no FROM filings_index EXCEPT SELECT rcept_no FROM section_contents)")
def u03(spark, d):
    a, b = table(spark, d, "filings_index").select("rcept_no"), table(spark, d, "section_contents").select("rcept_no")
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "index only"))


queries, oracle_sql = book.queries, book.oracle_sql
