"""Whole pipelines composed of the operators: universe, enriched index, missing filings, term look-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.functions.codes import corp_code, stock_code
from filamento.operators import index as I
from filamento.operators import quality as Q
from filamento.operators import sections as S
from filamento.plans.base import Book
from filamento.plans.q_index import _ANNUAL, _CORP, _PATTERNS, _RANK, _STOCK
from filamento.plans.q_quality import _VARIANTS
from filamento.plans.q_sections import block_sequence
from filamento.plans.q_similarity import _matches
from filamento.plans.runtime import table

book = Book()
q = book.query

_U = f"(SELECT fy, {_STOCK} AS code, max(name) AS name, max(mcap) AS mcap, max(CAST(snapshot_date AS DATE)) AS snap, min(CAST(delist_date AS DATE)) AS dd FROM universe WHERE stock_code IS NOT NULL AND name IS NOT NULL GROUP BY ALL)"


@q("z01_universe", f"""WITH u AS {_U}, f AS (SELECT code, min(dd) AS first_delist, max(fy) AS last_seen_fy FROM u GROUP BY 1)
SELECT fy, code, rank_mcap, CAST(first_delist AS VARCHAR) AS delist_date, coalesce(first_delist > snap, false) AS is_delisted_later, last_seen_fy FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fy ORDER BY mcap DESC, code) AS BIGINT) AS rank_mcap FROM u WHERE NOT regexp_matches(name, '{'|'.join(_PATTERNS)}') AND mcap > 0) JOIN f USING (code) WHERE rank_mcap <= 40""")
def z01(spark, d):
    """Per year the largest listings that no reason excludes, with rank and later delisting."""
    u = table(spark, d, "universe").where("stock_code is not null and name is not null")
    u = u.groupBy("fy", stock_code(F.col("stock_code")).alias("code")).agg(F.max("name").alias("name"), F.max("mcap").alias("mcap"), F.max(F.col("snapshot_date").cast("date")).alias("at"), F.min(F.col("delist_date").cast("date")).alias("dd"))
    facts = u.groupBy("code").agg(F.min("dd").alias("first_delist"), F.max("fy").alias("last_seen_fy"))
    kept = u.where(I.excluded_reason(F.col("name"), None, F.col("mcap"), (), _PATTERNS).isNull())
    top = I.ranked_top(kept, "fy", "mcap", "code", 40, "rank_mcap")
    out = I.with_lookup(top, facts, ["code"])
    return out.select("fy", "code", F.col("rank_mcap").cast("bigint").alias("rank_mcap"), F.col("first_delist").cast("string").alias("delist_date"), F.coalesce(F.col("first_delist") > F.col("at"), F.lit(False)).alias("is_delisted_later"), "last_seen_fy")


@q("z02_enriched_index", f"""WITH a AS (SELECT {_CORP} AS corp, period_year AS fy, rcept_no, {_RANK} AS r, coalesce(rcept_dt, '') AS dt FROM {_ANNUAL} WHERE corp_code IS NOT NULL AND month = 12),
 m AS (SELECT corp, fy, count(DISTINCT rcept_no) FILTER (WHERE r = 2) AS n_material FROM a GROUP BY ALL), p AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY corp, fy ORDER BY r, dt, rcept_no) = 1)
SELECT p.corp, p.fy, p.rcept_no, CASE p.r WHEN 2 THEN 'material_amendment' WHEN 1 THEN 'attachment_added' ELSE 'original' END AS kind, m.n_material FROM p JOIN m ON p.corp = m.corp AND p.fy = m.fy""")
def z02(spark, d):
    """The chosen filing of every firm and December year, its kind, and how often it was amended."""
    rows = I.annual_rows(table(spark, d, "filings_index"), None, True).where("corp_code is not null").select(corp_code(F.col("corp_code")).alias("corp"), F.col("period_year").alias("fy"), "rcept_no", "report_nm", "rcept_dt")
    amended = rows.groupBy("corp", "fy").agg(F.countDistinct(F.when(X.report_type(F.col("report_nm")) == "material_amendment", F.col("rcept_no"))).alias("n_material"))
    chosen = I.pick_original(rows, ["corp", "fy"], "report_nm", "rcept_dt", "rcept_no")
    return chosen.join(amended, ["corp", "fy"]).select("corp", "fy", "rcept_no", "kind", "n_material")


@q("z03_pair_only_filings", f"""WITH k AS (SELECT DISTINCT {_CORP} AS corp, fy FROM section_contents WHERE corp_code IS NOT NULL), need AS (SELECT corp, fy - 1 AS fy FROM k a WHERE fy > (SELECT min(fy) FROM k) AND NOT EXISTS (SELECT 1 FROM k b WHERE b.corp = a.corp AND b.fy = a.fy - 1))
SELECT a.corp, a.fy, a.rcept_no, 'pair_only' AS sample_role FROM (SELECT {_CORP} AS corp, period_year AS fy, rcept_no, {_RANK} AS r, coalesce(rcept_dt, '') AS dt FROM {_ANNUAL} WHERE corp_code IS NOT NULL) a JOIN need ON need.corp = a.corp AND need.fy = a.fy QUALIFY row_number() OVER (PARTITION BY a.corp, a.fy ORDER BY r, dt, a.rcept_no) = 1""")
def z03(spark, d):
    """Filings of the years before, needed only to pair with a parsed one."""
    parsed = table(spark, d, "section_contents").where("corp_code is not null").select(corp_code(F.col("corp_code")).alias("corp"), "fy").distinct()
    need = I.missing_previous(parsed, "corp", "fy")
    rows = I.annual_rows(table(spark, d, "filings_index")).where("corp_code is not null").select(corp_code(F.col("corp_code")).alias("corp"), F.col("period_year").alias("fy"), "rcept_no", "report_nm", "rcept_dt").join(need, ["corp", "fy"], "left_semi")
    return I.pick_original(rows, ["corp", "fy"], "report_nm", "rcept_dt", "rcept_no").select("corp", "fy", "rcept_no", F.lit("pair_only").alias("sample_role"))


@q("z04_term_paragraphs", "SELECT DISTINCT section_key, p FROM (SELECT section_key, unnest(paragraphs) AS p FROM section_contents WHERE upper(section_id) = 'S1') WHERE contains(p, '합작')")
def z04(spark, d):
    """Paragraphs of a section that hold a term."""
    p = table(spark, d, "section_contents").where(F.upper("section_id") == "S1").select("section_key", F.explode("paragraphs").alias("p"))
    return p.where(F.contains("p", F.lit("합작"))).distinct()


@q("z05_download_progress", "SELECT fy, count(*) AS target, count(*) FILTER (WHERE done) AS n_done, count(*) FILTER (WHERE NOT done) AS n_left, round(count(*) FILTER (WHERE done) / count(*), 6) AS rate FROM (SELECT rcept_no, max(fy) AS fy, rcept_no IN (SELECT rcept_no FROM section_contents) AS done FROM filings_index GROUP BY 1) GROUP BY 1")
def z05(spark, d):
    """Filings with an output, by year: what a re-run would still do."""
    tasks = table(spark, d, "filings_index").groupBy("rcept_no").agg(F.max("fy").alias("fy"))
    done = table(spark, d, "section_contents").select("rcept_no", F.lit(True).alias("_done")).distinct()
    s = tasks.join(done, "rcept_no", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    return s.groupBy("fy").agg(F.count(F.lit(1)).alias("target"), F.count_if("_done").alias("n_done"), F.count_if(~F.col("_done")).alias("n_left"), F.round(Q.rate(F.col("_done")), 6).alias("rate"))



@q("z06_every_section", """WITH d AS (SELECT DISTINCT rcept_no FROM filings_index WHERE rcept_no IS NOT NULL), s AS (SELECT rcept_no, upper(section_id) AS sid, bool_or(found) AS found, max(length(text)) AS chars FROM section_contents GROUP BY ALL)
SELECT d.rcept_no, t.sid AS section_id, coalesce(s.found, false) AS found, coalesce(s.chars, 0) AS chars FROM d CROSS JOIN (VALUES ('S1'), ('S2'), ('S3'), ('S4')) t(sid) LEFT JOIN s ON s.rcept_no = d.rcept_no AND s.sid = t.sid""")
def z06(spark, d):
    """Every filing with a row for each section, whether it could be parsed or not."""
    docs = table(spark, d, "filings_index").select(F.col("rcept_no").alias("doc"))
    parsed = table(spark, d, "section_contents").select(F.col("rcept_no").alias("doc"), F.upper("section_id").alias("section_id"), "found", "text")
    return S.with_every_section(docs, parsed).withColumnRenamed("doc", "rcept_no")


@q("z07_variant_headers", _VARIANTS + """ SELECT section_id, count(DISTINCT doc) AS n_docs, count(DISTINCT doc) FILTER (WHERE variant = 'old') AS n_old, count(DISTINCT doc) FILTER (WHERE variant = 'new') AS n_new,
 CAST(coalesce(sum(length(p)) FILTER (WHERE variant = 'old'), 0) AS BIGINT) AS chars_old, CAST(coalesce(sum(length(p)) FILTER (WHERE variant = 'new'), 0) AS BIGINT) AS chars_new FROM lines GROUP BY 1""")
def z07(spark, d, plain=True):
    """Both parse rules side by side, by section: documents with a body and the characters of their blocks."""
    exact = {"threshold": None, "old_threshold": None, "min_chars": 0} if plain else {}
    v = S.variants(block_sequence(spark, d, plain), **exact)
    chars = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda s, p: s + F.length(p))
    of = lambda name, value: F.coalesce(F.sum(F.when(F.col("variant") == name, value)), F.lit(0)).cast("bigint")
    one = F.lit(1)
    return v.groupBy("section_id").agg(F.countDistinct("doc").alias("n_docs"), of("old", one).alias("n_old"), of("new", one).alias("n_new"), of("old", chars).alias("chars_old"), of("new", chars).alias("chars_new"))


@q("z07_header_differences")
def z07_headers(spark, d):
    """Documents whose sections begin or end elsewhere under the old rule, by section."""
    v = S.variants(block_sequence(spark, d))
    side = lambda name: v.where(F.col("variant") == name).select("doc", "section_id", *[F.col(c).alias(f"{c}_{name}") for c in ("start_header", "end_header", "end_reason", "found")])
    both = side("old").join(side("new"), ["doc", "section_id"], "full_outer")
    differs = lambda c: F.count_if(~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new")))
    return both.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_docs"), *[differs(c).alias(f"n_{c}_differs") for c in ("start_header", "end_header", "end_reason", "found")])


@q("z08_doubtful_names")
def z08(spark, d):
    """The 30 least certain fuzzy matches of names to listings, for review."""
    return _matches(spark, d).where("match_type = 'fuzzy'").orderBy("score", "name").limit(30).select("name", "choice", "score")


@q("z09_length_panel", f"""WITH i AS (SELECT rcept_no, max({_CORP}) AS corp, max(fy) AS fy FROM filings_index WHERE rcept_no IS NOT NULL GROUP BY 1), s AS (SELECT rcept_no, upper(section_id) AS section_id, max(length(text)) AS n FROM section_contents WHERE found GROUP BY ALL)
SELECT i.corp, i.fy, s.section_id, round(ln(n), 6) AS log_chars FROM i JOIN s USING (rcept_no) WHERE n > 0 AND section_id IN ('S1', 'S2', 'S3', 'S4')""")
def z09(spark, d):
    """Logarithms of section lengths with the firm and year of their filing."""
    index = table(spark, d, "filings_index").where("rcept_no is not null").groupBy("rcept_no").agg(F.max(corp_code(F.col("corp_code"))).alias("corp"), F.max("fy").alias("fy"))
    s = table(spark, d, "section_contents").where("found").select("rcept_no", F.upper("section_id").alias("sid"), F.length("text").alias("n"))
    wide = s.groupBy("rcept_no").pivot("sid", sorted(S.TARGETS)).agg(F.max("n"))
    return S.length_panel(index, wide, "rcept_no", ["corp", "fy"], {c: c for c in sorted(S.TARGETS)}).withColumn("log_chars", F.round("log_chars", 6))


book.whole("z07_variant_headers_whole", "z07_variant_headers")
queries, oracle_sql = book.queries, book.oracle_sql
