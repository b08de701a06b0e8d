"""Aggregate and diagnostic queries (A rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamento.operators import html as H
from filamento.operators import quality as Q
from filamento.operators import sections as S
from filamento.operators import similarity as M
from filamento.plans.base import Book
from filamento.plans.q_panel import _CHARS, section_chars
from filamento.plans.q_sections import _BLOCK_ROWS, _CAPTIONED, _SPANS, _TARGET, block_sequence, captioned
from filamento.plans.q_similarity import _LISTED, MARKERS
from filamento.plans.runtime import table

book = Book()
q = book.query
r6 = lambda df, *cs: df.select(*[F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns])

SECTIONS = "(SELECT DISTINCT section_key, rcept_no, corp_code, fy, upper(section_id) AS sid, found, text, paragraphs, tables_html, end_reason FROM section_contents)"
PARAS = f"(SELECT section_key, sid, p FROM (SELECT section_key, sid, unnest(paragraphs) AS p FROM {SECTIONS}) WHERE p IS NOT NULL)"


def sections(spark, d):
    return table(spark, d, "section_contents").select("section_key", "rcept_no", "corp_code", "fy", F.upper("section_id").alias("sid"), "found", "text", "paragraphs", "tables_html", "end_reason").distinct()


def paras(spark, d):
    return sections(spark, d).select("section_key", "sid", F.explode("paragraphs").alias("p")).where("p is not null")


@q("a01_group_mean_median", "SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents WHERE source IS NOT NULL GROUP BY 1")
def a01(spark, d):
    return r6(Q.describe(table(spark, d, "documents"), ["source"], "n_chars"), "mean")


@q("a02_quartiles", "SELECT lang, count(n_chars) AS n, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.75), 6) AS q75, round(quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25), 6) AS iqr FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def a02(spark, d):
    g = Q.describe(table(spark, d, "documents"), ["lang"], "n_chars", {"q25": 0.25, "q75": 0.75}).withColumn("iqr", F.col("q75") - F.col("q25"))
    return r6(g.select("lang", "n", "q25", "q75", "iqr"), "q25", "q75", "iqr")


@q("a03_group_deciles", "SELECT fy, section_id, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents WHERE fy IS NOT NULL AND section_id IS NOT NULL GROUP BY ALL")
def a03(spark, d):
    g = Q.describe(table(spark, d, "documents"), ["fy", "section_id"], "n_chars", {"p10": 0.1, "p90": 0.9}).drop("median")
    return r6(g, "mean", "p10", "p90")


@q("a04_paragraph_lengths", f"SELECT section_key, count(*) AS n, round(avg(length(p)), 6) AS mean, median(length(p)) AS median, round(quantile_cont(length(p), 0.1), 6) AS p10, round(quantile_cont(length(p), 0.9), 6) AS p90, count(*) FILTER (WHERE length(p) < 10) AS n_under_10, round(count(*) FILTER (WHERE length(p) < 10) / count(*), 6) AS share_under_10 FROM {PARAS} GROUP BY 1")
def a04(spark, d):
    return r6(Q.paragraph_length_stats(paras(spark, d), ["section_key"], "p"), "mean", "p10", "p90", "share_under_10")


@q("a05_found_rates", f"SELECT sid, fy, round(avg(coalesce(found, false)::INT), 6) AS found_rate, count(*) FILTER (WHERE end_reason = 'EOF') AS n_eof FROM {SECTIONS} GROUP BY ALL")
def a05(spark, d):
    return sections(spark, d).groupBy("sid", "fy").agg(F.round(Q.rate(F.col("found")), 6).alias("found_rate"), F.count_if(F.col("end_reason") == "EOF").alias("n_eof"))


@q("a06_distinct_and_rate", "SELECT coalesce(u.fy, f.fy) AS fy, coalesce(listed, 0) AS listed, coalesce(filed, 0) AS filed, round(coalesce(filed, 0) / nullif(coalesce(listed, 0), 0), 4) AS rate FROM (SELECT fy, count(DISTINCT stock_code) AS listed FROM universe GROUP BY 1) u FULL JOIN (SELECT fy, count(DISTINCT corp_code) AS filed FROM filings_index WHERE fy IS NOT NULL GROUP BY 1) f ON u.fy = f.fy")
def a06(spark, d):
    u = table(spark, d, "universe").groupBy("fy").agg(F.countDistinct("stock_code").alias("listed"))
    f = table(spark, d, "filings_index").where("fy is not null").groupBy("fy").agg(F.countDistinct("corp_code").alias("filed"))
    j = u.join(f, "fy", "full_outer").na.fill(0, ["listed", "filed"])
    return j.withColumn("rate", F.round(F.try_divide(F.col("filed"), F.col("listed")), 4))


@q("a07_flag_ratio", "SELECT fy, count(*) AS n, count(*) FILTER (WHERE is_correction) AS n_corrections, round(count(*) FILTER (WHERE is_correction) / count(*), 6) AS ratio FROM filings_index GROUP BY 1")
def a07(spark, d):
    return table(spark, d, "filings_index").groupBy("fy").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correction").alias("n_corrections")).withColumn("ratio", F.round(F.col("n_corrections") / F.col("n"), 6))


_LOGDIFF = f"(SELECT corp, sid, fy, ln(chars) - lag(ln(chars)) OVER (PARTITION BY corp, sid ORDER BY fy) AS d, fy - lag(fy) OVER (PARTITION BY corp, sid ORDER BY fy) AS gap FROM {_CHARS})"


def logdiff(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("corp", "sid").orderBy("fy")
    log = F.ln("chars")
    return section_chars(spark, d).select("corp", "sid", "fy", (log - F.lag(log).over(w)).alias("d"), (F.col("fy") - F.lag("fy").over(w)).alias("gap")).where("gap = 1")


@q("a09_cross_section", f"SELECT sid, fy, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d)), 6) AS lo, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(d)), 6) AS hi FROM {_LOGDIFF} WHERE gap = 1 GROUP BY ALL")
def a09(spark, d):
    return r6(Q.cross_section(logdiff(spark, d), ["sid", "fy"], "d"), "mean", "sd", "se", "lo", "hi")


_MEANS = f"(SELECT sid, fy, avg(d) AS m, avg((d > 0)::INT) AS up FROM {_LOGDIFF} WHERE gap = 1 GROUP BY ALL)"


def _means(spark, d):
    return logdiff(spark, d).groupBy("sid", "fy").agg(F.avg("d").alias("m"), Q.rate(F.col("d") > 0).alias("up"))


@q("a10_history_z", f"SELECT sid, fy, CASE WHEN stddev_samp(m) OVER w > 0 THEN round((m - avg(m) OVER w) / stddev_samp(m) OVER w, 5) ELSE 0 END AS z FROM {_MEANS} WINDOW w AS (PARTITION BY sid)")
def a10(spark, d):
    return Q.history_z(_means(spark, d), ["sid"], "m").select("sid", "fy", F.round("z", 5).alias("z"))


@q("a11_step_flags", f"SELECT sid, fy, round(up, 6) AS share_up, CASE WHEN up >= 0.75 THEN 'up' WHEN up <= 0.25 THEN 'down' ELSE 'none' END AS step FROM {_MEANS}")
def a11(spark, d):
    return _means(spark, d).select("sid", "fy", F.round("up", 6).alias("share_up"), Q.step_flags(F.col("up")).alias("step"))


@q("a12_spikes", f"SELECT sid, fy, count(d) AS n, round(avg(d), 6) AS mean, round(avg(dev), 6) AS demeaned, round(avg(dev / nullif(sd, 0)), 5) AS z, round(avg((dev > 1e-12)::INT), 6) AS share_positive FROM (SELECT *, d - avg(d) OVER (PARTITION BY corp) AS dev, stddev_samp(d) OVER (PARTITION BY corp) AS sd FROM {_LOGDIFF} WHERE gap = 1) GROUP BY ALL")
def a12(spark, d):
    g = Q.spikes(logdiff(spark, d), "corp", ["sid", "fy"], "d", above=1e-12)
    return r6(g.withColumn("z", F.round("z", 5)), "mean", "demeaned", "share_positive")


@q("a13_density", f"SELECT sid, round(avg(v), 6) AS mean, round(median(v), 6) AS median, CAST(sum(n_short) AS BIGINT) AS n_under_10, CAST(sum(n) AS BIGINT) AS n_paragraphs, round(sum(n_short) / sum(n), 6) AS share_under_10 FROM (SELECT sid, length(text) / len(paragraphs) AS v, len(paragraphs) AS n, len(list_filter(paragraphs, lambda p: length(p) < 10)) AS n_short FROM {SECTIONS} WHERE len(paragraphs) > 0 AND text IS NOT NULL) GROUP BY 1")
def a13(spark, d):
    """Characters per paragraph of each section, and the paragraphs under ten characters."""
    short = F.size(F.filter("paragraphs", lambda p: F.length(p) < 10))
    x = sections(spark, d).where("size(paragraphs) > 0 and text is not null").select("sid", (F.length("text") / F.size("paragraphs")).alias("v"), F.size("paragraphs").alias("n"), short.alias("n_short"))
    totals = x.groupBy("sid").agg(F.sum("n_short").alias("n_under_10"), F.sum("n").alias("n_paragraphs")).withColumn("share_under_10", F.col("n_under_10") / F.col("n_paragraphs"))
    return r6(Q.describe(x, ["sid"], "v").drop("n").join(totals, "sid"), "mean", "median", "share_under_10")


@q("a14_table_ratios", f"""WITH {_BLOCK_ROWS}, {_CAPTIONED}, u AS (SELECT DISTINCT rcept_no, caption FROM c WHERE caption IS NOT NULL), t AS (SELECT rcept_no, count(*) AS n_tables, count(caption) AS n_captioned FROM c GROUP BY 1),
 s AS (SELECT rcept_no, CAST(sum(length(text)) AS BIGINT) AS body_chars FROM {SECTIONS} GROUP BY 1), p AS (SELECT rcept_no, unnest(paragraphs) AS p FROM {SECTIONS}), o AS (SELECT p.rcept_no, CAST(sum(length(p)) AS BIGINT) AS orphan_chars FROM p JOIN u ON p.rcept_no = u.rcept_no AND p.p = u.caption GROUP BY 1)
 SELECT t.rcept_no, n_tables, n_captioned, round(n_captioned / n_tables, 4) AS share_captioned, coalesce(orphan_chars, 0) AS orphan_chars, body_chars, round(coalesce(orphan_chars, 0) / nullif(body_chars, 0), 5) AS share_orphan FROM t LEFT JOIN s USING (rcept_no) LEFT JOIN o USING (rcept_no)""")
def a14(spark, d):
    """Tables with a caption, and captions left in the text, of every filing with tables."""
    c = captioned(spark, d)
    s = sections(spark, d).withColumnRenamed("rcept_no", "doc")
    orphans = S.orphan_captions(s.select("doc", F.col("sid").alias("section_id"), "paragraphs"), c.withColumnRenamed("rcept_no", "doc")).groupBy("doc").agg(F.sum("orphan_chars").alias("orphan_chars"))
    return Q.table_ratios(c.withColumnRenamed("rcept_no", "doc"), orphans, s.groupBy("doc").agg(F.sum(F.length("text")).alias("body_chars"))).withColumnRenamed("doc", "rcept_no")


@q("a14_layout_ratios")
def a14_layout(spark, d):
    """Layout tables and their characters, by section."""
    t = sections(spark, d).select("sid", F.explode("tables_html").alias("h")).where("h is not null").select("sid", H.grids("h").alias("g"))
    return Q.layout_ratios(t.select("sid", H.is_layout(F.col("g")).alias("is_layout"), F.length(F.array_join(F.flatten("g"), " ")).alias("n_chars")), ["sid"])


#: Sections of both parse rules with their lines, exact names only, over blocks both engines normalise alike.
_VARIANTS = _SPANS + f""", t AS (SELECT * FROM (VALUES {_TARGET}) AS t(name, section_id)),
 body AS (SELECT 'new' AS variant, s.doc, t.section_id, s.start, s."end" FROM spans s JOIN t USING (name) UNION ALL SELECT 'old', o.doc, t.section_id, o.start, coalesce(o."end", 1000000000) FROM (SELECT doc, name, idx AS start, lead(idx) OVER (PARTITION BY doc ORDER BY idx) AS "end" FROM cand) o JOIN t USING (name)),
 scored AS (SELECT body.variant, body.doc, section_id, start, "end", sum(length(b.text)) AS score FROM body JOIN blocks b ON b.doc = body.doc AND b.idx > start AND b.idx < "end" GROUP BY ALL),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY variant, doc, section_id ORDER BY score DESC, start) = 1),
 lines AS (SELECT best.variant, best.doc, best.section_id, trim(b.text) AS p, list_filter(CASE WHEN best.section_id = 'S2' THEN {_LISTED['S2']} ELSE {_LISTED['default']} END, lambda m: contains(b.text, m)) AS hit FROM best JOIN blocks b ON b.doc = best.doc AND b.idx > start AND b.idx < "end" WHERE trim(b.text) <> ''),
 hits AS (SELECT variant, doc, section_id AS sid, sum(len(hit)) AS hits, round(coalesce(sum(length(p)) FILTER (WHERE len(hit) > 0), 0) / sum(length(p)), 4) AS share FROM lines GROUP BY ALL)"""


def _hits(spark, d, plain=True):
    """Marker hits and dirty share of every section under both parse rules."""
    exact = {"threshold": None, "old_threshold": None, "min_chars": 0} if plain else {}
    v = S.variants(block_sequence(spark, d, plain), **exact)
    p = v.select("variant", "doc", F.col("section_id").alias("sid"), F.explode("paragraphs").alias("p"))
    c = M.contamination(p, ["variant", "doc", "sid"], "p", M.markers_for(F.col("sid"), MARKERS))
    return c.select("variant", "doc", "sid", F.col("n_marker_hits").alias("hits"), F.col("share_chars").alias("share"))


@q("a15_hits_by_variant", _VARIANTS + " SELECT variant, sid, count(*) AS n, round(avg(hits), 6) AS mean, CAST(max(hits) AS BIGINT) AS most, count(*) FILTER (WHERE hits > 0) AS n_with, round(avg(share), 6) AS mean_share FROM hits GROUP BY ALL")
def a15(spark, d, plain=True):
    """Contamination under the old and the new parse rule."""
    return _hits(spark, d, plain).groupBy("variant", "sid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hits"), 6).alias("mean"), F.max("hits").cast("bigint").alias("most"), F.count_if(F.col("hits") > 0).alias("n_with"), F.round(F.avg("share"), 6).alias("mean_share"))


@q("a16_variant_pivot", _VARIANTS + " SELECT sid, round(avg(share) FILTER (WHERE variant = 'old'), 6) AS old, round(avg(share) FILTER (WHERE variant = 'new'), 6) AS new, round(avg(share) FILTER (WHERE variant = 'new') - avg(share) FILTER (WHERE variant = 'old'), 6) AS delta FROM hits GROUP BY 1")
def a16(spark, d, plain=True):
    p = _hits(spark, d, plain).groupBy("sid").pivot("variant", ["old", "new"]).agg(F.avg("share"))
    return r6(p.withColumn("delta", F.col("new") - F.col("old")), "old", "new", "delta")


@q("a17_counts_and_shares", "SELECT market, count(*) FILTER (WHERE is_correction) AS corrections, count(*) FILTER (WHERE is_correction IS NOT NULL AND NOT is_correction) AS others, round(count(*) / (SELECT count(*) FROM filings_index), 6) AS share FROM filings_index GROUP BY 1")
def a17(spark, d):
    from pyspark.sql import Window

    f = table(spark, d, "filings_index")
    p = f.groupBy("market").pivot("is_correction", [True, False]).count().na.fill(0, ["true", "false"])
    n = f.groupBy("market").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return n.join(p, n.market.eqNullSafe(p.market)).select(n.market, F.col("true").alias("corrections"), F.col("false").alias("others"), F.round(F.col("n") / F.sum("n").over(everything), 6).alias("share"))


@q("a18_dominance", "SELECT fy, source, n, round(n / sum(n) OVER (PARTITION BY fy), 6) AS share, n / sum(n) OVER (PARTITION BY fy) > 0.2 AS alert FROM (SELECT fy, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL)")
def a18(spark, d):
    return r6(Q.dominance(table(spark, d, "documents").where("source is not null"), ["fy"], "source", 0.2), "share")


@q("a19_top_reasons", f"SELECT coalesce(end_reason, 'null') AS reason, count(*) AS n FROM {SECTIONS} WHERE NOT coalesce(found, false) GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def a19(spark, d):
    return sections(spark, d).where(~F.coalesce("found", F.lit(False))).groupBy(F.coalesce("end_reason", F.lit("null")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@q("a20_gate", f"""WITH m AS (SELECT avg(coalesce(found, false)::INT) AS found_rate, avg(length(text)) FILTER (WHERE sid = 'S1') AS s1_mean_chars, CAST(NULL AS DOUBLE) AS pairing FROM {SECTIONS})
SELECT * FROM (SELECT 'found_rate' AS metric, round(found_rate, 6) AS value, 0.85::DOUBLE AS "limit", CASE WHEN found_rate >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m UNION ALL SELECT 's1_mean_chars', round(s1_mean_chars, 6), 5000.0, CASE WHEN s1_mean_chars >= 5000 THEN 'PASS' ELSE 'FAIL' END FROM m UNION ALL SELECT 'pairing', NULL, 0.9, 'undecided' FROM m)""")
def a20(spark, d):
    m = sections(spark, d).agg(Q.rate(F.col("found")).alias("found_rate"), F.avg(F.when(F.col("sid") == "S1", F.length("text"))).alias("s1_mean_chars"), F.lit(None).cast("double").alias("pairing"))
    return r6(Q.gate(m, {"found_rate": (">=", 0.85), "s1_mean_chars": (">=", 5000), "pairing": (">=", 0.9)}), "value")


@q("a21_first_by", "SELECT corp_name, rcept_no, market FROM filings_index WHERE corp_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corp_name ORDER BY rcept_no, coalesce(market, '')) = 1")
def a21(spark, d):
    f = table(spark, d, "filings_index").where("corp_name is not null").select("corp_name", "rcept_no", "market", F.coalesce("market", F.lit("")).alias("m"))
    return Q.first_by(f, ["corp_name"], ["rcept_no", "m"]).select("corp_name", "rcept_no", "market")


@q("a22_any_per_group", f"SELECT rcept_no, bool_or(coalesce(found, false)) AS any_found, bool_or(end_reason = 'EOF') AS any_eof FROM {SECTIONS} GROUP BY 1")
def a22(spark, d):
    return sections(spark, d).groupBy("rcept_no").agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("any_found"), F.bool_or(F.col("end_reason") == "EOF").alias("any_eof"))


for _name in ("a15_hits_by_variant", "a16_variant_pivot"):
    book.whole(f"{_name}_whole", _name)
queries, oracle_sql = book.queries, book.oracle_sql
