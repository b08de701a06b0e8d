"""Similarity and near-duplicate queries (M rows of the survey, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.functions.codes import corp_code
from filamento.operators import similarity as M
from filamento.plans.base import Book
from filamento.plans.q_text import _ARTIFACTS, _CLASS_SQL, _STRIP
from filamento.plans.runtime import materialize, table

book = Book()
q = book.query

_CORP = "lpad(regexp_replace(corp_code, '[^0-9]', '', 'g'), 8, '0')"
#: One text per firm, section and year: the greatest delivered.
DOCS = f"(SELECT {_CORP} AS corp, upper(section_id) AS sid, fy, max(text) AS text FROM section_contents WHERE corp_code IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"
PAIRS = f"(SELECT corp, sid, lag(fy) OVER (PARTITION BY corp, sid ORDER BY fy) AS prev, fy AS cur, lag(text) OVER (PARTITION BY corp, sid ORDER BY fy) AS a, text AS b FROM {DOCS})"
ASCII = "regexp_replace({}, '[^ -~]', '', 'g')"


def docs(spark, d):
    s = table(spark, d, "section_contents").where("corp_code is not null and text is not null")
    return s.groupBy(corp_code(F.col("corp_code")).alias("corp"), F.upper("section_id").alias("sid"), "fy").agg(F.max("text").alias("text"))


def _pairs(spark, d):
    x = docs(spark, d)
    at = lambda p, t: x.select("corp", "sid", F.col("fy").alias(p), F.col("text").alias(t))
    return M.adjacent(x, ["corp", "sid"], "fy").join(at("prev", "a"), ["corp", "sid", "prev"]).join(at("cur", "b"), ["corp", "sid", "cur"])


@q("m01_tfidf_cosine", f"""WITH x AS (SELECT corp, sid, fy, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM {DOCS}), tf AS (SELECT corp, sid, fy, gram, count(*) AS tf FROM (SELECT corp, sid, fy, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS gram FROM x) GROUP BY ALL),
 n AS (SELECT sid, count(*) AS n FROM x GROUP BY 1), idf AS (SELECT sid, gram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN n USING (sid) GROUP BY ALL), w AS (SELECT corp, sid, fy, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (sid, gram)),
 u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY corp, sid, fy)) AS v FROM w), p AS (SELECT corp, sid, lag(fy) OVER (PARTITION BY corp, sid ORDER BY fy) AS prev, fy AS cur FROM x)
 SELECT p.corp, p.sid, p.prev, p.cur, round(coalesce(sum(a.v * b.v), 0), 6) AS cosine FROM p LEFT JOIN u a ON a.corp = p.corp AND a.sid = p.sid AND a.fy = p.prev LEFT JOIN u b ON b.corp = p.corp AND b.sid = p.sid AND b.fy = p.cur AND b.gram = a.gram WHERE p.prev IS NOT NULL GROUP BY ALL""")
def m01(spark, d):
    out = M.tfidf_cosine(docs(spark, d), entity="corp", section="sid", period="fy", text="text")
    return out.select("corp", "sid", "prev", "cur", F.round("cosine", 6).alias("cosine"))


_W = "list_distinct(list_filter(regexp_split_to_array({}, '[ \\n\\t\\r]+'), lambda x: x <> ''))"


@q("m02_jaccard", f"SELECT corp, sid, prev, cur, round(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 6) AS jaccard FROM (SELECT corp, sid, prev, cur, {_W.format('a')} AS x, {_W.format('b')} AS y FROM {PAIRS} WHERE prev IS NOT NULL)")
def m02(spark, d):
    w = lambda c: F.array_distinct(F.filter(F.split(c, "[ \\n\\t\\r]+"), lambda x: x != ""))
    return _pairs(spark, d).select("corp", "sid", "prev", "cur", F.round(M.jaccard(w("a"), w("b")), 6).alias("jaccard"))


@q("m03_levenshtein", f"SELECT corp, sid, prev, cur, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS sim FROM (SELECT corp, sid, prev, cur, {ASCII.format('a')} AS x, {ASCII.format('b')} AS y FROM {PAIRS} WHERE prev IS NOT NULL)")
def m03(spark, d, plain=True):
    ascii_ = lambda c: F.regexp_replace(c, "[^ -~]", "") if plain else F.col(c)
    return _pairs(spark, d).select("corp", "sid", "prev", "cur", F.round(M.levenshtein_similarity(ascii_("a"), ascii_("b")), 6).alias("sim"))


@q("m04_difflib_ratio")
def m04(spark, d):
    return _pairs(spark, d).select("corp", "sid", "prev", "cur", F.round(M.difflib_ratio("a", "b"), 6).alias("ratio"))


@q("m05_paragraph_diff")
def m05(spark, d):
    p = _pairs(spark, d)
    diff = M.paragraph_diff(X.paragraphs(F.col("a")), X.paragraphs(F.col("b")))
    return p.select("corp", "sid", "prev", "cur", diff.alias("x")).select("corp", "sid", "prev", "cur", "x.*", (F.size("x.added") + F.size("x.modified")).alias("n_changed"))


#: Masked paragraphs of 30 or more characters per firm, section and year.
PARAS = f"(SELECT DISTINCT {_CORP} AS corp, upper(section_id) AS sid, fy, regexp_replace(p, '[0-9][0-9,.]*', '<NUM>', 'g') AS p FROM (SELECT corp_code, section_id, fy, unnest(paragraphs) AS p FROM section_contents WHERE corp_code IS NOT NULL) WHERE length(p) >= 30 AND regexp_matches(p, '^[ -~가-힣]*$'))"
ADDED = f"changed AS (SELECT n.* FROM paras n WHERE EXISTS (SELECT 1 FROM paras o WHERE o.corp = n.corp AND o.sid = n.sid AND o.fy = n.fy - 1) AND NOT EXISTS (SELECT 1 FROM paras o WHERE o.corp = n.corp AND o.sid = n.sid AND o.fy = n.fy - 1 AND o.p = n.p))"


def paras(spark, d, plain=True):
    """``plain``: only those of characters both engines mask alike, for the queries with SQL."""
    s = table(spark, d, "section_contents").where("corp_code is not null").select(corp_code(F.col("corp_code")).alias("corp"), F.upper("section_id").alias("sid"), "fy", F.explode("paragraphs").alias("p"))
    return s.where((F.length("p") >= 30) & (F.col("p").rlike("^[ -~가-힣]*$") | F.lit(not plain))).withColumn("p", X.mask_numbers(F.col("p"))).distinct()


def repeated(spark, d, plain=True):
    """The changed paragraphs as often as their sections hold them."""
    s = table(spark, d, "section_contents").where("corp_code is not null").select("section_key", corp_code(F.col("corp_code")).alias("corp"), F.upper("section_id").alias("sid"), "fy", "paragraphs").distinct()
    p = s.select("corp", "sid", "fy", F.explode("paragraphs").alias("p"))
    p = p.where((F.length("p") >= 30) & (F.col("p").rlike("^[ -~가-힣]*$") | F.lit(not plain))).withColumn("p", X.mask_numbers(F.col("p")))
    return p.join(changed(spark, d, plain=plain), ["corp", "sid", "fy", "p"], "left_semi")


def classes(spark, d, plain=True, threshold=0.8, clean=False):
    """Text classes of the changed paragraphs, without those that hold a marker where ``clean``."""
    rows = repeated(spark, d, plain)
    if clean:
        rows = rows.where(~F.exists(M.markers_for(F.col("sid"), MARKERS), lambda m: F.contains(F.col("p"), m)))
    return M.TextClasses(rows, entity="corp", scope=["sid", "fy"], text="p", threshold=threshold)


def changed(spark, d, removed=False, plain=True):
    return M.set_changes(paras(spark, d, plain), entity="corp", section="sid", period="fy", text="p", removed=removed)


@q("m06_set_changes", f"WITH paras AS {PARAS}, {ADDED} SELECT corp, sid, fy, p FROM changed")
def m06(spark, d, plain=True):
    return changed(spark, d, plain=plain)


@q("m06_set_removals", f"WITH paras AS {PARAS} SELECT o.corp, o.sid, o.fy + 1 AS fy, o.p FROM paras o WHERE EXISTS (SELECT 1 FROM paras n WHERE n.corp = o.corp AND n.sid = o.sid AND n.fy = o.fy + 1) AND NOT EXISTS (SELECT 1 FROM paras n WHERE n.corp = o.corp AND n.sid = o.sid AND n.fy = o.fy + 1 AND n.p = o.p)")
def m06_removed(spark, d, plain=True):
    return changed(spark, d, True, plain)


_G = "g AS (SELECT corp, sid, fy, p, list_distinct(CASE WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END) AS gr FROM (SELECT *, replace(p, ' ', '') AS s FROM {}))"
_COMMON = f"WITH paras AS {PARAS}, {ADDED}, {_G.format('changed')}, pairs AS (SELECT x.sid, x.fy, x.corp AS a_entity, y.corp AS b_entity, x.p AS a, y.p AS b, len(list_intersect(x.gr, y.gr)) / len(list_distinct(list_concat(x.gr, y.gr))) AS sim FROM g x JOIN g y ON x.sid = y.sid AND x.fy = y.fy AND x.corp < y.corp)"


def common(spark, d, plain=True):
    return M.common_paragraphs(changed(spark, d, plain=plain), entity="corp", scope=["sid", "fy"], text="p")


@q("m07_near_duplicate_pairs", _COMMON + " SELECT sid, fy, a_entity, b_entity, a, b, round(sim, 6) AS similarity FROM pairs WHERE sim >= 0.8 - 1e-12")
def m07(spark, d, plain=True):
    return common(spark, d, plain).withColumn("similarity", F.round("similarity", 6))


@q("m08_change_rates")
def m08(spark, d):
    return M.change_rates(docs(spark, d), entity="corp", section="sid", period="fy", text="text")


@q("m09_common_paragraphs", _COMMON + " SELECT sid, fy, count(*) AS n_pairs, (SELECT count(DISTINCT e) FROM (SELECT sid AS s, fy AS f, a_entity AS e FROM pairs WHERE sim >= 0.8 - 1e-12 UNION SELECT sid, fy, b_entity FROM pairs WHERE sim >= 0.8 - 1e-12) WHERE s = p.sid AND f = p.fy) AS n_corps FROM pairs p WHERE sim >= 0.8 - 1e-12 GROUP BY sid, fy")
def m09(spark, d, plain=True):
    c = classes(spark, d, plain)
    who = c.appearances().groupBy("sid", "fy").agg(F.count(F.lit(1)).alias("n_corps"))
    return c.pairs().groupBy("sid", "fy").agg(F.sum("n_pairs").alias("n_pairs")).join(who, ["sid", "fy"])


@q("m09_stored_pairs", _COMMON + " SELECT sid, fy, a_entity, b_entity, a, b, round(sim, 6) AS similarity FROM pairs WHERE sim >= 0.8 - 1e-12 QUALIFY row_number() OVER (PARTITION BY sid, fy ORDER BY sim DESC, least(a, b), greatest(a, b), a_entity, b_entity, a) <= 500")
def m09_stored(spark, d, plain=True):
    """The 500 most similar pairs of every section and year."""
    return classes(spark, d, plain).top(500).withColumn("similarity", F.round("similarity", 6))


#: Words of the test tables that stand for notes to accounts, by section, with the fixed ones.
MARKERS = {"default": ("감사지원팀", "재고자산", "차입금", *M.MARKERS["default"]), "S2": ("감사지원팀", "차입금", *M.MARKERS["S2"])}
_LISTED = {k: "['" + "', '".join(v) + "']" for k, v in MARKERS.items()}
_MARKERS_SQL = f"CASE WHEN sid = 'S2' THEN {_LISTED['S2']} ELSE {_LISTED['default']} END"
_DIRTY = f"len(list_filter({_MARKERS_SQL}, lambda m: contains({{}}, m))) > 0"
_RAW = f"raw AS (SELECT {_CORP} AS corp, upper(section_id) AS sid, fy, regexp_replace(p, '[0-9][0-9,.]*', '<NUM>', 'g') AS p FROM (SELECT corp_code, section_id, fy, unnest(paragraphs) AS p FROM (SELECT DISTINCT section_key, corp_code, section_id, fy, paragraphs FROM section_contents) WHERE corp_code IS NOT NULL) WHERE length(p) >= 30 AND regexp_matches(p, '^[ -~가-힣]*$')), w AS (SELECT corp, sid, fy, p, count(*) AS w FROM raw GROUP BY ALL)"


@q("m10_recounted_pairs", _COMMON + f", {_RAW} SELECT x.sid, x.fy, CAST(sum(wa.w * wb.w) AS BIGINT) AS n_raw, count(*) AS n_pairs, count(*) FILTER (WHERE NOT ({_DIRTY.format('a').replace('sid', 'x.sid')}) AND NOT ({_DIRTY.format('b').replace('sid', 'x.sid')})) AS n_clean, round(1 - count(*) / sum(wa.w * wb.w), 6) AS reduction FROM pairs x JOIN w wa ON wa.corp = x.a_entity AND wa.sid = x.sid AND wa.fy = x.fy AND wa.p = x.a JOIN w wb ON wb.corp = x.b_entity AND wb.sid = x.sid AND wb.fy = x.fy AND wb.p = x.b WHERE sim >= 0.8 - 1e-12 GROUP BY x.sid, x.fy")
def m10(spark, d, plain=True):
    """Pairs with repeated paragraphs counted each time, once, and once without those that hold a marker."""
    has = lambda c: F.exists(M.markers_for(F.col("sid"), MARKERS), lambda m: F.contains(F.col(c), m))
    g = classes(spark, d, plain).pairs().groupBy("sid", "fy").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_pairs").alias("n_pairs"), F.sum(F.when(~has("a") & ~has("b"), F.col("n_pairs")).otherwise(0)).alias("n_clean"))
    return g.withColumn("reduction", F.round(1 - F.col("n_pairs") / F.col("n_raw"), 6))


@q("m10_firm_appearances", _COMMON + " SELECT sid, fy, entity, count(*) AS n_appearances, round(count(*) / sum(count(*)) OVER (PARTITION BY sid, fy), 4) AS share FROM (SELECT sid, fy, a_entity AS entity FROM pairs WHERE sim >= 0.8 - 1e-12 UNION ALL SELECT sid, fy, b_entity FROM pairs WHERE sim >= 0.8 - 1e-12) GROUP BY sid, fy, entity")
def m10_firms(spark, d, plain=True):
    return classes(spark, d, plain).appearances().withColumn("share", F.round("share", 4))


@q("m11_pair_taxonomy", _COMMON + f" SELECT sid, {_CLASS_SQL.format('a')} AS label, count(*) AS n FROM pairs WHERE sim >= 0.8 - 1e-12 AND NOT ({_DIRTY.format('a')}) AND NOT ({_DIRTY.format('b')}) GROUP BY ALL")
def m11(spark, d, plain=True):
    """Clean pairs by what their first paragraph is."""
    return classes(spark, d, plain, clean=True).labelled(X.paragraph_class(F.col("text"))).groupBy("sid", "label").agg(F.sum("n").alias("n"))


@q("m12_partner_counts", _COMMON + " SELECT sid, fy, entity, text, count(DISTINCT other) AS n_partners FROM (SELECT sid, fy, a_entity AS entity, a AS text, b_entity AS other FROM pairs WHERE sim >= 0.8 - 1e-12 UNION ALL SELECT sid, fy, b_entity, b, a_entity FROM pairs WHERE sim >= 0.8 - 1e-12) GROUP BY ALL")
def m12(spark, d, plain=True):
    return classes(spark, d, plain).partners()


book.sql["j09_cross_group_pairs"] = _COMMON + " SELECT fy, count(*) AS n FROM pairs WHERE sim >= 0.9 - 1e-12 GROUP BY 1"


@q("j09_cross_group_pairs")
def j09(spark, d, plain=True):
    return classes(spark, d, plain, threshold=0.9).pairs().groupBy("fy").agg(F.sum("n_pairs").alias("n"))


_CLEANED = lambda c: _STRIP.format("regexp_replace(" + _ARTIFACTS.format(c) + ", ' {2,}', ' ', 'g')")


@q("m13_artifact_impact", f"""WITH l AS (SELECT sid, cur, 'before' AS variant, {_W.format('a')} AS x, {_W.format('b')} AS y FROM {PAIRS} WHERE prev IS NOT NULL UNION ALL SELECT sid, cur, 'after', {_W.format(_CLEANED('a'))}, {_W.format(_CLEANED('b'))} FROM {PAIRS} WHERE prev IS NOT NULL),
 s AS (SELECT sid, cur, variant, avg(1 - len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0)) AS change FROM l GROUP BY ALL) SELECT sid, cur, round(max(change) FILTER (WHERE variant = 'before'), 6) AS before, round(max(change) FILTER (WHERE variant = 'after'), 6) AS after, round(max(change) FILTER (WHERE variant = 'after') - max(change) FILTER (WHERE variant = 'before'), 6) AS delta FROM s GROUP BY ALL""")
def m13(spark, d):
    """Mean change of word sets with and without editor residue; the other measures are in m13_artifact_impact_whole."""
    p = _pairs(spark, d)
    w = lambda c: F.array_distinct(F.filter(F.split(c, "[ \\n\\t\\r]+"), lambda x: x != ""))
    change = lambda f: F.avg(1 - M.jaccard(w(f(F.col("a"))), w(f(F.col("b")))))
    g = p.groupBy("sid", "cur").agg(change(lambda c: c).alias("before"), change(X.strip_artifacts).alias("after"))
    return g.select("sid", "cur", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


@q("m13_artifact_impact_whole")
def m13_whole(spark, d):
    """All four measures of change before and after editor residue is stripped."""
    x = materialize(docs(spark, d).withColumn("clean", X.strip_artifacts(F.col("text"))), "docs")
    rates = M.cleaned_change_rates(x, entity="corp", section="sid", period="fy", text="text", clean="clean")
    both = rates.groupBy("sid", "prev", "cur").agg(*[F.avg(f"{m}_{v}").alias(f"{m}_{v}") for m in M.MEASURES for v in ("before", "after")])
    return both.select("sid", "prev", "cur", *[F.round(f"{m}_{v}", 4).alias(f"{m}_{v}") for m in M.MEASURES for v in ("before", "after")], *[F.round(F.col(f"{m}_after") - F.col(f"{m}_before"), 4).alias(f"delta_{m}") for m in M.MEASURES])


_PROTECTED = "regexp_replace(text, '&(cr[A-Za-z0-9])', chr(1) || '\\1', 'gi')"
_KINDS = (("label", "text", "◆\\s*click\\s*◆\\s*(?:『[^』]{0,60}』)?\\s*(?:삽입|추가)?"), ("file", "text", "\\d{4,6}\\s*#\\s*\\*?\\s*_\\S+?\\.dsl"), ("entity", _PROTECTED, "&cr;?"))
_EACH = " UNION ALL ".join(f"SELECT sid, length(text) AS chars, '{k}' AS artifact, len(regexp_extract_all({c}, '{p}', 0, 'i')) AS n, length(text) - length(regexp_replace({c}, '{p}', '', 'gi')) AS cut FROM {DOCS}" for k, c, p in _KINDS)


@q("m14_artifact_coverage", f"""SELECT sid, artifact, count(*) AS n_units, count(*) FILTER (WHERE n > 0) AS n_hit, round(count(*) FILTER (WHERE n > 0) / count(*), 4) AS coverage, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(cut) AS BIGINT) AS removed_chars, round(avg(cut) FILTER (WHERE n > 0), 1) AS mean_per_hit, round(sum(cut) / nullif(sum(chars), 0), 6) AS share FROM ({_EACH}) GROUP BY ALL""")
def m14(spark, d):
    return M.artifact_coverage(docs(spark, d), ["sid"], "text")


@q("m15_exact_names", "WITH k AS (SELECT DISTINCT name AS choice, upper(regexp_replace(name, '[\\s.,\\-_()\\[\\]<>·ㆍ''\"]+', '', 'g')) AS c FROM universe WHERE name IS NOT NULL) SELECT f.corp_name AS name, min(k.choice) AS choice FROM (SELECT DISTINCT corp_name, upper(regexp_replace(corp_name, '[\\s.,\\-_()\\[\\]<>·ㆍ''\"]+', '', 'g')) AS c FROM filings_index WHERE corp_name IS NOT NULL) f JOIN k USING (c) GROUP BY 1")
def m15(spark, d):
    return _matches(spark, d).where("match_type = 'exact'").select("name", "choice")


def _matches(spark, d):
    names = table(spark, d, "filings_index").select(F.col("corp_name").alias("name")).where("name is not null").distinct().withColumn("key", F.col("name"))
    choices = table(spark, d, "universe").select(F.col("name").alias("choice")).where("choice is not null").distinct()
    return M.match_names(names, choices, key="key", name="name", choice="choice")


@q("m15_matched_names")
def m15_matched(spark, d):
    """Every name of the filings index with its listing, exact or misspelt."""
    return _matches(spark, d).select("name", "choice", "match_type", "score")


@q("m15_fuzzy_names")
def m15_fuzzy(spark, d):
    """Names with a legal form or a spelling of their own, matched to the universe's."""
    listed = table(spark, d, "universe").select(F.col("name").alias("choice")).where("choice is not null").distinct()
    bent = listed.select(F.concat(F.lit("주식회사 "), F.col("choice"), F.lit("홀딩스사업본부")).alias("long"), F.concat(F.col("choice"), F.lit("홀딩스사업본무")).alias("name"))
    return M.match_names(bent.withColumn("key", F.col("name")), bent.select(F.col("long").alias("choice")), key="key", name="name", choice="choice", threshold=88.0)


@q("m16_contamination", f"""WITH p AS (SELECT section_key, sid, p, length(p) AS n, {_MARKERS_SQL} AS used, list_filter({_MARKERS_SQL}, lambda m: contains(p, m)) AS hit FROM (SELECT section_key, sid, unnest(paragraphs) AS p FROM (SELECT DISTINCT section_key, upper(section_id) AS sid, paragraphs FROM section_contents)) WHERE p IS NOT NULL)
 SELECT section_key, max(len(used)) AS n_markers_used, CAST(sum(len(hit)) AS BIGINT) AS n_marker_hits, len(list_distinct(flatten(list(hit)))) AS n_distinct_markers, coalesce(array_to_string(list_sort(list_distinct(flatten(list(hit)))), ', '), '') AS markers_found, count(*) FILTER (WHERE len(hit) > 0) AS n_dirty, CAST(coalesce(sum(n) FILTER (WHERE len(hit) > 0), 0) AS BIGINT) AS dirty_chars, CAST(sum(n) AS BIGINT) AS total_chars, CASE WHEN sum(n) = 0 THEN 0 ELSE round(coalesce(sum(n) FILTER (WHERE len(hit) > 0), 0) / sum(n), 4) END AS share_chars, round(count(*) FILTER (WHERE len(hit) > 0) / count(*), 4) AS share_paras FROM p GROUP BY 1""")
def m16(spark, d):
    s = table(spark, d, "section_contents").select("section_key", F.upper("section_id").alias("sid"), "paragraphs").distinct()
    p = s.select("section_key", "sid", F.explode("paragraphs").alias("p")).where("p is not null")
    return M.contamination(p, ["section_key"], "p", M.markers_for(F.col("sid"), MARKERS))


for _name in ("m03_levenshtein", "m06_set_changes", "m06_set_removals", "m07_near_duplicate_pairs", "m09_common_paragraphs", "m09_stored_pairs", "m10_recounted_pairs", "m10_firm_appearances", "m11_pair_taxonomy", "m12_partner_counts", "j09_cross_group_pairs"):
    book.whole(f"{_name}_whole", _name)
queries, oracle_sql = book.queries, book.oracle_sql
