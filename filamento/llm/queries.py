"""Queries of the training-data problems kept in this subpackage, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamento.llm import leakage, level, markup, nearsets, packing, prose, residue, survivors
from filamento.plans.runtime import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "filings_index")).select("corp_code", "fy", "rcept_no")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every group with all its fields."""
    return survivors.survivors(table(spark, d, "filings_index"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = nearsets.similar_pairs(table(spark, d, "section_contents"), "section_key", "paragraphs")
    return nearsets.expanded(pairs, members, "section_key").distinct()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = nearsets.similar_pairs(table(spark, d, "section_contents"), "section_key", "paragraphs")
    return nearsets.groups(pairs, members, "section_key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sections, blocks = table(spark, d, "section_contents"), table(spark, d, "blocks")
    parts = [markup.found(sections, "section_key", "text", False, "text"), markup.found(sections, "section_key", "tables_html", True, "tables_html"), markup.found(blocks, "block_key", "html", True, "html")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    sections, blocks = table(spark, d, "section_contents"), table(spark, d, "blocks")
    parts = [markup.clean(sections, "section_key", "text", False, "text"), markup.clean(sections, "section_key", "tables_html", True, "tables_html"), markup.clean(blocks, "block_key", "html", True, "html")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases = residue.found(table(spark, d, "section_contents"), "section_key", "paragraphs", "text")
    return cases.select("section_key", F.col("para_no").cast("bigint").alias("para_no"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.cleaned(table(spark, d, "section_contents"), "section_key", "paragraphs", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections that are mostly no prose; those with residue, judged on all sections as in p6_found, are left out."""
    sections = table(spark, d, "section_contents")
    flagged = materialize(prose.not_prose(sections, "section_key", "paragraphs").select("section_key").distinct(), "no-prose")
    with_residue = residue.found(sections, "section_key", "paragraphs", "text")
    return flagged.join(with_residue.select("section_key"), "section_key", "left_anti")


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.quality(table(spark, d, "section_contents"), "section_key", "paragraphs").distinct()


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of space used, by spec."""
    placed, specs = p8_pack(spark, d), table(spark, d, "pack_specs")
    per = placed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    caps = specs.groupBy(F.col("spec_id").cast("bigint").alias("spec_id")).agg(F.max("capacity_tokens").alias("capacity"))
    return per.join(caps, "spec_id").select("spec_id", "capacity", "containers", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def p8_conserved(spark: SparkSession, d: str) -> DataFrame:
    """By spec: texts placed, and of them texts placed in part, texts split though they fit, containers overfull
    or overlapping, and tokens that are missing or placed twice."""
    docs, specs = table(spark, d, "documents"), table(spark, d, "pack_specs")
    tokens = materialize(packing.token_counts(docs), "pack-tokens")
    placed = materialize(packing.pack(tokens, specs), "pack-placed")
    caps = specs.groupBy(F.col("spec_id").cast("bigint").alias("spec_id")).agg(F.max("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0")
    per_doc = placed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("placed"))
    texts = per_doc.join(tokens, "doc_id").join(caps, "spec_id").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("placed") != F.col("n_tokens")).alias("n_in_part"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("n_split_fitting"), F.sum(F.abs(F.col("placed") - F.col("n_tokens"))).alias("n_lost_tokens"))
    # pieces of a container follow one another without a gap, so their sum is where the last one ends
    boxes = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("at_token") + F.col("n_tokens")).alias("end")).join(caps, "spec_id")
    bad = boxes.groupBy("spec_id").agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("used") != F.col("end"))).alias("n_bad_containers"))
    return caps.select("spec_id").join(texts, "spec_id", "left").join(bad, "spec_id", "left").na.fill(0)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("run > 0").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where(f"run > 0 or (common_share >= {leakage.SHARE} and answer_kept)")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return level.levels(table(spark, d, "documents"), table(spark, d, "level_labels")).where(f"level = {level.LEVELS}").select("doc_id").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return level.levels(table(spark, d, "documents"), table(spark, d, "level_labels")).distinct()


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


#: Letters and digits after folding full-width forms, the only characters of these tables NFKC changes.
_WIDE, _PLAIN = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_LETTERS = f"regexp_replace(lower(translate(text, '{_WIDE}', '{_PLAIN}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


#: Filings with their groups, places and counts.
_FILINGS = """
WITH r AS (SELECT trim(rcept_no) AS rno, regexp_replace(corp_code,'[^0-9]','','g') AS c, regexp_replace(stock_code,'[^0-9]','','g') AS s, fy, is_correction AS flag,
  replace(translate(regexp_replace(report_nm,'[\\s　]','','g'),'（）［］／．','()[]/.'),' ','') AS nm, regexp_replace(rcept_dt,'[^0-9]','','g') AS dt, period_month, collected_at, nullif(trim(report_nm),'') AS a1, nullif(trim(rcept_time),'') AS a2, nullif(trim(orig_rcept_no),'') AS a3, nullif(trim(flr_nm),'') AS a4, nullif(trim(corp_name),'') AS b1, nullif(trim(market),'') AS b2 FROM filings_index WHERE rcept_no IS NOT NULL),
n AS (SELECT rno, period_month, collected_at, a1, a2, a3, a4, b1, b2, CASE WHEN length(c)>0 THEN lpad(c,8,'0') END AS corp, CASE WHEN length(s)>0 THEN lpad(s,6,'0') END AS stock, fy, flag,
  regexp_extract(nm,'^((\\[[^\\]]*\\])+)',1) AS br, regexp_replace(nm,'^(\\[[^\\]]*\\])+','') AS bare, nm IS NULL AS noname, CASE WHEN length(dt)>=8 THEN substr(dt,1,8) END AS day FROM r),
k AS (SELECT *, CASE WHEN br='' OR br IS NULL THEN NULL WHEN contains(br,'첨부') THEN 1 ELSE 2 END AS kind, TRY_CAST(nullif(regexp_extract(bare,'\\(([12][0-9]{3})[./-]?[0-9]{0,2}\\)',1),'') AS BIGINT) AS py,
  CASE WHEN NOT noname THEN regexp_matches(bare,'^사업보고서(\\(|$)') END AS annual FROM n),
o AS (SELECT rno, count(*) AS cnt, max(period_month) AS period_month, max(corp) AS corp, max(stock) AS stock, coalesce(max(py),max(fy)) AS y, coalesce(bool_or(annual),true) AS annual,
  coalesce(max(kind), CASE WHEN bool_or(coalesce(flag,false)) THEN 2 ELSE 0 END) AS kind, coalesce(min(day), substr(rno,1,8)) AS day FROM k GROUP BY rno),
m AS (SELECT stock, corp AS mc FROM (SELECT stock, corp, row_number() OVER (PARTITION BY stock ORDER BY count(*) DESC, corp) AS rn FROM o WHERE stock IS NOT NULL AND corp IS NOT NULL GROUP BY stock, corp) WHERE rn=1),
x AS (SELECT rno, a1, a2, a3, a4, row_number() OVER (PARTITION BY rno ORDER BY (a1 IS NOT NULL)::INT+(a2 IS NOT NULL)::INT+(a3 IS NOT NULL)::INT+(a4 IS NOT NULL)::INT DESC, collected_at DESC NULLS LAST, a1 DESC NULLS LAST, a2 DESC NULLS LAST, a3 DESC NULLS LAST, a4 DESC NULLS LAST) AS rn FROM k),
z AS (SELECT rno, b1, b2, row_number() OVER (PARTITION BY rno ORDER BY (b1 IS NOT NULL)::INT+(b2 IS NOT NULL)::INT DESC, collected_at DESC NULLS LAST, b1 DESC NULLS LAST, b2 DESC NULLS LAST) AS rn FROM k),
f AS (SELECT coalesce(o.corp, m.mc) AS corp_code, CAST(y AS BIGINT) AS fy, o.rno AS rcept_no, kind, day, cnt, o.stock, period_month, a1 AS report_nm, a2 AS rcept_time, a3 AS orig_rcept_no, a4 AS flr_nm, b1 AS corp_name, b2 AS market FROM o LEFT JOIN m USING (stock) JOIN x ON x.rno=o.rno AND x.rn=1 JOIN z ON z.rno=o.rno AND z.rn=1 WHERE annual),
g AS (SELECT *, row_number() OVER (PARTITION BY corp_code, fy ORDER BY kind, day, rcept_no) AS rn, sum(cnt) OVER (PARTITION BY corp_code, fy)::BIGINT AS tot, bool_or(kind=2) OVER (PARTITION BY corp_code, fy) AS corrected FROM f WHERE corp_code IS NOT NULL AND fy IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_conserved": """
SELECT CAST(spec_id AS BIGINT) AS spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS n_docs, 0 AS n_in_part, 0 AS n_split_fitting, 0 AS n_lost_tokens, 0 AS n_bad_containers
FROM pack_specs WHERE capacity_tokens > 0 AND spec_id IS NOT NULL GROUP BY 1""",
        "p9_found": f"""
WITH d AS (SELECT doc_id, {_LETTERS} AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), e AS (SELECT item_id, {_LETTERS} AS x FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(x) - 38), lambda i: substr(x, i, 40))) AS g FROM e), h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(x) - 38), lambda i: substr(x, i, 40))) AS g FROM d)
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
        "p4_found": """
WITH s AS (SELECT section_key, list_filter(any_value(paragraphs), lambda x: x IS NOT NULL) AS p FROM section_contents WHERE section_key IS NOT NULL GROUP BY 1),
t AS (SELECT section_key, regexp_replace(unnest(p), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') AS t FROM s WHERE list_sum(list_transform(p, lambda x: length(x))) >= 300),
g AS (SELECT DISTINCT section_key, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM t), n AS (SELECT section_key, count(*) AS n FROM g GROUP BY 1),
x AS (SELECT a.section_key AS a, b.section_key AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.section_key < b.section_key GROUP BY ALL)
SELECT a AS section_key_a, b AS section_key_b FROM x JOIN n na ON na.section_key = a JOIN n nb ON nb.section_key = b WHERE c >= 0.7 * (na.n + nb.n - c)""",
        "p1_found": _FILINGS + """
SELECT corp_code, fy, rcept_no FROM g WHERE rn=1 AND tot>=2""",
        "p1_survivors": _FILINGS + """
, s AS (SELECT * FROM g WHERE rn=1 AND tot>=2),
firm AS (SELECT corp_code, fy, stock, corp_name, market, (stock IS NOT NULL)::INT+(corp_name IS NOT NULL)::INT+(market IS NOT NULL)::INT+sum(cnt)/(any_value(tot)+1) AS t FROM g GROUP BY corp_code, fy, stock, corp_name, market),
bf AS (SELECT s.corp_code, s.fy, firm.stock, firm.corp_name, firm.market, row_number() OVER (PARTITION BY s.corp_code, s.fy ORDER BY t DESC, firm.stock NULLS LAST, firm.corp_name NULLS LAST, firm.market NULLS LAST) AS rn FROM s JOIN firm ON firm.corp_code=s.corp_code AND firm.fy=s.fy AND (s.stock IS NULL OR firm.stock IS NULL OR firm.stock=s.stock)),
month AS (SELECT corp_code, fy, period_month, sum(cnt) AS n FROM g WHERE period_month IS NOT NULL GROUP BY ALL),
bm AS (SELECT s.corp_code, s.fy, month.period_month, row_number() OVER (PARTITION BY s.corp_code, s.fy ORDER BY n DESC, month.period_month) AS rn FROM s JOIN month ON month.corp_code=s.corp_code AND month.fy=s.fy AND (s.period_month IS NULL OR s.period_month=month.period_month))
SELECT s.corp_code, s.fy, s.tot AS n, s.corrected, s.rcept_no, s.day AS rcept_dt, s.report_nm, s.rcept_time, s.orig_rcept_no, s.flr_nm, bf.stock AS stock_code, bf.corp_name, bf.market, s.kind=2 AS is_correction, bm.period_month
FROM s JOIN bf ON bf.corp_code=s.corp_code AND bf.fy=s.fy AND bf.rn=1 LEFT JOIN bm ON bm.corp_code=s.corp_code AND bm.fy=s.fy AND bm.rn=1"""
    }
