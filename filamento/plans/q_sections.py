"""Document and table structure queries (D rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.operators import html as H
from filamento.operators import sections as S
from filamento.operators import tables as TB
from filamento.plans.base import Book
from filamento.plans.q_text import _ARTIFACTS, _NUM_RE
from filamento.plans.runtime import table
from filamento.sources import synthetic

book = Book()
q = book.query
#: What both engines normalise alike. Only queries compared with SQL keep to it (``plain``); each has a _whole one over all blocks.
PLAIN = "^[ -~가-힣]+$"

_BLOCKS = f"""s AS (SELECT DISTINCT section_key, rcept_no, upper(section_id) AS sid, start_header, paragraphs FROM section_contents),
raw AS (SELECT rcept_no AS doc, sid, section_key, 0 AS pos, start_header AS text FROM s UNION ALL SELECT rcept_no, sid, section_key, i, paragraphs[i] FROM s, range(1, 400) t(i) WHERE i <= len(paragraphs)),
blocks AS (SELECT doc, 'text' AS kind, text, row_number() OVER (PARTITION BY doc ORDER BY sid, section_key, pos) - 1 AS idx FROM raw WHERE text IS NOT NULL AND regexp_matches(text, '{PLAIN}'))"""
_KEY = f"lower(regexp_replace(regexp_replace(regexp_replace(trim(text), '{_NUM_RE}', ''), '{_NUM_RE}', ''), '[\\s·ㆍ・･.,:;\\-—–_()\\[\\]{{}}<>「」『』\"''’‘“”/|]+', '', 'g'))"
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in S.KEYS.items())
_STYLE = "CASE WHEN regexp_matches(text, '^\\s*[(\\[<]?\\s*[IVXLivxl]{1,7}\\s*[)\\]>.\\-–—:]') THEN 'roman' WHEN regexp_matches(text, '^\\s*[(\\[<]?\\s*[0-9]{1,2}\\s*[)\\]>.\\-–—:]') THEN 'arabic' ELSE 'none' END"
_CANDIDATES = f"WITH {_BLOCKS}, names AS (SELECT * FROM (VALUES {_NAMES}) AS t(key, name)), cand AS (SELECT doc, idx, name, text, {_STYLE} AS style FROM (SELECT *, {_KEY} AS key FROM blocks WHERE length(text) <= 60) JOIN names USING (key) WHERE length(key) >= 3)"
_SPANS = (
    _CANDIDATES
    + """, n AS (SELECT doc, max(idx) + 1 AS n FROM blocks GROUP BY 1), r AS (SELECT *, count(*) FILTER (WHERE style = 'roman') OVER (PARTITION BY doc) AS romans FROM cand),
spans AS (SELECT r.doc, r.name, r.idx AS start, coalesce((SELECT min(c.idx) FROM cand c WHERE c.doc = r.doc AND c.idx > r.idx AND c.name <> r.name), n.n) AS "end", coalesce((SELECT arg_min(c.name, c.idx) FROM cand c WHERE c.doc = r.doc AND c.idx > r.idx AND c.name <> r.name), 'EOF') AS end_reason FROM r JOIN n USING (doc) WHERE romans < 3 OR style = 'roman')"""
)


def block_sequence(spark, d, plain=False):
    """Blocks of every filing made of its sections: the header, then the paragraphs."""
    s = table(spark, d, "section_contents").select("section_key", "rcept_no", F.upper("section_id").alias("sid"), "start_header", "paragraphs").distinct()
    raw = s.select(F.col("rcept_no").alias("doc"), "sid", "section_key", F.posexplode(F.concat(F.array("start_header"), F.coalesce("paragraphs", F.array().cast("array<string>")))).alias("pos", "text"))
    raw = raw.where(F.col("text").rlike(PLAIN) if plain else F.col("text").isNotNull())
    idx = F.row_number().over(Window.partitionBy("doc").orderBy("sid", "section_key", "pos")) - 1
    return raw.select("doc", idx.alias("idx"), F.lit("text").alias("kind"), "text")


@q("d01_html_blocks")
def d01(spark, d):
    b = table(spark, d, "blocks").select("block_key", "html").where("html is not null").distinct()
    return b.select("block_key", F.posexplode(H.blocks(F.col("html"))).alias("i", "b")).select("block_key", "i", "b.kind", "b.tag", X.clean_text(F.col("b.text")).alias("text"))


@q("d02_html_blocks_old")
def d02(spark, d):
    b = table(spark, d, "blocks").select("block_key", "html").where("html is not null").distinct()
    return b.select("block_key", F.posexplode(H.blocks(F.col("html"), True)).alias("i", "b")).select("block_key", "i", "b.kind", "b.tag", X.clean_text(F.col("b.text")).alias("text"))


_MATCH = f"SELECT DISTINCT text, name FROM (SELECT text, {_KEY} AS key FROM (SELECT DISTINCT start_header AS text FROM section_contents WHERE regexp_matches(start_header, '{PLAIN}')) WHERE length(text) <= 60) LEFT JOIN (SELECT * FROM (VALUES {_NAMES}) AS t(key, name)) USING (key)"


@q("d03_section_name_exact", _MATCH)
def d03(spark, d, plain=True):
    h = table(spark, d, "section_contents").where((F.col("start_header").rlike(PLAIN) if plain else F.col("start_header").isNotNull()) & (F.length("start_header") <= 60)).select(F.col("start_header").alias("text")).distinct()
    return h.select("text", S.section_name(F.col("text"), None).alias("name"))


@q("d03_section_name_fuzzy")
def d03_fuzzy(spark, d):
    h = table(spark, d, "section_contents").select(F.col("start_header").alias("text")).where("text is not null").distinct()
    return h.select("text", S.section_name(F.col("text"), 97.0).alias("strict"), S.section_name(F.col("text"), 92.0).alias("loose"))


@q("d04_header_candidates", _CANDIDATES + " SELECT * FROM cand")
def d04(spark, d, plain=True):
    return S.header_candidates(block_sequence(spark, d, plain), None)


@q("d05_section_spans", _SPANS + ' SELECT doc, name, start, "end", end_reason FROM spans')
def d05(spark, d, plain=True):
    return S.spans(block_sequence(spark, d, plain), None).select("doc", "name", "start", "end", "end_reason")


_TARGET = ", ".join(f"('{v}', '{k}')" for k, v in S.TARGETS.items())


@q("d06_collected_span", _SPANS + ' SELECT s.doc, s.name, s.start, count(*) AS n_blocks, CAST(sum(length(b.text)) AS BIGINT) AS chars FROM spans s JOIN blocks b ON b.doc = s.doc AND b.idx > s.start AND b.idx < s."end" GROUP BY ALL')
def d06(spark, d, plain=True):
    b = block_sequence(spark, d, plain)
    s = S.spans(b, None)
    inside = s.join(b.select("doc", "idx", F.length("text").alias("n")), "doc").where("idx > start and idx < end")
    return inside.groupBy("doc", "name", "start").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("chars"))


@q("d06_captions", "SELECT block_key, CASE WHEN length(prev) <= 120 THEN prev END AS caption FROM (SELECT block_key, kind, last_value(CASE WHEN kind = 'text' AND length(text) > 0 THEN text END IGNORE NULLS) OVER (PARTITION BY rcept_no ORDER BY block_index, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT block_key, any_value(rcept_no) AS rcept_no, any_value(block_index) AS block_index, any_value(kind) AS kind, any_value(text) AS text FROM blocks GROUP BY 1)) WHERE kind = 'table'")
def d06_captions(spark, d):
    b = table(spark, d, "blocks").groupBy("block_key").agg(*[F.any_value(c).alias(c) for c in ("rcept_no", "block_index", "kind", "text")])
    out = S.captions(b.select(F.col("rcept_no").alias("doc"), F.struct("block_index", "block_key").alias("idx"), "kind", "text"))
    return out.select(F.col("idx.block_key").alias("block_key"), "caption")


@q("d07_extracted_sections", _SPANS + f""", t AS (SELECT * FROM (VALUES {_TARGET}) AS t(name, section_id)), body AS (SELECT s.doc, t.section_id, s.start, s.end_reason, sum(length(b.text)) AS score FROM spans s JOIN t USING (name) LEFT JOIN blocks b ON b.doc = s.doc AND b.idx > s.start AND b.idx < s."end" GROUP BY ALL),
 best AS (SELECT * FROM body QUALIFY row_number() OVER (PARTITION BY doc, section_id ORDER BY coalesce(score, 0) DESC, start) = 1)
 SELECT d.doc, t.section_id, coalesce(best.score, 0) > 0 AS has_body, coalesce(best.score, 0) > 0 AND best.end_reason <> 'EOF' AS found, coalesce(best.end_reason, 'no start header') AS end_reason FROM (SELECT DISTINCT doc FROM blocks) d CROSS JOIN t LEFT JOIN best ON best.doc = d.doc AND best.section_id = t.section_id""")
def d07(spark, d, plain=True):
    return S.extract(block_sequence(spark, d, plain), threshold=None).select("doc", "section_id", "has_body", "found", "end_reason")


@q("d08_extracted_sections_old")
def d08(spark, d):
    return S.extract_old(block_sequence(spark, d))


def _sections(spark, d):
    return table(spark, d, "section_contents").where("paragraphs is not null").select("section_key", "paragraphs").distinct()


_SHORT = "length(x.o[1]) < 10 OR regexp_matches(x.o[1], '^[\\s()\\[\\]{}<>·ㆍ・,.:;\\-–—_/\\\\|~!@#$%^&*+=''\"’‘“”]*$')"
_FOLD = (
    "list_reduce(list_prepend({{o: []::VARCHAR[], h: ''}}, list_transform({}, lambda p: {{o: [p], h: ''}})), lambda a, x: CASE WHEN NOT (" + _SHORT.replace("{", "{{").replace("}", "}}") + ") THEN {{o: list_append(a.o, CASE WHEN a.h = '' THEN x.o[1] ELSE a.h || ' ' || x.o[1] END), h: ''}} "
    "WHEN len(a.o) > 0 AND length(a.o[-1]) + 1 + length(x.o[1]) <= 2000 THEN {{o: list_append(list_slice(a.o, 1, len(a.o) - 1), a.o[-1] || ' ' || x.o[1]), h: a.h}} WHEN len(a.o) > 0 THEN {{o: list_append(a.o, x.o[1]), h: a.h}} ELSE {{o: a.o, h: CASE WHEN a.h = '' THEN x.o[1] ELSE a.h || ' ' || x.o[1] END}} END)"
)
_TRIMMED = "list_filter(list_transform({}, lambda p: regexp_replace({}, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
_ENDED = "SELECT section_key, to_json(CASE WHEN f.h = '' THEN f.o ELSE [f.h] END)::VARCHAR AS paragraphs FROM (SELECT section_key, {} AS f FROM (SELECT DISTINCT section_key, paragraphs FROM section_contents WHERE paragraphs IS NOT NULL))"


@q("d09_merged_paragraphs", _ENDED.format(_FOLD.format(_TRIMMED.format("paragraphs", "p"))))
def d09(spark, d):
    return _sections(spark, d).select("section_key", F.to_json(S.merged(F.col("paragraphs"))).alias("paragraphs"))


@q("d10_derived_clean", _ENDED.format(_FOLD.format(_TRIMMED.format("paragraphs", "regexp_replace(" + _ARTIFACTS.format("p") + ", ' {2,}', ' ', 'g')"))))
def d10(spark, d):
    return _sections(spark, d).select("section_key", F.to_json(S.derived_clean(F.col("paragraphs"))).alias("paragraphs"))


def _tables(spark, d):
    t = table(spark, d, "section_contents").select("section_key", F.posexplode("tables_html").alias("table_index", "html"))
    return t.where("html is not null").distinct()


@q("d11_table_grids")
def d11(spark, d):
    return _tables(spark, d).select("section_key", "table_index", H.grids("html").alias("grid"))


def _planted(rows, key, head, cells):
    """Tables of up to 50 rows of a relation as HTML under negative section keys: an exact round trip."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    one = rows.groupBy((-1 - F.floor(F.col(key) / 50)).cast("bigint").alias("section_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, row.alias("r")))), lambda x: x["r"]), "").alias("body"))
    return one.select("section_key", F.lit(0).alias("table_index"), F.concat(F.lit("<table>"), head(F.col("section_key")), F.col("body"), F.lit("</table>")).alias("html"))


_OFFICER_HEAD = "<tr><th rowspan=2>성명</th><th rowspan=2>직위</th><th rowspan=2>등기임원여부</th><th rowspan=2>담당업무</th><th colspan=2>소유주식수</th><th rowspan=2>재직기간</th></tr><tr><th>의결권있는 주식</th><th>의결권없는 주식</th></tr>"


def _officers(spark, d):
    """Every table, and planted ones that make officers of the suppliers."""
    k = F.col("s_suppkey")
    position = F.when(k % 3 == 0, "대표이사").when(k % 3 == 1, "상무").otherwise("감사")
    tenure = F.when(k % 7 == 0, "-").otherwise(F.concat((k % 9).cast("string"), F.lit("년 "), (k % 12).cast("string"), F.lit("개월")))
    cells = [F.col("s_name"), position, F.when(k % 2 == 0, "등기임원").otherwise("미등기"), F.concat(F.lit("담당 "), (k % 5).cast("string")), F.lit("1"), F.lit("-"), tenure]
    return _tables(spark, d).unionByName(_planted(table(spark, d, "supplier"), "s_suppkey", lambda _: F.lit(_OFFICER_HEAD), cells))


@q("d12_d13_officers", "SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN '대표이사' WHEN 1 THEN '상무' ELSE '감사' END AS position, s_suppkey % 2 = 0 AS is_registered, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 9 * 12 + s_suppkey % 12)::DOUBLE END AS tenure_months FROM supplier")
def d13(spark, d):
    """Officers of every table; besides the planted ones the test tables hold no officer table."""
    return TB.officer_rows(_officers(spark, d), "section_key", "html").select("name", "position", "is_registered", "tenure_months")


@q("d14_officer_diagnostics")
def d14(spark, d):
    t = _officers(spark, d)
    rows = TB.officer_rows(t, "section_key", "html").groupBy("section_key").agg(F.count(F.lit(1)).alias("n_officers"), F.round(F.avg(F.col("is_registered").isNull().cast("int")), 4).alias("registered_null_rate"))
    per = t.groupBy("section_key").agg(F.count(F.lit(1)).alias("n_tables"), F.bool_or(H.nested_table("html")).alias("has_nested_table"))
    return per.join(rows, "section_key", "left").select("section_key", "n_tables", F.coalesce("n_officers", F.lit(0)).alias("n_officers"), "has_nested_table", "registered_null_rate")


def _lawsuits(spark, d):
    """Every table, and planted ones that make lawsuits of the customers: units in the header or the cell, repeated headers."""
    k = F.col("c_custkey")
    unit = lambda group: F.when(group % 2 == 0, "억원").otherwise("원화단위: 백만원")
    head = lambda group: F.concat(F.lit("<tr><th>사건번호</th><th>원고</th><th>소송가액("), unit(group), F.lit(")</th><th>진행상황</th></tr>"))
    amount = F.concat(F.abs("c_acctbal").cast("bigint").cast("string"), F.when(k % 5 == 0, "천원").otherwise(""))
    again = F.when(k % 10 == 0, F.lit("</td></tr><tr><td>사건번호</td><td>원고</td><td>소송가액</td><td>진행상황")).otherwise("")
    cells = [F.concat(F.lit("2020가합"), k.cast("string")), F.col("c_name"), amount, F.concat(F.lit("1심"), again)]
    return _tables(spark, d).unionByName(_planted(table(spark, d, "customer"), "c_custkey", head, cells))


_AMOUNT = "CAST(trunc(abs(c_acctbal)) AS BIGINT) * CASE WHEN c_custkey % 5 = 0 THEN 1000.0 WHEN (-1 - c_custkey // 50) % 2 = 0 THEN 100000000.0 ELSE 1000000.0 END"


@q("d15_lawsuit_tables")
def d15(spark, d):
    c = TB.lawsuit_tables(_lawsuits(spark, d), "section_key", "html")
    return c.select("section_key", "table_index", "info.is_lawsuit", "info.is_sanction", F.size("info.rows").alias("n_rows"))


@q("d16_lawsuit_rows", f"SELECT '2020가합' || c_custkey AS case_no, c_name AS plaintiff, {_AMOUNT} AS amount_krw FROM customer")
def d16(spark, d):
    """Lawsuit rows of every table; besides the planted ones the test tables hold no lawsuit table."""
    c = TB.lawsuit_tables(_lawsuits(spark, d), "section_key", "html")
    return TB.lawsuit_rows(c, "section_key").select("case_no", "plaintiff", "amount_krw")


@q("d17_lawsuit_summary", "SELECT section_key, count(*) AS n_tables, 0 AS n_lawsuit_tables, 0 AS n_lawsuit_rows, false AS explicit_none FROM (SELECT DISTINCT section_key, i, tables_html[i] AS h FROM section_contents, range(1, 400) t(i) WHERE i <= len(tables_html)) WHERE h IS NOT NULL GROUP BY 1 UNION ALL SELECT -1 - c_custkey // 50, 1, 1, count(*), false FROM customer GROUP BY 1 UNION ALL SELECT -1000000 - n_nationkey, 1, 0, 0, n_nationkey % 2 = 0 FROM nation")
def d17(spark, d):
    """Summaries of every section's tables; of planted ones that say nothing applies, or something else."""
    said = F.when(F.col("n_nationkey") % 2 == 0, "해당사항 없음").otherwise(F.col("n_name"))
    none = table(spark, d, "nation").select((-1000000 - F.col("n_nationkey")).cast("bigint").alias("section_key"), F.lit(0).alias("table_index"), F.concat(F.lit("<table><tr><td>"), said, F.lit("</td></tr></table>")).alias("html"))
    c = TB.lawsuit_tables(_lawsuits(spark, d).unionByName(none), "section_key", "html")
    return TB.lawsuit_summary(c, "section_key").select("section_key", "n_tables", "n_lawsuit_tables", "n_lawsuit_rows", "explicit_none")


@q("d18_layout_tables")
def d18(spark, d):
    return _tables(spark, d).select("section_key", "table_index", H.is_layout(H.grids("html")).alias("is_layout"))


@q("d18_planted_layouts", "SELECT c_custkey, c_custkey % 3 <> 1 AND length(c_name) * (1 + c_custkey % 20) >= 200 AS is_layout FROM customer")
def d18_planted(spark, d):
    """Tables made of the customers: one cell, four rows of two columns, three rows of one column."""
    k, long = F.col("c_custkey"), F.repeat("c_name", (1 + F.col("c_custkey") % 20).cast("int"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    short = cell(F.lit("x"))
    rows = F.when(k % 3 == 0, row(cell(long))).when(k % 3 == 1, F.concat(row(short, cell(long)), *[row(short, short)] * 3)).otherwise(F.concat(row(short), row(cell(long)), row(short)))
    html = F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html")
    return table(spark, d, "customer").select("c_custkey", html).select("c_custkey", H.is_layout(H.grids("html")).alias("is_layout"))


_BLOCK_ROWS = "b AS (SELECT block_key, any_value(rcept_no) AS rcept_no, any_value(block_index) AS i, any_value(kind) AS kind, any_value(text) AS text FROM blocks GROUP BY 1)"
_CAPTIONED = "c AS (SELECT rcept_no, block_key, CASE WHEN length(prev) <= 120 THEN prev END AS caption FROM (SELECT rcept_no, block_key, kind, last_value(CASE WHEN kind = 'text' AND length(text) > 0 THEN text END IGNORE NULLS) OVER (PARTITION BY rcept_no ORDER BY i, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b) WHERE kind = 'table')"


def _blocks(spark, d):
    return table(spark, d, "blocks").groupBy("block_key").agg(*[F.any_value(c).alias(c) for c in ("rcept_no", "block_index", "kind", "text")])


def captioned(spark, d):
    """(rcept_no, caption) of every table block; null where the text before it is too long for one."""
    b = _blocks(spark, d).select(F.col("rcept_no").alias("doc"), F.struct("block_index", "block_key").alias("idx"), "kind", "text")
    return S.captions(b).select(F.col("doc").alias("rcept_no"), "caption")


@q("d19_orphan_captions", f"""WITH {_BLOCK_ROWS}, {_CAPTIONED}, u AS (SELECT DISTINCT rcept_no, caption FROM c WHERE caption IS NOT NULL), p AS (SELECT rcept_no, sid, unnest(paragraphs) AS p FROM (SELECT DISTINCT section_key, rcept_no, upper(section_id) AS sid, paragraphs FROM section_contents))
 SELECT p.rcept_no, p.sid AS section_id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS orphan_chars FROM p JOIN u ON p.rcept_no = u.rcept_no AND p.p = u.caption GROUP BY ALL""")
def d19(spark, d):
    s = table(spark, d, "section_contents").select("section_key", F.col("rcept_no").alias("doc"), F.upper("section_id").alias("section_id"), "paragraphs").distinct()
    return S.orphan_captions(s, captioned(spark, d).select(F.col("rcept_no").alias("doc"), "caption")).withColumnRenamed("doc", "rcept_no")


@q("d20_table_leak", "SELECT t.block_key, count(*) AS n_bodies, count(*) FILTER (WHERE contains(s.text, trim(substr(t.text, 1, 60)))) AS n_leaks FROM (SELECT block_key, any_value(rcept_no) AS rcept_no, any_value(text) AS text FROM blocks WHERE kind = 'table' GROUP BY 1) t JOIN (SELECT DISTINCT section_key, rcept_no, text FROM section_contents WHERE text IS NOT NULL) s USING (rcept_no) WHERE trim(substr(t.text, 1, 60)) <> '' GROUP BY 1")
def d20(spark, d):
    """Tables whose first 60 characters stand in a section's text. A filing's heads meet each text once, as one array."""
    t = table(spark, d, "blocks").where("kind = 'table'").groupBy("block_key").agg(F.any_value("rcept_no").alias("rcept_no"), F.trim(F.substring(F.any_value("text"), 1, 60)).alias("head")).where("head <> ''")
    heads = t.groupBy("rcept_no").agg(F.collect_list(F.struct("block_key", "head")).alias("heads"))
    s = table(spark, d, "section_contents").where("text is not null").select("section_key", "rcept_no", "text").distinct()
    told = s.join(heads, "rcept_no").select(F.explode(F.transform("heads", lambda h: F.struct(h["block_key"].alias("block_key"), F.contains(F.col("text"), h["head"]).alias("leak")))).alias("x"))
    return told.groupBy("x.block_key").agg(F.count(F.lit(1)).alias("n_bodies"), F.count_if("x.leak").alias("n_leaks"))


@q("d21_parse_ok", "SELECT rcept_no AS doc, count(*) FILTER (WHERE found AND length(text) > 0) AS n_found, count(*) FILTER (WHERE found AND length(text) > 0) >= 1 AS ok FROM (SELECT DISTINCT section_key, rcept_no, found, text FROM section_contents) GROUP BY 1")
def d21(spark, d):
    return S.parse_ok(table(spark, d, "section_contents").select("section_key", F.col("rcept_no").alias("doc"), "found", "text").distinct())


@q("d22_variant_audit")
def d22(spark, d):
    """Sections of both rules side by side, one row per document, variant and section."""
    b = block_sequence(spark, d)
    new = S.extract(b).select("doc", "section_id", F.lit("new").alias("variant"), "found", F.length("text").cast("bigint").alias("chars"), "end_reason")
    old = S.extract_old(b).select("doc", "section_id", F.lit("old").alias("variant"), "found", F.col("chars").cast("bigint").alias("chars"), "end_reason")
    return new.unionByName(old)



@q("s12_synthetic_sections", "SELECT lpad(CAST(f AS VARCHAR), 8, '0') AS corp_code, CAST(y AS INTEGER) AS fy, s AS section_id, true AS found, CASE WHEN y >= 2020 THEN 3 ELSE 0 END AS n_template, 12 + CASE WHEN y >= 2020 THEN 3 ELSE 0 END AS n_paragraphs FROM range(1, 31) a(f), range(2018, 2022) b(y), (VALUES ('S1'), ('S2'), ('S3'), ('S4')) c(s)")
def s12(spark, d):
    """Invented filings through blocks and sections: every section whole, template paragraphs from 2020 on."""
    made = synthetic.filings(spark, 30, (2018, 2021)).select("corp_code", "fy", F.col("rcept_no").alias("doc"), "html")
    blocks = made.select("doc", F.posexplode(H.blocks(F.col("html"))).alias("idx", "b")).select("doc", "idx", "b.kind", X.clean_text(F.col("b.text")).alias("text"))
    parts = S.extract(blocks).join(made.select("doc", "corp_code", "fy"), "doc")
    templates = F.size(F.filter("paragraphs", lambda p: p.isin(*synthetic.TEMPLATES)))
    return parts.select("corp_code", "fy", "section_id", "found", templates.alias("n_template"), F.size("paragraphs").alias("n_paragraphs"))


for _name in ("d03_section_name_exact", "d04_header_candidates", "d05_section_spans", "d06_collected_span", "d07_extracted_sections"):
    book.whole(f"{_name}_whole", _name)
queries, oracle_sql = book.queries, book.oracle_sql
