"""Text and scalar function queries (T and N rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.plans.base import Book, values
from filamento.plans.runtime import table

book = Book()
q = book.query

SECTION_TEXT = "(SELECT DISTINCT section_key, text FROM section_contents WHERE text IS NOT NULL)"
PARAS = "(SELECT DISTINCT section_key, unnest(paragraphs) AS p FROM section_contents)"


def _texts(spark, d):
    return table(spark, d, "section_contents").where("text is not null").select("section_key", "text").distinct()


def _paras(spark, d):
    return table(spark, d, "section_contents").select("section_key", F.explode("paragraphs").alias("p")).where("p is not null").distinct()


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_ARTIFACTS = (
    "replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '◆\\s*click\\s*◆\\s*(?:『[^』]{{0,60}}』)?\\s*(?:삽입|추가)?', ' ', 'gi'),"
    " '\\d{{4,6}}\\s*#\\s*\\*?\\s*_\\S+?\\.dsl', ' ', 'gi'), '&(cr[A-Za-z0-9])', chr(1) || '\\1', 'gi'), '&cr;?', ' ', 'gi'), chr(1), '&')"
)
_CLEAN_ROWS = "('a  b\tc'), ('x ◆click◆『수주상황』 삽입 y'), ('11011#*_수주상황.dsl z'), ('R&D &cr; (주1) k'), ('p ※ q *3) r'), (''), ('주 2) end')"


@q("t01_clean_text", f"""SELECT s, {_STRIP.format("regexp_replace(regexp_replace(" + _ARTIFACTS.format("replace(s, chr(9), ' ')") + ", '(?:[(]\\s*주\\s*\\d*\\s*[)]|주\\s*\\d+\\s*[)]|※|\\*\\s*\\d+\\s*[)])', ' ', 'g'), ' {2,}', ' ', 'g')")} AS clean FROM (VALUES {_CLEAN_ROWS}) AS t(s)""")
def t01(spark, d):
    return values(spark, _CLEAN_ROWS, "s").select("s", X.clean_text(F.col("s")).alias("clean"))


@q("t01_clean_text_sections")
def t01_sections(spark, d):
    return _texts(spark, d).select("section_key", X.clean_text(F.col("text")).alias("clean"), X.clean_text(F.col("text"), False).alias("raw"))


@q("t02_strip_artifacts", f"""SELECT section_key, {_STRIP.format("regexp_replace(" + _ARTIFACTS.format("text") + ", ' {2,}', ' ', 'g')")} AS clean FROM {SECTION_TEXT}""")
def t02(spark, d):
    return _texts(spark, d).select("section_key", X.strip_artifacts(F.col("text")).alias("clean"))


@q("t03_artifact_counts", f"""SELECT section_key, len(regexp_extract_all(text, '◆\\s*click\\s*◆', 0, 'i')) AS n_label, len(regexp_extract_all(text, '\\d{{4,6}}\\s*#\\s*\\*?\\s*_\\S+?\\.dsl', 0, 'i')) AS n_file,
 len(regexp_extract_all(text, '&cr', 0, 'i')) - len(regexp_extract_all(text, '&cr[A-Za-z0-9]', 0, 'i')) AS n_entity FROM {SECTION_TEXT}""")
def t03(spark, d):
    return _texts(spark, d).select("section_key", *[c.cast("bigint").alias(n) for n, c in X.artifact_counts(F.col("text")).items()])


_NUM_RE = "^\\s*[(\\[<]?\\s*(?:[IVXLivxl]{1,7}|[0-9]{1,2}|[가나다라마바사아자차카타파하]|[①-⑳])\\s*[)\\]>.\\-–—:]*\\s*"
_NAME = f"lower(regexp_replace(regexp_replace(regexp_replace(trim(start_header), '{_NUM_RE}', ''), '{_NUM_RE}', ''), '[\\s·ㆍ・･.,:;\\-—–_()\\[\\]{{}}<>「」『』\"''’‘“”/|]+', '', 'g'))"


@q("t04_norm_name", f"SELECT DISTINCT start_header, {_NAME} AS key FROM section_contents WHERE start_header IS NOT NULL AND regexp_matches(start_header, '^[ -~가-힣]*$')")
def t04(spark, d):
    return table(spark, d, "section_contents").where(F.col("start_header").rlike("^[ -~가-힣]*$")).select("start_header", X.norm_name(F.col("start_header")).alias("key")).distinct()


@q("t04_norm_name_all")
def t04_all(spark, d):
    return table(spark, d, "section_contents").select("start_header", "end_header", X.norm_name(F.col("start_header")).alias("start_key"), X.norm_name(F.col("end_header")).alias("end_key")).distinct()


@q("t05_strip_leading_number", f"SELECT DISTINCT start_header, {_STRIP.format(f'''regexp_replace(regexp_replace(start_header, '{_NUM_RE}', ''), '{_NUM_RE}', '')''')} AS name FROM section_contents WHERE start_header IS NOT NULL")
def t05(spark, d):
    return table(spark, d, "section_contents").where("start_header is not null").select("start_header", X.strip_leading_number(F.col("start_header")).alias("name")).distinct()


@q("t06_split_paragraphs", """SELECT doc_id, len(p) AS n, list_aggregate(p, 'string_agg', '|') AS joined FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 30) AS p FROM documents)""")
def t06(spark, d):
    p = X.paragraphs(F.col("text"), 30)
    return table(spark, d, "documents").select("doc_id", F.size(p).cast("bigint").alias("n"), F.when(F.size(p) > 0, F.array_join(p, "|")).alias("joined"))


@q("t07_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents WHERE NOT regexp_matches(text, '[\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}\\x{0085}\\x{2028}\\x{2029}\\x0b\\x1c-\\x1f]')")
def t07(spark, d, plain=True):
    docs = table(spark, d, "documents").where(F.lit(not plain) | ~F.col("text").rlike("[\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}\\x{0085}\\x{2028}\\x{2029}\\x0b\\x1c-\\x1f]"))
    return docs.select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("n_words"))


@q("t08_char_ngrams", "SELECT item_id, len(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) AS n_grams FROM (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM eval_items)")
def t08(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.size(X.char_ngrams(F.col("text"))).cast("bigint").alias("n_grams"))


@q("t09_mask_numbers", f"SELECT section_key, p, regexp_replace(p, '[0-9][0-9,.]*', '<NUM>', 'g') AS masked FROM {PARAS} WHERE p IS NOT NULL AND regexp_matches(p, '^[ -~가-힣]*$')")
def t09(spark, d, plain=True):
    return _paras(spark, d).where(F.lit(not plain) | F.col("p").rlike("^[ -~가-힣]*$")).select("section_key", "p", X.mask_numbers(F.col("p")).alias("masked"))


@q("t10_numbering_style", """SELECT DISTINCT start_header, CASE WHEN regexp_matches(start_header, '^\\s*[(\\[<]?\\s*[IVXLivxl]{1,7}\\s*[)\\]>.\\-–—:]') THEN 'roman' WHEN regexp_matches(start_header, '^\\s*[(\\[<]?\\s*[0-9]{1,2}\\s*[)\\]>.\\-–—:]') THEN 'arabic' ELSE 'none' END AS style FROM section_contents WHERE start_header IS NOT NULL""")
def t10(spark, d):
    return table(spark, d, "section_contents").where("start_header is not null").select("start_header", X.numbering_style(F.col("start_header")).alias("style")).distinct()


_CLASS_ROWS = "('상세표 참조'), ('기업회계기준서 제1116호를 적용하였습니다.'), ('상법 제 3 조에 따릅니다.'), ('가. 사업의 개요'), ('1. 회사는 설립되었습니다.'), ('회사는 제품을 팝니다.'), (''), ('제5조 1항'), ('아래 표와 같습니다'), ('K-IFRS 아래 표')"
_CLASS_SQL = """CASE WHEN {0} = '' THEN 'other' WHEN regexp_matches({0}, '<표\\s*\\d*>|\\[표\\s*\\d*\\]|상세표\\s*참조|참조하시기 바랍니다|별첨|아래 표|다음 표와 같|해당 내용은.{{0,20}}기재') AND length({0}) <= 120 THEN 'moved'
 WHEN regexp_matches({0}, '기업회계기준서|한국채택국제회계기준|K-?IFRS|기준서 제\\s*\\d{{4}}\\s*호|해석서|회계정책|연결재무제표 작성|제ᆞ개정 기준서|제·개정 기준서') THEN 'standards'
 WHEN regexp_matches({0}, '제\\s*\\d+\\s*조|자본시장법|상법|공정거래법|시행령|법률 제|규정 제\\s*\\d+') THEN 'law'
 WHEN regexp_matches({0}, '^\\s*(?:[가-힣]\\s*\\.|\\d+\\s*\\.|\\(\\d+\\)|[IVXivx]+\\s*\\.|[①-⑳])') AND length({0}) <= 80 AND NOT regexp_matches({0}, '(습니다|합니다|입니다|하였다|이다)\\s*[.。]?\\s*$') THEN 'heading' ELSE 'other' END"""


@q("t11_paragraph_class", f"SELECT p, {_CLASS_SQL.format('p')} AS class FROM (VALUES {_CLASS_ROWS}) AS t(p)")
def t11(spark, d):
    return values(spark, _CLASS_ROWS, "p").select("p", X.paragraph_class(F.col("p")).alias("class"))


@q("t11_paragraph_classes", f"SELECT {_CLASS_SQL.format('p')} AS class, count(*) AS n FROM (SELECT regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p FROM {PARAS} WHERE p IS NOT NULL) GROUP BY 1")
def t11_all(spark, d):
    return _paras(spark, d).groupBy(X.paragraph_class(F.col("p")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_CORP_ROWS = "('주식회사 에코'), ('에코(주)'), ('㈜ Eco-Pro.'), ('(재) 한 길'), (''), ('유한회사 A·B')"
_CORP_SQL = "upper(regexp_replace(regexp_replace({}, '주식회사|㈜|\\(주\\)|\\(유\\)|유한회사|합자회사|주\\)|\\(재\\)|재단법인|사단법인', '', 'g'), '[\\s.,\\-_()\\[\\]<>·ㆍ''\"]+', '', 'g'))"


@q("t12_corp_name_key", f"SELECT s, {_CORP_SQL.format('s')} AS key FROM (SELECT * FROM (VALUES {_CORP_ROWS}) AS t(s) UNION SELECT DISTINCT corp_name FROM filings_index WHERE corp_name IS NOT NULL)")
def t12(spark, d):
    names = table(spark, d, "filings_index").select(F.col("corp_name").alias("s")).where("s is not null")
    return values(spark, _CORP_ROWS, "s").union(names).distinct().select("s", X.corp_name_key(F.col("s")).alias("key"))


_TENURE_ROWS = "('3년 2개월'), ('12개월'), ('2년'), ('3년0월'), ('-'), (''), ('약 3년'), ('10월'), ('해당없음')"


#: White space as Java's Unicode classes have it.
_WS = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_AND_PARAS = f"SELECT p AS s FROM {PARAS} WHERE p IS NOT NULL"


def _with_paras(spark, d, rows):
    """Given strings and every paragraph of the tables, each once."""
    return values(spark, rows, "s").unionByName(_paras(spark, d).select(F.col("p").alias("s"))).distinct()


_TENURE = "'^(?:(\\d+)년)?(?:(\\d+)(?:개월|월))?$'"


@q("t13_tenure_months", f"""SELECT s, CASE WHEN a <> '' OR b <> '' THEN CAST(coalesce(TRY_CAST(a AS INT), 0) * 12 + coalesce(TRY_CAST(b AS INT), 0) AS DOUBLE) END AS months FROM
 (SELECT s, regexp_extract(t, {_TENURE}, 1) AS a, regexp_extract(t, {_TENURE}, 2) AS b FROM (SELECT s, regexp_replace(s, '{_WS}', '', 'g') AS t FROM (SELECT s FROM (VALUES {_TENURE_ROWS}) AS t(s) UNION {_AND_PARAS})))""")
def t13(spark, d):
    return _with_paras(spark, d, _TENURE_ROWS).select("s", X.tenure_months(F.col("s")).alias("months"))


_BOOL_ROWS = "('등기임원'), ('미등기임원'), ('비상근'), ('상근'), ('Y'), ('N'), (''), ('-'), ('사외이사'), ('기타')"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@q("t14_tri_bool", f"""SELECT s, CASE WHEN t = '' THEN NULL WHEN len(list_filter({_list(X.NEGATIVE)}, lambda x: contains(t, x))) > 0 THEN false WHEN len(list_filter({_list(X.POSITIVE)}, lambda x: contains(t, x))) > 0 THEN true END AS flag FROM
 (SELECT s, lower(regexp_replace(s, '{_WS}', '', 'g')) AS t FROM (SELECT s FROM (VALUES {_BOOL_ROWS}) AS t(s) UNION {_AND_PARAS}))""")
def t14(spark, d):
    return _with_paras(spark, d, _BOOL_ROWS).select("s", X.tri_bool(F.col("s")).alias("flag"))


_AMOUNT_ROWS = "('50,488', '소송가액(억원)'), ('297,641백만원', '금액'), ('-', '소송가액(천원)'), ('', ''), ('약 1,000원', '소가(원화단위: 천원)'), ('3.5조원', '청구액'), ('12', '금액')"
_UNIT_SQL = "coalesce(map_extract(MAP {{'조': 1000000000000, '억': 100000000, '백만': 1000000, '천': 1000}}, regexp_extract({0}, '(조|억|백만|천)\\s*원', 1))[1], 1)"


@q("t15_amount", f"""SELECT cell, header, TRY_CAST(replace(regexp_extract(replace(cell, ' ', ''), '[-+]?[\\d,]*\\.?\\d+'), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(cell, '(조|억|백만|천)\\s*원') THEN {_UNIT_SQL.format('cell')} ELSE {_UNIT_SQL.format('header')} END AS krw FROM (SELECT cell, header FROM (VALUES {_AMOUNT_ROWS}) AS t(cell, header) UNION SELECT p, '금액(천원)' FROM {PARAS} WHERE p IS NOT NULL)""")
def t15(spark, d):
    cells = values(spark, _AMOUNT_ROWS, "cell, header").unionByName(_paras(spark, d).select(F.col("p").alias("cell"), F.lit("금액(천원)").alias("header"))).distinct()
    return cells.select("cell", "header", X.amount(F.col("cell"), X.amount_unit(F.col("header"))).alias("krw"))


_KEYS = ["해당사항없음", "해당없음", "없음", "n/a", "없습니다"]


@q("t16_none_marker", f"""SELECT p, count(*) AS n, bool_or(p IN ('해당사항 없음','해당사항없음','해당없음','없음','-','N/A','없습니다') OR (t <> '' AND (list_contains({_list(_KEYS)}, t) OR (length(p) <= 40 AND len(list_filter({_list(_KEYS)}, lambda k: contains(t, k))) > 0)))) AS none_marker
 FROM (SELECT p, lower(regexp_replace(p, '[\\s()\\[\\]·ㆍ.,\\-:]+', '', 'g')) AS t FROM (SELECT regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p FROM {PARAS} WHERE p IS NOT NULL)) WHERE p <> '' GROUP BY p""")
def t16(spark, d):
    p = _paras(spark, d).select(X.strip(F.col("p")).alias("p")).where("p <> ''")
    return p.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", "n", X.none_marker(F.col("p")).alias("none_marker"))


_TYPE_SQL = """CASE WHEN len(list_filter(tags, lambda t: contains(t, '기재정정'))) > 0 THEN 'material_amendment' WHEN len(list_filter(tags, lambda t: contains(t, '첨부추가') OR contains(t, '첨부정정'))) > 0 THEN 'attachment_added' ELSE 'original' END"""


_TAGGED = lambda names: "list_filter(tags, lambda t: " + " OR ".join(f"contains(t, '{n}')" for n in names) + ")"
_JOINED = "list_aggregate({}, 'string_agg', ', ')"
_REASON_SQL = f"CASE WHEN len(tags) = 0 THEN 'no bracket' WHEN {_TYPE_SQL} = 'material_amendment' THEN 'body amended: ' || {_JOINED.format(_TAGGED(X.MATERIAL_TAGS))} WHEN {_TYPE_SQL} = 'attachment_added' THEN 'attachment only: ' || {_JOINED.format(_TAGGED(X.ATTACHMENT_TAGS))} ELSE 'unknown tag, taken as original: ' || {_JOINED.format('tags')} END"


@q("t17_report_type", f"SELECT report_nm, list_aggregate(tags, 'string_agg', ', ') AS tags, {_REASON_SQL} AS reason, {_TYPE_SQL} AS kind, {_TYPE_SQL} IN ('original', 'attachment_added') AS body_original FROM (SELECT DISTINCT report_nm, list_transform(regexp_extract_all(report_nm, '\\[([^\\]]*)\\]', 1), lambda x: trim(x)) AS tags FROM filings_index WHERE report_nm IS NOT NULL)")
def t17(spark, d):
    f = table(spark, d, "filings_index").select("report_nm").where("report_nm is not null").distinct()
    tags, kind = X.bracket_tags(F.col("report_nm")), X.report_type(F.col("report_nm"))
    return f.select("report_nm", F.when(F.size(tags) > 0, F.array_join(tags, ", ")).alias("tags"), X.report_reason(F.col("report_nm")).alias("reason"), kind.alias("kind"), X.is_body_original(kind).alias("body_original"))


@q("t18_report_period", """SELECT DISTINCT report_nm, fy, regexp_matches(report_nm, '\\[(기재정정|첨부정정|첨부추가|정정|연장결정|변경등록)\\]') AS amended, TRY_CAST(nullif(regexp_extract(report_nm, '\\((\\d{4})\\.(\\d{1,2})\\)', 1), '') AS INT) AS y, TRY_CAST(nullif(regexp_extract(report_nm, '\\((\\d{4})\\.(\\d{1,2})\\)', 2), '') AS INT) AS m,
 contains(report_nm, '사업보고서') AND NOT contains(report_nm, '분기') AND NOT contains(report_nm, '반기') AS annual, (fy + 1)::VARCHAR || '0101' AS bgn, (fy + 2)::VARCHAR || '0630' AS fin FROM filings_index WHERE report_nm IS NOT NULL""")
def t18(spark, d):
    nm = F.col("report_nm")
    bgn, fin = X.search_window(F.col("fy"))
    return table(spark, d, "filings_index").where("report_nm is not null").select("report_nm", "fy", X.is_amendment(nm).alias("amended"), X.period_part(nm, 1).alias("y"), X.period_part(nm, 2).alias("m"), X.matches_annual(nm).alias("annual"), bgn.alias("bgn"), fin.alias("fin")).distinct()


@q("t19_snippet", "SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE substr(s, 1, 40) || ' … ' || substr(s, length(s) - 39) END AS snippet FROM (SELECT doc_id, replace(text, chr(10), ' ⏎ ') AS s FROM documents)")
def t19(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), 40).alias("snippet"))


@q("t20_squash", "SELECT DISTINCT name, lower(regexp_replace(name, '[\\s()\\[\\]·ㆍ.,\\-]+', '', 'g')) AS a, lower(regexp_replace(name, '[\\s()\\[\\]·ㆍ.,\\-:]+', '', 'g')) AS b FROM section_contents WHERE name IS NOT NULL")
def t20(spark, d):
    return table(spark, d, "section_contents").where("name is not null").select("name", X.squash(F.col("name")).alias("a"), X.squash(F.col("name"), True).alias("b")).distinct()


@q("t21_to_day", """SELECT DISTINCT rcept_dt, CAST(CASE WHEN regexp_matches(rcept_dt, '^\\d{8}$') THEN TRY_CAST(substr(rcept_dt,1,4)||'-'||substr(rcept_dt,5,2)||'-'||substr(rcept_dt,7,2) AS DATE) WHEN regexp_matches(rcept_dt, '^\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(substr(rcept_dt,1,10) AS DATE) END AS VARCHAR) AS day FROM filings_index WHERE rcept_dt IS NOT NULL""")
def t21(spark, d):
    return table(spark, d, "filings_index").where("rcept_dt is not null").select("rcept_dt", X.to_day(F.col("rcept_dt")).cast("string").alias("day")).distinct()


@q("t22_truncate", "SELECT doc_id, substr(text, 1, 300) AS head FROM documents")
def t22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("head"))


@q("n01_n06_math", """SELECT doc_id, round(ln(n_chars), 6) AS log_chars, round(sqrt(n_chars), 6) AS root, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE round(1000.0 / (n_chars % 7), 4) END AS ratio, round(n_chars / 1000.0, 4) AS k, CAST(ceil(n_chars / 300.0) AS BIGINT) AS pages, CASE WHEN n_chars >= 1000 THEN 'long' WHEN n_chars >= 300 THEN 'middle' ELSE 'short' END AS label FROM documents WHERE n_chars > 0""")
def n01(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.round(F.ln(n), 6).alias("log_chars"), F.round(F.sqrt(n), 6).alias("root"), F.round(F.lit(1000.0) / F.nullif(n % 7, F.lit(0)), 4).alias("ratio"), F.round(n / 1000.0, 4).alias("k"), F.ceil(n / 300.0).cast("bigint").alias("pages"), F.when(n >= 1000, "long").when(n >= 300, "middle").otherwise("short").alias("label"))


@q("n07_arrays", "SELECT section_key, list_aggregate(list_filter(p, lambda x: length(x) >= 20)[1:2], 'string_agg', ' / ') AS first_two, list_contains(p, '해당사항 없음') AS has_none FROM (SELECT DISTINCT section_key, paragraphs AS p FROM section_contents WHERE len(list_filter(paragraphs, lambda x: x IS NULL)) = 0)")
def n07(spark, d):
    s = table(spark, d, "section_contents").where("size(filter(paragraphs, x -> x is null)) = 0 and paragraphs is not null").select("section_key", "paragraphs").distinct()
    two = F.slice(F.filter("paragraphs", lambda x: F.length(x) >= 20), 1, 2)
    return s.select("section_key", F.when(F.size(two) > 0, F.array_join(two, " / ")).alias("first_two"), F.array_contains("paragraphs", "해당사항 없음").alias("has_none"))


@q("n08_day_difference", "SELECT universe_id, max(date_diff('day', CAST(snapshot_date AS DATE), CAST(known_at AS DATE))) AS lag_days FROM universe GROUP BY universe_id")
def n08(spark, d):
    return table(spark, d, "universe").groupBy("universe_id").agg(F.max(F.datediff(F.col("known_at").cast("date"), "snapshot_date")).cast("bigint").alias("lag_days"))


@q("n09_map_lookup", "SELECT DISTINCT section_id, coalesce(map_extract(MAP {'S1': 'business', 'S2': 'analysis'}, upper(section_id))[1], 'default') AS label FROM para_snapshots")
def n09(spark, d):
    names = F.create_map(F.lit("S1"), F.lit("business"), F.lit("S2"), F.lit("analysis"))
    return table(spark, d, "para_snapshots").select("section_id", F.coalesce(F.try_element_at(names, F.upper("section_id")), F.lit("default")).alias("label")).distinct()


@q("n10_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE false")
def n10(spark, d):
    """JSON documents made of paragraph statistics and read back into typed fields."""
    js = table(spark, d, "paragraph_stats").select("section_key", F.to_json(F.struct("n", "mean", "n_under_10")).alias("doc")).distinct()
    return js.select("section_key", F.from_json("doc", "n int, mean double, n_under_10 int").alias("x")).select("section_key", "x.n", F.round("x.mean", 6).alias("mean"), "x.n_under_10")


book.sql["n10_json_fields"] = "SELECT DISTINCT section_key, n, round(mean, 6) AS mean, n_under_10 FROM paragraph_stats"
book.whole("t07_words_whole", "t07_words")
book.whole("t09_mask_numbers_whole", "t09_mask_numbers")
queries, oracle_sql = book.queries, book.oracle_sql
