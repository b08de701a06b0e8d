"""Text functions as column expressions (one Arrow step: NFKC, for values that need it)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from filamento.functions.unicode import INVISIBLE, drop_invisible, nfkc

# Patterns of editor residue, footnote marks, numbering and names in filings.
SPACE_LIKE = r"[\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\t]+"
EDITOR_LABEL = r"(?iU)◆\s*click\s*◆\s*(?:『[^』]{0,60}』)?\s*(?:삽입|추가)?"
TEMPLATE_FILE = r"(?iU)\d{4,6}\s*#\s*\*?\s*_\S+?\.dsl"
BREAK_ENTITY = r"(?i)&cr(?![A-Za-z0-9]);?"
FOOTNOTE = r"(?U)(?:\(\s*주\s*\d*\s*\)|주\s*\d+\s*\)|※|\*\s*\d+\s*\))"
NAME_NOISE = r"[\s·ㆍ・･.,:;\-—–_()\[\]{}<>「」『』\"'’‘“”/|]+"
LEADING_NUMBER = r"(?U)^\s*[(\[<]?\s*(?:[IVXLivxl]{1,7}|[0-9]{1,2}|[가나다라마바사아자차카타파하]|[①-⑳])\s*[)\]>.\-–—:]*\s*"
ROMAN_HEAD = r"(?U)^\s*[(\[<]?\s*[IVXLivxl]{1,7}\s*[)\]>.\-–—:]"
ARABIC_HEAD = r"(?U)^\s*[(\[<]?\s*\d{1,2}\s*[)\]>.\-–—:]"
LEGAL_FORM = r"(주식회사|㈜|\(주\)|\(유\)|유한회사|합자회사|주\)|\(재\)|재단법인|사단법인)"
CORP_NOISE = r"[\s.,\-_()\[\]<>·ㆍ'\"]+"
MOVED = r"(?U)(<표\s*\d*>|\[표\s*\d*\]|상세표\s*참조|참조하시기 바랍니다|별첨|아래 표|다음 표와 같|해당 내용은.{0,20}기재)"
STANDARDS = r"(?U)(기업회계기준서|한국채택국제회계기준|K-?IFRS|기준서 제\s*\d{4}\s*호|해석서|회계정책|연결재무제표 작성|제ᆞ개정 기준서|제·개정 기준서)"
LAW = r"(?U)(제\s*\d+\s*조|자본시장법|상법|공정거래법|시행령|법률 제|규정 제\s*\d+)"
HEADING = r"(?U)^\s*(?:[가-힣]\s*\.|\d+\s*\.|\(\d+\)|[IVXivx]+\s*\.|[①-⑳])"
SENTENCE_END = r"(?U)(습니다|합니다|입니다|하였다|이다)\s*[.。]?\s*$"
NEGATIVE = ("미등기", "비상근", "아니오", "아니요", "n", "x", "해당없음", "없음", "-")
POSITIVE = ("등기임원", "사내이사", "사외이사", "감사위원", "감사", "예", "y", "o", "상근", "해당")
UNITS = {"조": 10**12, "억": 10**8, "백만": 10**6, "천": 10**3, "원": 1}
UNIT_IN_TEXT = r"(?U)(조|억|백만|천)\s*원"
NONE_TOKENS = ("해당사항 없음", "해당사항없음", "해당없음", "없음", "-", "N/A", "없습니다")
MATERIAL_TAGS = ("기재정정",)
ATTACHMENT_TAGS = ("첨부추가", "첨부정정", "첨부추가정정")
AMENDMENT = r"\[(기재정정|첨부정정|첨부추가|정정|연장결정|변경등록)\]"


def strip(col: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def _blank_artifacts(col: Column) -> Column:
    for p in (EDITOR_LABEL, TEMPLATE_FILE, BREAK_ENTITY):
        col = F.regexp_replace(col, p, " ")
    return col


def strip_artifacts(col: Column) -> Column:
    return strip(F.regexp_replace(_blank_artifacts(F.coalesce(col, F.lit(""))), " {2,}", " "))


def clean_text(col: Column, remove_artifacts: bool = True) -> Column:
    """Body text with notation noise removed; null becomes empty."""
    c = F.regexp_replace(drop_invisible(nfkc(F.coalesce(col, F.lit("")))), SPACE_LIKE, " ")
    if remove_artifacts:
        c = _blank_artifacts(c)
    c = F.regexp_replace(c, FOOTNOTE, " ")
    c = F.regexp_replace(c, r"(?Um)^[^\S\n]+|[^\S\n]+$", "")
    return strip(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"\n{3,}", "\n\n"))


def _python(pattern: str) -> re.Pattern:
    """A pattern of this module for Python, whose classes are those of Unicode anyway."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    return re.compile(body, sum(getattr(re, f.upper()) for f in (flags[1] if flags else "") if f != "U"))


_CLEANING = [(_python(p), " ") for p in (SPACE_LIKE, EDITOR_LABEL, TEMPLATE_FILE, BREAK_ENTITY, FOOTNOTE)]
_CLEANING += [(re.compile(r"(?m)^[^\S\n]+|[^\S\n]+$"), ""), (re.compile(" {2,}"), " "), (re.compile(r"\n{3,}"), "\n\n")]


def plain_clean(value: str | None) -> str:
    """``clean_text`` of one Python string, for texts that are made inside an Arrow step."""
    t = unicodedata.normalize("NFKC", value or "").translate(dict.fromkeys(map(ord, INVISIBLE)))
    for pattern, to in _CLEANING:
        t = pattern.sub(to, t)
    return t.strip()


def artifact_counts(col: Column) -> dict[str, Column]:
    return {"n_label": F.regexp_count(col, F.lit(EDITOR_LABEL)), "n_file": F.regexp_count(col, F.lit(TEMPLATE_FILE)), "n_entity": F.regexp_count(col, F.lit(BREAK_ENTITY))}


def strip_leading_number(col: Column) -> Column:
    """Up to two leading numbers removed."""
    return strip(F.regexp_replace(F.regexp_replace(col, LEADING_NUMBER, ""), LEADING_NUMBER, ""))


def norm_name(col: Column) -> Column:
    """Key under which variants of one section name agree."""
    c = strip(F.regexp_replace(drop_invisible(nfkc(F.coalesce(col, F.lit("")))), SPACE_LIKE, " "))
    return F.lower(F.regexp_replace(strip_leading_number(c), "(?U)" + NAME_NOISE, ""))


def paragraphs(col: Column, min_chars: int = 1) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"\n+"), strip)
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def words(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, also where lambdas below use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngram_sequence(s: Column, n: int) -> Column:
    """All character n-grams of a text in order; a shorter text has none."""
    none = F.array().cast("array<string>")
    return let(s, lambda x: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(none))


def char_ngrams(col: Column, n: int = 3) -> Column:
    """Distinct character n-grams without white space; a shorter text is its own only gram."""
    s = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", "")
    return let(s, lambda x: F.when(x == "", F.array().cast("array<string>")).when(F.length(x) < n, F.array(x)).otherwise(F.array_distinct(ngram_sequence(x, n))))


def mask_numbers(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\d[\d,.]*", "<NUM>")


def numbering_style(col: Column) -> Column:
    return F.when(col.rlike(ROMAN_HEAD), "roman").when(col.rlike(ARABIC_HEAD), "arabic").otherwise("none")


def paragraph_class(col: Column) -> Column:
    """moved, standards, law, heading or other; the first that holds."""
    t = strip(F.coalesce(col, F.lit("")))
    return (
        F.when(t == "", "other")
        .when(t.rlike(MOVED) & (F.length(t) <= 120), "moved")
        .when(t.rlike(STANDARDS), "standards")
        .when(t.rlike(LAW), "law")
        .when(t.rlike(HEADING) & (F.length(t) <= 80) & ~t.rlike(SENTENCE_END), "heading")
        .otherwise("other")
    )


def corp_name_key(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), LEGAL_FORM, ""), "(?U)" + CORP_NOISE, ""))


def tenure_months(col: Column) -> Column:
    t = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", "")
    pattern = r"^(?:(\d+)년)?(?:(\d+)(?:개월|월))?$"
    years, months = (F.regexp_extract(t, pattern, i) for i in (1, 2))
    whole = F.coalesce(years.try_cast("int"), F.lit(0)) * 12 + F.coalesce(months.try_cast("int"), F.lit(0))
    return F.when(t.rlike(pattern) & ((years != "") | (months != "")), whole.cast("double"))


def tri_bool(col: Column) -> Column:
    """False tokens are looked for first, by substring; null where neither kind occurs."""
    t = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", ""))
    has = lambda tokens: F.exists(F.array(*map(F.lit, tokens)), lambda x: F.contains(t, x))
    return F.when(t == "", None).when(has(NEGATIVE), False).when(has(POSITIVE), True)


def amount_unit(header: Column) -> Column:
    unit = F.regexp_extract(F.coalesce(header, F.lit("")), UNIT_IN_TEXT, 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit), F.lit(1))


def amount(cell: Column, header_unit: Column) -> Column:
    """First number of a cell in won; a unit in the cell beats the header's. Null without a number."""
    t = strip(F.coalesce(cell, F.lit("")))
    number = F.replace(F.regexp_extract(F.replace(t, F.lit(" "), F.lit("")), r"[-+]?[\d,]*\.?\d+", 0), F.lit(","), F.lit(""))
    unit = F.when(t.rlike(UNIT_IN_TEXT), amount_unit(t)).otherwise(header_unit)
    return number.try_cast("double") * unit


def squash(col: Column, colon: bool = False) -> Column:
    """White space and light punctuation removed, lower case; ``colon`` also drops colons."""
    return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)[\s()\[\]·ㆍ.,\-" + (":" if colon else "") + "]+", ""))


def none_marker(col: Column, max_len: int = 40) -> Column:
    """Whether a cell says that nothing applies: exactly, in normal form, or inside a short text."""
    raw, t = strip(F.coalesce(col, F.lit(""))), squash(col, colon=True)
    keys = F.filter(F.array(*[squash(F.lit(x), colon=True) for x in NONE_TOKENS]), lambda k: k != "")
    inside = (F.length(raw) <= max_len) & F.exists(keys, lambda k: F.contains(t, k))
    return (raw != "") & (raw.isin(*NONE_TOKENS) | ((t != "") & (F.array_contains(keys, t) | inside)))


def bracket_tags(col: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"\[([^\]]*)\]"), F.lit(1)), strip)


def report_type(col: Column) -> Column:
    """original, attachment_added or material_amendment; material tags beat attachment tags."""
    tags = bracket_tags(col)
    has = lambda names: F.exists(tags, lambda t: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(t, n)))
    return F.when(has(MATERIAL_TAGS), "material_amendment").when(has(ATTACHMENT_TAGS), "attachment_added").otherwise("original")


def report_reason(col: Column) -> Column:
    """Why a report has its type: the tags that told it, or that there is none or none known."""
    tags = bracket_tags(col)
    among = lambda names: F.filter(tags, lambda t: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(t, n)))
    told = lambda what, some: F.concat(F.lit(what), F.array_join(some, ", "))
    kind = report_type(col)
    return (
        F.when(F.size(tags) == 0, "no bracket")
        .when(kind == "material_amendment", told("body amended: ", among(MATERIAL_TAGS)))
        .when(kind == "attachment_added", told("attachment only: ", among(ATTACHMENT_TAGS)))
        .otherwise(told("unknown tag, taken as original: ", tags))
    )


def is_body_original(kind: Column) -> Column:
    return kind.isin("original", "attachment_added")


def is_amendment(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(AMENDMENT)


def period_part(col: Column, part: int) -> Column:
    """Year (1) or month (2) of a "(YYYY.MM)" period, or null."""
    return F.regexp_extract(F.coalesce(col, F.lit("")), r"\((\d{4})\.(\d{1,2})\)", part).try_cast("int")


def matches_annual(col: Column, include: tuple = ("사업보고서",), exclude: tuple = ("분기", "반기")) -> Column:
    nm = F.coalesce(col, F.lit(""))
    bare = F.regexp_replace(nm, AMENDMENT, "")
    some = lambda c, tokens: F.exists(F.array(*map(F.lit, tokens)), lambda x: F.contains(c, x))
    return some(nm, include) & ~some(bare, exclude)


def search_window(fy: Column) -> tuple[Column, Column]:
    return F.concat((fy + 1).cast("string"), F.lit("0101")), F.concat((fy + 2).cast("string"), F.lit("0630"))


def snippet(col: Column, n: int) -> Column:
    """Both ends of a text, n characters each; the whole if it is no longer than that."""
    flat = F.replace(F.coalesce(col, F.lit("")), F.lit("\n"), F.lit(" ⏎ "))
    return F.when(F.length(flat) <= 2 * n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit(" … "), F.right(flat, F.lit(n))))


def to_day(col: Column) -> Column:
    """A date from yyyymmdd, ISO dates or date-times; null otherwise."""
    t = strip(col.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")))
