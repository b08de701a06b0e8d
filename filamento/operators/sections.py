"""Sections of a filing from its block sequence, in relational steps."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions import text as X
from filamento.functions.udf import arrow
from filamento.functions.unicode import nfkc

# Standard contents of an annual report, with the variants of each name.
STANDARD = {
    "회사의 개요": (),
    "사업의 내용": (),
    "재무에 관한 사항": (),
    "감사인의 감사의견 등": ("회계감사인의 감사의견 등", "감사인의 감사의견"),
    "이사의 경영진단 및 분석의견": (),
    "이사회 등 회사의 기관에 관한 사항": ("이사회 등 회사의 기관 및 계열회사에 관한 사항",),
    "주주에 관한 사항": (),
    "임원 및 직원 등에 관한 사항": ("임원 및 직원에 관한 사항",),
    "계열회사 등에 관한 사항": (),
    "이해관계자와의 거래내용": (),
    "대주주 등과의 거래내용": (),
    "그 밖에 투자자 보호를 위하여 필요한 사항": (),
    "재무제표 등": ("재무제표",),
    "부속명세서": (),
    "전문가의 확인": (),
    "상세표": (),
}
TARGETS = {"S1": "사업의 내용", "S2": "이사의 경영진단 및 분석의견", "S3": "그 밖에 투자자 보호를 위하여 필요한 사항", "S4": "임원 및 직원 등에 관한 사항"}
EOF = "EOF"
_NOISE = re.compile(X.NAME_NOISE)
_LEADING = re.compile(X.LEADING_NUMBER.replace("(?U)", ""))


def _key(name: str) -> str:
    """The key text.norm_name gives a plain name; its number step may take a first syllable (사업 to 업)."""
    return _NOISE.sub("", _LEADING.sub("", _LEADING.sub("", name))).lower()


KEYS = {_key(v): name for name, variants in STANDARD.items() for v in (name, *variants)}


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one integer holds a whole row of the table."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    gaps = full
    for c in a:
        hits = gaps & places.get(c, 0)
        gaps = (gaps + hits | gaps - hits) & full
    return len(b) - gaps.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Normalised insert-delete similarity in percent: twice the common subsequence by both lengths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_key(key: str | None, threshold: float) -> str | None:
    """Standard name whose key is most alike, if alike enough; the first of equals."""
    if not key:
        return None
    best, score = None, 0.0
    for k, name in KEYS.items():
        if 200.0 * min(len(k), len(key)) / (len(k) + len(key)) >= threshold and (s := indel_ratio(key, k)) > score:
            best, score = name, s
    return best if score >= threshold else None


def _fuzzy(threshold: float):
    @arrow(T.StringType())
    def match(keys: pa.Array) -> pa.Array:
        seen: dict = {}
        return pa.array([seen[k] if k in seen else seen.setdefault(k, best_key(k, threshold)) for k in keys.to_pylist()], pa.string())

    return match


def section_name(text: Column, threshold: float | None = 97.0) -> Column:
    """Standard section a header block names, or null: at most 60 characters, exact on the key, else
    by similarity (``threshold`` None leaves that out). Only short unmatched blocks reach Python."""
    key = X.norm_name(text)
    usable = (F.length(text) > 0) & (F.length(text) <= 60) & (F.length(key) >= 3)
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv]), key)
    out = F.when(usable, exact)
    return out if threshold is None else F.coalesce(out, _fuzzy(threshold)(F.when(usable & exact.isNull(), key)))


def header_candidates(blocks: DataFrame, threshold: float | None = 97.0) -> DataFrame:
    """(doc, idx, name, text, style) of text blocks that name a standard section."""
    b = blocks.where("kind = 'text'").select("doc", "idx", "text").withColumn("name", section_name(F.col("text"), threshold))
    return b.where("name is not null").withColumn("style", X.numbering_style(nfkc(F.col("text"))))


def spans(blocks: DataFrame, threshold: float | None = 97.0, roman_least: int = 3) -> DataFrame:
    """(doc, name, start, end, start_header, end_header, end_reason) of every section start.

    In documents with at least three roman-numbered candidates only those start sections. A section
    ends at the next candidate of another name, whatever its numbering; without one it runs to EOF.
    """
    c = header_candidates(blocks, threshold)
    doc, order = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("idx")
    c = c.withColumn("_roman", F.count_if(F.col("style") == "roman").over(doc)).withColumn("_new", (~F.col("name").eqNullSafe(F.lag("name").over(order))).cast("int"))
    c = c.withColumn("_run", F.sum("_new").over(order))
    following = Window.partitionBy("doc").orderBy("_run").rangeBetween(1, 1)
    c = c.withColumn("_next", F.min(F.struct("idx", "name", "text")).over(following))
    sizes = blocks.groupBy("doc").agg((F.max("idx") + 1).alias("_n"))
    s = c.where((F.col("_roman") < roman_least) | (F.col("style") == "roman")).join(sizes, "doc")
    return s.select("doc", "name", F.col("idx").alias("start"), F.coalesce("_next.idx", "_n").alias("end"), F.col("text").alias("start_header"), F.coalesce("_next.text", F.lit("")).alias("end_header"), F.coalesce("_next.name", F.lit(EOF)).alias("end_reason"))


def merged(paragraphs: Column, min_chars: int = 10, most: int = 2000) -> Column:
    """Short or punctuation-only pieces joined to the paragraph before (leading ones to the first
    after); a paragraph that would grow beyond ``most`` stays, and the piece opens a new one."""
    punctuation = r"^[\s()\[\]{}<>·ㆍ・,.:;\-–—_/\\|~!@#$%^&*+='\"’‘“”]*$"
    empty = F.array().cast("array<string>")
    pieces = F.filter(F.transform(F.coalesce(paragraphs, empty), X.strip), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        out, head = acc["out"], acc["head"]
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit(" "), p)))
        short = (F.length(p) < min_chars) | p.rlike("(?U)" + punctuation)
        whole = F.when(head == "", p).otherwise(F.concat(head, F.lit(" "), p))
        has = F.size(out) > 0
        fits = has & (F.length(F.try_element_at(out, F.lit(-1))) + 1 + F.length(p) <= most)
        return F.struct(
            F.when(~short, F.concat(out, F.array(whole))).when(fits, joined).when(has, F.concat(out, F.array(p))).otherwise(out).alias("out"),
            F.when(~short, F.lit("")).when(has, head).when(head == "", p).otherwise(F.concat(head, F.lit(" "), p)).alias("head"),
        )

    start = F.struct(empty.alias("out"), F.lit("").alias("head"))
    return F.aggregate(pieces, start, step, lambda a: F.when(a["head"] == "", a["out"]).otherwise(F.array(a["head"])))


def captions(blocks: DataFrame, most: int = 120) -> DataFrame:
    """(doc, idx, caption): of each table block the text block before it, if it is short."""
    before = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    c = blocks.withColumn("_before", F.last(F.when((F.col("kind") == "text") & (F.length("text") > 0), F.col("text")), True).over(before))
    return c.where("kind = 'table'").select("doc", "idx", F.when(F.length("_before") <= most, F.col("_before")).alias("caption"))


def orphan_captions(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, section_id, n, orphan_chars): paragraphs left in a section that are captions of the
    document's tables. ``tables`` holds (doc, caption); null captions are none."""
    told = tables.where("caption is not null").select("doc", F.col("caption").alias("_p")).distinct()
    p = sections.select("doc", "section_id", F.explode("paragraphs").alias("_p"))
    return p.join(told, ["doc", "_p"], "left_semi").groupBy("doc", "section_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_p")).cast("bigint").alias("orphan_chars"))


def extract(blocks: DataFrame, targets: dict[str, str] = TARGETS, *, threshold: float | None = 97.0, require_terminator: bool = True, min_chars: int = 10) -> DataFrame:
    """One row per document and target section: the longest of its spans (the first of equals).

    A document without the header still has its row, with found false. A section that runs to the
    end is demoted to found false, its body kept (``has_body``). Short pieces are merged.
    """
    wanted = F.create_map(*[F.lit(x) for sid, name in targets.items() for x in (name, sid)])
    s = spans(blocks, threshold).withColumn("section_id", F.try_element_at(wanted, F.col("name"))).where("section_id is not null")
    inside = s.join(blocks.select("doc", "idx", "kind", F.col("text").alias("_text")), "doc").where("idx > start and idx < end")
    body = inside.groupBy("doc", "section_id", "start").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") == "text") & (F.length("_text") > 0), F.struct("idx", "_text")))).alias("_p"),
        F.sum(F.length("_text")).alias("_score"),
        F.count_if(F.col("kind") == "table").alias("n_tables"),
        F.sum(F.when(F.col("kind") == "table", F.length("_text"))).alias("table_chars"),
    )
    scored = s.join(body, ["doc", "section_id", "start"], "left").withColumn("_rank", F.row_number().over(Window.partitionBy("doc", "section_id").orderBy(F.desc(F.coalesce("_score", F.lit(0))), "start"))).where("_rank = 1")
    lines = F.flatten(F.transform(F.coalesce("_p", F.array()), lambda x: X.paragraphs(x["_text"])))
    best = scored.withColumn("paragraphs", merged(lines, min_chars) if min_chars else lines)
    every = blocks.select("doc").distinct().withColumn("section_id", F.explode(F.array(*map(F.lit, targets))))
    out = every.join(best, ["doc", "section_id"], "left")
    has_body = F.coalesce(F.size("paragraphs") > 0, F.lit(False))
    found = has_body & (F.lit(not require_terminator) | (F.col("end_reason") != EOF))
    return out.select("doc", "section_id", F.coalesce(found, F.lit(False)).alias("found"), has_body.alias("has_body"), F.array_join("paragraphs", "\n").alias("text"), "paragraphs", F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.coalesce("table_chars", F.lit(0)).alias("table_chars"), "start_header", "end_header", F.coalesce("end_reason", F.lit("no start header")).alias("end_reason"))


def extract_old(blocks: DataFrame, targets: dict[str, str] = TARGETS, *, threshold: float | None = 92.0) -> DataFrame:
    """The older rule: any candidate ends a section, similarity of 92 suffices, EOF is no fault and
    short pieces stay. (doc, section_id, found, chars, end_reason, start_header, end_header, paragraphs)."""
    c = header_candidates(blocks, threshold)
    order = Window.partitionBy("doc").orderBy("idx")
    wanted = F.create_map(*[F.lit(x) for sid, name in targets.items() for x in (name, sid)])
    c = c.withColumns({"end": F.lead("idx").over(order), "end_reason": F.coalesce(F.lead("name").over(order), F.lit(EOF)), "end_header": F.coalesce(F.lead("text").over(order), F.lit(""))}).withColumn("section_id", F.try_element_at(wanted, F.col("name"))).where("section_id is not null")
    inside = c.select("doc", "section_id", F.col("idx").alias("start"), "end", "end_reason", F.col("text").alias("start_header"), "end_header").join(blocks.select("doc", "kind", F.col("idx").alias("i"), F.col("text").alias("_text")), "doc").where("i > start and (end is null or i < end)")
    told = F.sort_array(F.collect_list(F.when((F.col("kind") == "text") & (F.length("_text") > 0), F.struct("i", "_text")))).alias("_p")
    sums = inside.groupBy("doc", "section_id", "start").agg(F.sum(F.length("_text")).alias("chars"), told, *[F.first(x).alias(x) for x in ("end_reason", "start_header", "end_header")])
    best = F.max_by(F.struct("chars", "end_reason", "start_header", "end_header", "_p"), F.struct("chars", -F.col("start"))).alias("b")
    lines = F.flatten(F.transform(F.coalesce("b._p", F.array()), lambda x: X.paragraphs(x["_text"])))
    return sums.groupBy("doc", "section_id").agg(best).select("doc", "section_id", (F.col("b.chars") > 0).alias("found"), "b.chars", "b.end_reason", "b.start_header", "b.end_header", lines.alias("paragraphs"))


def variants(blocks: DataFrame, targets: dict[str, str] = TARGETS, *, threshold: float | None = 97.0, old_threshold: float | None = 92.0, min_chars: int = 10) -> DataFrame:
    """(variant, doc, section_id, found, end_reason, start_header, end_header, paragraphs): the sections with a
    body under both rules, ``new`` and ``old``, one below the other."""
    keep = ["doc", "section_id", "found", "end_reason", "start_header", "end_header", "paragraphs"]
    new = extract(blocks, targets, threshold=threshold, min_chars=min_chars).where("has_body").select(F.lit("new").alias("variant"), *keep)
    old = extract_old(blocks, targets, threshold=old_threshold).where(F.size("paragraphs") > 0).select(F.lit("old").alias("variant"), *keep)
    return new.unionByName(old)


def with_every_section(docs: DataFrame, sections: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """(doc, section_id, found, chars): one row per document and target section, also of documents whose
    parsing failed, so that rates keep their denominator. ``sections`` is (doc, section_id, found, text)."""
    every = docs.select("doc").where("doc is not null").distinct().withColumn("section_id", F.explode(F.array(*map(F.lit, targets))))
    told = sections.groupBy("doc", "section_id").agg(F.bool_or("found").alias("found"), F.max(F.length("text")).alias("chars"))
    return every.join(told, ["doc", "section_id"], "left").select("doc", "section_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("chars", F.lit(0)).alias("chars"))


def length_panel(filings: DataFrame, lengths: DataFrame, key: str, keep: list[str], columns: dict[str, str]) -> DataFrame:
    """(keep, section_id, log_chars): the lengths of a filing's sections, one column each in ``lengths``
    (``columns`` maps them to sections), as long rows with the filing's ``keep`` columns; only positive lengths."""
    wide = filings.select(key, *keep).join(lengths, key)
    long = wide.select(*keep, F.explode(F.array(*[F.struct(F.lit(s).alias("section_id"), F.col(c).cast("bigint").alias("n")) for c, s in columns.items()])).alias("x"))
    return long.where("x.n > 0").select(*keep, "x.section_id", F.ln("x.n").alias("log_chars"))


def derived_clean(paragraphs: Column, min_chars: int = 10) -> Column:
    """The clean variant of raw paragraphs: residue stripped, emptied ones dropped, pieces merged."""
    kept = F.filter(F.transform(F.coalesce(paragraphs, F.array().cast("array<string>")), X.strip_artifacts), lambda p: p != "")
    return merged(kept, min_chars)


def parse_ok(sections: DataFrame, least: int = 1) -> DataFrame:
    """(doc, n_found, ok): documents with at least ``least`` found sections that have text."""
    n = F.count_if(F.col("found") & (F.length("text") > 0)).alias("n_found")
    return sections.groupBy("doc").agg(n).withColumn("ok", F.col("n_found") >= least)
