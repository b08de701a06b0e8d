"""Similarity of texts, paragraph diffs and near-duplicate paragraphs across groups."""

from __future__ import annotations

import itertools
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions import text as X
from filamento.functions.udf import arrow
from filamento.operators import edits as E
from filamento.operators import minhash as M
from filamento.operators.sections import indel_ratio
from filamento.plans.runtime import key_counts, materialize, salted_join, spread

#: difflib is quadratic: texts longer than this have no ratio (null).
DIFF_CHARS = 20_000
#: Rows of a MinHash band: a pair at similarity 0.8 is missed with a chance of 1e-7.
BAND = 6


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


@arrow(T.DoubleType())
def difflib_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratio of matching blocks without the junk heuristic; null above DIFF_CHARS or for nulls."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        out.append(None if x is None or y is None or max(len(x), len(y)) > DIFF_CHARS else SequenceMatcher(None, x, y, autojunk=False).ratio())
    return pa.array(out, pa.float64())


_EDITS = T.StructType([T.StructField("levenshtein", T.DoubleType()), T.StructField("difflib", T.DoubleType())])


@arrow(_EDITS)
def edit_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """Levenshtein similarity and ratio of matching blocks without the junk heuristic, at any length; null for nulls."""
    sides = list(zip(a.to_pylist(), b.to_pylist()))
    held = list(dict.fromkeys(s for s in sides if None not in s))
    found = {s: {"levenshtein": 1 - d / (max(map(len, s)) or 1), "difflib": E.matching_ratio(*s)} for s, d in zip(held, E.distances(held))}
    return pa.array([found.get(s) for s in sides], pa.struct([("levenshtein", pa.float64()), ("difflib", pa.float64())]))


def diff(before: list[str], after: list[str]) -> dict:
    """Added, modified (new side) and removed paragraphs by longest matching blocks."""
    out: dict = {"added": [], "modified": [], "removed": [], "n_same": 0}
    for op, i, j, k, m in SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if op == "equal":
            out["n_same"] += j - i
        elif op == "insert":
            out["added"] += after[k:m]
        elif op == "delete":
            out["removed"] += before[i:j]
        else:
            out["modified"] += after[k:m]
            out["removed"] += before[i:j]
    return out


_DIFF = T.StructType([*(T.StructField(n, T.ArrayType(T.StringType())) for n in ("added", "modified", "removed")), T.StructField("n_same", T.IntegerType())])


@arrow(_DIFF)
def paragraph_diff(before: pa.Array, after: pa.Array) -> pa.Array:
    """Paragraph diff of two arrays; null counts as empty, null paragraphs as empty strings."""
    plain = lambda v: [p or "" for p in v or []]
    fields = [(n, pa.list_(pa.string())) for n in ("added", "modified", "removed")]
    return pa.array([diff(plain(x), plain(y)) for x, y in zip(before.to_pylist(), after.to_pylist())], pa.struct([*fields, ("n_same", pa.int32())]))


def tfidf_weights(docs: DataFrame, corpus: list[str], doc: list[str], text: str, n: int = 2) -> DataFrame:
    """(corpus, doc, gram, w): TF-IDF over character n-grams, one corpus per ``corpus`` value, written once.

    Lower case, runs of white space as one space; 1 + ln tf; ln((1 + N) / (1 + df)) + 1. Rows are not
    normalised. The way for vocabularies too large for IDF_ROWS; the frequencies of a gram join its rows by
    Spark's skew join.
    """
    s = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    tf = materialize(spread(docs, *corpus, *doc).select(*corpus, *doc, F.explode(X.ngram_sequence(s, n)).alias("gram")).groupBy(*corpus, *doc, "gram").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = tf.groupBy(*corpus, "gram").agg(F.count(F.lit(1)).alias("df"))
    size = docs.groupBy(*corpus).agg(F.countDistinct(*doc).alias("_n"))
    idf = df.join(size, corpus).select(*corpus, "gram", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return materialize(tf.join(idf, [*corpus, "gram"]).select(*corpus, *doc, "gram", ((1 + F.ln("tf")) * F.col("idf")).alias("w")), "tfidf")


def adjacent(docs: DataFrame, series: list[str], period: str) -> DataFrame:
    """(series, prev, cur): neighbouring available periods of each series (not always consecutive)."""
    w = Window.partitionBy(*series).orderBy(period)
    return docs.select(*series, period).distinct().withColumn("prev", F.lag(period).over(w)).where("prev is not null").select(*series, "prev", F.col(period).alias("cur"))


_SPARSE = T.StructType([T.StructField("g", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
#: Document frequencies of up to so many (section, gram) rows are sent to all tasks: 16 bytes each.
IDF_ROWS = 4_000_000


def _sparse(n: int):
    @arrow(_SPARSE)
    def sparse(texts: pa.Array) -> pa.Array:
        """Distinct character n-grams (n of at most 3, as integers) of each text, and how often each occurs."""
        out = []
        for t in texts.to_pylist():
            c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            g = sum(c[k : len(c) - n + 1 + k] << (21 * k) for k in range(n)) if len(c) >= n else np.zeros(0, np.int64)
            grams, tf = np.unique(g, return_counts=True)
            out.append({"g": grams, "tf": tf.astype(np.int32)})
        return pa.array(out, pa.struct([("g", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))]))

    return sparse


def tfidf_cosine(docs: DataFrame, *, entity: str, section: str, period: str, text: str, n: int = 2, idf_rows: int = IDF_ROWS) -> DataFrame:
    """(entity, section, prev, cur, cosine) of neighbouring periods, weights fitted per section.

    A document is one row with its n-grams as an array, and a pair is one product of two arrays. What
    all tasks need are the document frequencies: they are counted first, and broadcast where there
    are at most ``idf_rows`` of them; beyond that the weights are joined.
    """
    s = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    x = materialize(spread(docs, entity, section, period).select(entity, section, period, _sparse(n)(s).alias("x")), "sparse")
    counts = materialize(x.select(section, F.explode("x.g").alias("g")).groupBy(section, "g").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    if n > 3 or counts.count() > idf_rows:
        return _joined_cosine(docs, entity, section, period, text, n)
    sizes = {r[section]: r.n for r in x.groupBy(section).agg(F.count(F.lit(1)).alias("n")).collect()}
    held = counts.orderBy(section, "g").toArrow()
    names, g, df = held.column(section).to_pylist(), held.column("g").to_numpy(), held.column("df").to_numpy()
    table = {}
    for name, rows in itertools.groupby(range(len(names)), key=names.__getitem__):
        first, *rest = rows
        span = slice(first, first + 1 + len(rest))
        table[name] = (g[span], np.log((1 + sizes[name]) / (1 + df[span])) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @arrow(T.DoubleType())
    def cosine(sections: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for name, *sides in zip(sections.to_pylist(), a.to_pylist(), b.to_pylist()):
            grams, idf = shared.value.get(name, (np.zeros(0, np.int64), np.zeros(0)))
            (ga, wa), (gb, wb) = ((k := np.array(v["g"], np.int64), (1 + np.log(np.array(v["tf"], float))) * idf[np.searchsorted(grams, k)]) for v in sides)
            _, i, j = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
            norm = np.sqrt((wa @ wa) * (wb @ wb))
            out.append(float(wa[i] @ wb[j] / norm) if norm else 0.0)
        return pa.array(out, pa.float64())

    at = lambda p, c: x.select(entity, section, F.col(period).alias(p), F.col("x").alias(c))
    pairs = adjacent(x, [entity, section], period).join(at("prev", "_a"), [entity, section, "prev"]).join(at("cur", "_b"), [entity, section, "cur"])
    return pairs.select(entity, section, "prev", "cur", cosine(section, "_a", "_b").alias("cosine"))


def _joined_cosine(docs: DataFrame, entity: str, section: str, period: str, text: str, n: int) -> DataFrame:
    """The same by joins alone. Only the needed pairs meet: the earlier document's weights are moved to
    its successor's period and joined on (entity, section, period, gram)."""
    w = tfidf_weights(docs, [section], [entity, period], text, n)
    pairs = adjacent(docs, [entity, section], period)
    earlier = w.join(pairs.withColumnRenamed("prev", period), [entity, section, period]).select(entity, section, "cur", "gram", F.col("w").alias("v"))
    dots = w.withColumnRenamed(period, "cur").join(earlier, [entity, section, "cur", "gram"]).groupBy(entity, section, "cur").agg(F.sum(F.col("w") * F.col("v")).alias("_dot"))
    norms = w.groupBy(entity, section, period).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    at = lambda p: norms.select(entity, section, F.col(period).alias(p), F.col("_norm").alias(f"_{p}"))
    met = pairs.join(dots, [entity, section, "cur"], "left").join(at("cur"), [entity, section, "cur"], "left").join(at("prev"), [entity, section, "prev"], "left")
    return met.select(entity, section, "prev", "cur", F.coalesce(F.col("_dot") / (F.col("_cur") * F.col("_prev")), F.lit(0.0)).alias("cosine"))


MEASURES = ("cosine", "jaccard", "levenshtein", "difflib")


def _word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(X.words(a)), F.array_distinct(X.words(b)))


def change_rates(docs: DataFrame, *, entity: str, section: str, period: str, text: str) -> DataFrame:
    """Four similarities of neighbouring periods and the change (1 - similarity) of each."""
    cos = tfidf_cosine(docs, entity=entity, section=section, period=period, text=text)
    at = lambda p, t: docs.select(entity, section, F.col(period).alias(p), F.col(text).alias(t))
    both = cos.join(at("prev", "_a"), [entity, section, "prev"]).join(at("cur", "_b"), [entity, section, "cur"])
    out = both.select(entity, section, "prev", "cur", "cosine", _word_jaccard(F.col("_a"), F.col("_b")).alias("jaccard"), levenshtein_similarity(F.col("_a"), F.col("_b")).alias("levenshtein"), difflib_ratio("_a", "_b").alias("difflib"))
    return out.select("*", *[(1 - F.col(m)).alias(f"change_{m}") for m in MEASURES])


def cleaned_change_rates(docs: DataFrame, *, entity: str, section: str, period: str, text: str, clean: str) -> DataFrame:
    """(entity, section, prev, cur, {measure}_before, {measure}_after): changes of neighbouring periods by ``text`` and
    by ``clean``, its cleaned form.

    Texts of any length have all four measures. Only the cosine, whose weights are of all texts, is taken
    anew for every pair; the others follow from two texts, so they are taken again where cleaning moved one.
    """
    key = [entity, section, "prev", "cur"]
    cos = [tfidf_cosine(docs, entity=entity, section=section, period=period, text=t).withColumnRenamed("cosine", f"cosine_{v}") for t, v in ((text, "before"), (clean, "after"))]
    at = lambda p, s: docs.select(entity, section, F.col(period).alias(p), F.col(text).alias(f"_{s}"), F.when(~F.col(text).eqNullSafe(F.col(clean)), F.col(clean)).alias(f"_new_{s}"))
    both = cos[0].join(cos[1], key).join(at("prev", "a"), [entity, section, "prev"]).join(at("cur", "b"), [entity, section, "cur"])
    moved = F.col("_new_a").isNotNull() | F.col("_new_b").isNotNull()
    new = [F.when(moved, F.coalesce(f"_new_{s}", f"_{s}")) for s in "ab"]
    own = spread(both, *key).select(*key, "cosine_before", "cosine_after", moved.alias("_moved"), _word_jaccard(F.col("_a"), F.col("_b")).alias("jaccard_before"), F.when(moved, _word_jaccard(*new)).alias("_jaccard"), edit_ratios("_a", "_b").alias("_old"), edit_ratios(*new).alias("_new"))
    after = lambda then, before: F.when(F.col("_moved"), then).otherwise(before)
    told = own.withColumn("jaccard_after", after(F.col("_jaccard"), F.col("jaccard_before")))
    told = told.withColumns({f"{m}_before": F.col(f"_old.{m}") for m in ("levenshtein", "difflib")} | {f"{m}_after": after(F.col(f"_new.{m}"), F.col(f"_old.{m}")) for m in ("levenshtein", "difflib")})
    return told.select(*key, *[(1 - F.col(f"{m}_{v}")).alias(f"{m}_{v}") for m in MEASURES for v in ("before", "after")])


def set_changes(paras: DataFrame, *, entity: str, section: str, period: str, text: str, removed: bool = False) -> DataFrame:
    """Distinct paragraphs new against the year before (or gone from it), where both years exist.

    ``text`` should be masked and filtered by the caller. (entity, section, period, text); period is
    the later year.
    """
    have = paras.select(entity, section, period, text).distinct()
    years = paras.select(entity, section, period).distinct()
    shift = lambda df, k: df.withColumn(period, F.col(period) + k)
    pairs = years.join(shift(years, 1), [entity, section, period], "left_semi")
    now = shift(have, 1) if removed else have
    other = have if removed else shift(have, 1)
    return now.join(pairs, [entity, section, period], "left_semi").join(other, [entity, section, period, text], "left_anti")


@arrow(T.ArrayType(T.LongType()))
def _bands(texts: pa.Array) -> pa.Array:
    """MinHash bands of the 3-gram set of each text."""
    return pa.array([M.bands(M.signature(M.grams(t)), BAND) for t in texts.to_pylist()], pa.list_(pa.int64()))


@arrow(T.DoubleType())
def gram_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard similarity of the character 3-gram sets of two texts."""
    return pa.array([M.jaccard(M.grams(x), M.grams(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def near_texts(texts: DataFrame, text: str, threshold: float = 0.8, within: list[str] | None = None) -> DataFrame:
    """(within, a, b, similarity): pairs of different texts, a < b, at least ``threshold`` alike.

    Equal texts are one; MinHash bands propose pairs of texts of one ``within`` value, the 3-gram
    sets decide. A band value very many texts share is met through a join Spark may split, and each
    pair is checked once.
    """
    within = within or []
    one = spread(texts.where(F.col(text).isNotNull()).select(*within, F.col(text).alias("_t")).distinct(), *within, "_t")
    t = materialize(one.withColumn("uid", F.xxhash64(*within, "_t")).withColumn("bands", _bands("_t")), "near-texts")
    key = [*within, "band"]
    keyed = t.select("uid", *within, F.explode("bands").alias("band"))
    counts = materialize(key_counts(keyed, key).where("_n > 1"), "near-bands")
    shared = keyed.join(counts.drop("_n"), key, "left_semi")
    pairs = salted_join(shared, shared.withColumnRenamed("uid", "v"), key, counts=counts).where("uid < v").select(F.col("uid").alias("u"), "v").distinct()
    of = lambda u, c, *more: t.select(F.col("uid").alias(u), F.col("_t").alias(c), *more)
    met = pairs.join(of("u", "_a", *within), "u").join(of("v", "_b"), "v").withColumn("similarity", gram_jaccard("_a", "_b")).where(F.col("similarity") >= threshold)
    return met.select(*within, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity")


def common_paragraphs(changed: DataFrame, *, entity: str, scope: list[str], text: str, threshold: float = 0.8, exclude: DataFrame | None = None) -> DataFrame:
    """(scope, a_entity, b_entity, a, b, similarity): like paragraphs of different entities.

    Pairs include equal texts (similarity 1). ``exclude`` holds (a, b) entity pairs, a < b, to leave
    out, such as members of one group. Rows are distinct (scope, entity, text).
    """
    rows = materialize(changed.select(*scope, entity, text).distinct(), "changed")
    near = near_texts(rows, text, threshold, scope)
    equal = rows.groupBy(*scope, text).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*scope, F.col(text).alias("a"), F.col(text).alias("b"), F.lit(1.0).alias("similarity"))
    both = near.unionByName(near.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(equal)
    left = rows.select(*scope, F.col(entity).alias("a_entity"), F.col(text).alias("a"))
    right = rows.select(*scope, F.col(entity).alias("b_entity"), F.col(text).alias("b"))
    out = both.join(left, [*scope, "a"]).join(right, [*scope, "b"]).where("a_entity < b_entity")
    if exclude is not None:
        out = out.join(exclude.select(F.col("a").alias("a_entity"), F.col("b").alias("b_entity")), ["a_entity", "b_entity"], "left_anti")
    return out.select(*scope, "a_entity", "b_entity", "a", "b", "similarity")


def partner_counts(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, entity, text, n_partners) of listed pairs: distinct other entities that share a paragraph's like."""
    sides = pairs.select(*scope, F.col("a_entity").alias("entity"), F.col("a").alias("text"), F.col("b_entity").alias("other")).unionByName(pairs.select(*scope, F.col("b_entity").alias("entity"), F.col("b").alias("text"), F.col("a_entity").alias("other")))
    return sides.groupBy(*scope, "entity", "text").agg(F.countDistinct("other").alias("n_partners"))


class TextClasses:
    """Pairs of entities that share like paragraphs, counted from classes: texts x entities.

    ``rows`` are changed paragraphs, repeated ones counting in ``raw`` figures; a text and the
    entities that have it are a class. Texts alike by ``threshold`` (near_texts) are linked. No pair
    of entities is ever formed: what an equal or like text of k entities contributes follows from
    the sizes of classes and of the overlap of linked ones, which takes one row per entity.
    Everything is within one ``scope``.
    """

    def __init__(self, rows: DataFrame, *, entity: str, scope: list[str], text: str, threshold: float = 0.8):
        self.scope = scope
        told = rows.select(*scope, F.col(entity).alias("entity"), F.col(text).alias("text")).where("entity is not null and text is not null")
        self.rows = materialize(told.groupBy(*scope, "entity", "text").agg(F.count(F.lit(1)).alias("w")), "class-rows")
        size = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum_w"), F.sum(F.col("w") * F.col("w")).alias("sum_ww")]
        self.classes = materialize(self.rows.groupBy(*scope, "text").agg(*size), "classes")
        links = near_texts(self.classes.select(*scope, "text"), "text", threshold, scope)
        left = self.rows.select(*scope, F.col("text").alias("a"), "entity", F.col("w").alias("wa"))
        right = self.rows.select(*scope, F.col("text").alias("b"), "entity", F.col("w").alias("wb"))
        links = materialize(links, "class-links")
        both = links.select(*scope, "a", "b").join(left, [*scope, "a"]).join(right, [*scope, "b", "entity"]).groupBy(*scope, "a", "b").agg(F.count(F.lit(1)).alias("same"), F.sum(F.col("wa") * F.col("wb")).alias("same_ww"))
        of = lambda c: self.classes.select(*scope, F.col("text").alias(c), F.col("n").alias(f"n_{c}"), F.col("sum_w").alias(f"w_{c}"))
        sized = links.join(both, [*scope, "a", "b"], "left").join(of("a"), [*scope, "a"]).join(of("b"), [*scope, "b"]).na.fill(0, ["same", "same_ww"])
        self.links = materialize(sized, "class-links")

    def pairs(self) -> DataFrame:
        """(scope, a, b, similarity, n_pairs, n_raw): how many pairs of different entities a pair of
        texts stands for, equal texts among them; ``n_raw`` counts repeated paragraphs each time."""
        keep = [*self.scope, "a", "b", "similarity"]
        linked = self.links.select(*keep, (F.col("n_a") * F.col("n_b") - F.col("same")).alias("n_pairs"), (F.col("w_a") * F.col("w_b") - F.col("same_ww")).alias("n_raw"))
        half = lambda total, own: ((total - own) / 2).cast("bigint")
        equal = self.classes.where("n > 1").select(*self.scope, F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("similarity"), half(F.col("n") * F.col("n"), F.col("n")).alias("n_pairs"), half(F.col("sum_w") * F.col("sum_w"), F.col("sum_ww")).alias("n_raw"))
        return linked.unionByName(equal).where("n_pairs > 0")

    def _neighbours(self) -> DataFrame:
        """(scope, text, other) of linked texts, both ways."""
        ab = self.links.select(*self.scope, F.col("a").alias("text"), F.col("b").alias("other"))
        return ab.unionByName(ab.select(*self.scope, F.col("other").alias("text"), F.col("text").alias("other")))

    def partners(self) -> DataFrame:
        """(scope, entity, text, n_partners): distinct other entities that have the text or one like it.

        An entity is among those of its own text, so this is one less than the entities around the text."""
        around = self._neighbours().join(self.rows.select(*self.scope, F.col("text").alias("other"), "entity"), [*self.scope, "other"]).select(*self.scope, "text", "entity")
        near = around.unionByName(self.rows.select(*self.scope, "text", "entity")).groupBy(*self.scope, "text").agg((F.countDistinct("entity") - 1).alias("n_partners"))
        return self.rows.select(*self.scope, "entity", "text").join(near.where("n_partners > 0"), [*self.scope, "text"]).select(*self.scope, "entity", "text", "n_partners")

    def appearances(self) -> DataFrame:
        """(scope, entity, n_appearances, share): pairs an entity is a side of, and their share of all sides."""
        own = self.rows.join(self.classes.select(*self.scope, "text", "n"), [*self.scope, "text"]).groupBy(*self.scope, "entity").agg(F.sum(F.col("n") - 1).alias("c"))
        others = self._neighbours().join(self.classes.select(*self.scope, F.col("text").alias("other"), "n"), [*self.scope, "other"]).groupBy(*self.scope, "text").agg(F.sum("n").alias("c"))
        linked = self.rows.select(*self.scope, "entity", "text").join(others, [*self.scope, "text"]).groupBy(*self.scope, "entity").agg(F.sum("c").alias("c"))
        itself = self._neighbours().join(self.rows.select(*self.scope, "text", "entity"), [*self.scope, "text"]).join(self.rows.select(*self.scope, F.col("text").alias("other"), "entity"), [*self.scope, "other", "entity"]).groupBy(*self.scope, "entity").agg((-F.count(F.lit(1))).alias("c"))
        n = own.unionByName(linked).unionByName(itself).groupBy(*self.scope, "entity").agg(F.sum("c").alias("n_appearances")).where("n_appearances > 0")
        return n.withColumn("share", F.col("n_appearances") / F.sum("n_appearances").over(Window.partitionBy(*self.scope)))

    def labelled(self, label: Column) -> DataFrame:
        """(scope, label, n): pairs by the ``label`` (of column ``text``) of the side whose entity comes first.

        Only links between texts of different labels need the order of entities: a running count over
        the entities of both."""
        of = lambda c: self.classes.select(*self.scope, F.col("text").alias(c), label.alias(f"label_{c}"))
        told = materialize(self.pairs().join(of("a"), [*self.scope, "a"]).join(of("b"), [*self.scope, "b"]), "pair-labels")
        same = told.where(F.col("label_a").eqNullSafe(F.col("label_b"))).select(*self.scope, F.col("label_a").alias("label"), F.col("n_pairs").alias("n"))
        mixed = told.where(~F.col("label_a").eqNullSafe(F.col("label_b")))
        side = lambda c, of_a: mixed.select(*self.scope, "a", "b").join(self.rows.select(*self.scope, F.col("text").alias(c), "entity"), [*self.scope, c]).select(*self.scope, "a", "b", "entity", F.lit(of_a).alias("of_a"))
        ahead = Window.partitionBy(*self.scope, "a", "b").orderBy("entity").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ordered = side("a", 1).unionByName(side("b", 0)).withColumn("_a_before", F.sum("of_a").over(ahead)).groupBy(*self.scope, "a", "b", "entity").agg(F.max("of_a").alias("in_a"), F.count_if(F.col("of_a") == 0).alias("in_b"), F.max("_a_before").alias("before"))
        first = ordered.groupBy(*self.scope, "a", "b").agg(F.sum(F.when(F.col("in_b") > 0, F.col("before") - F.col("in_a")).otherwise(0)).alias("a_first"))
        split = mixed.join(first, [*self.scope, "a", "b"])
        parts = split.select(*self.scope, F.col("label_a").alias("label"), F.col("a_first").alias("n")).unionByName(split.select(*self.scope, F.col("label_b").alias("label"), (F.col("n_pairs") - F.col("a_first")).alias("n")))
        return same.unionByName(parts).groupBy(*self.scope, "label").agg(F.sum("n").alias("n")).where("n > 0")

    def top(self, most: int) -> DataFrame:
        """(scope, a_entity, b_entity, a, b, similarity): the ``most`` most similar pairs of each scope.

        Ties go by texts, then entities. Text pairs are taken until they stand for ``most`` pairs, and of
        the entities of each only the first ``most`` + 1 can be in them, so a hot text stays bounded."""
        order = Window.partitionBy(*self.scope).orderBy(F.desc("similarity"), "a", "b")
        enough = self.pairs().withColumn("_before", F.sum("n_pairs").over(order) - F.col("n_pairs")).where(F.col("_before") < most)
        rank = F.row_number().over(Window.partitionBy(*self.scope, "text").orderBy("entity"))
        firsts = self.rows.select(*self.scope, "text", "entity").withColumn("_r", rank).where(F.col("_r") <= most + 1).drop("_r")
        of = lambda c, e: firsts.select(*self.scope, F.col("text").alias(c), F.col("entity").alias(e))
        met = enough.join(of("a", "x"), [*self.scope, "a"]).join(of("b", "y"), [*self.scope, "b"]).where((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & (F.col("a") != F.col("b"))))
        ahead = F.col("x") < F.col("y")
        sided = met.select(*self.scope, F.least("x", "y").alias("a_entity"), F.greatest("x", "y").alias("b_entity"), F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("_a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("_b"), "similarity", "a", "b")
        best = F.row_number().over(Window.partitionBy(*self.scope).orderBy(F.desc("similarity"), "a", "b", "a_entity", "b_entity", "_a"))
        return sided.withColumn("_r", best).where(F.col("_r") <= most).select(*self.scope, "a_entity", "b_entity", F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity")


#: Notes to accounts that do not belong in a section, by section; ``default`` for the rest.
MARKERS = {
    "default": ("기대신용손실", "공정가치 서열체계", "금융상품의 범주", "이연법인세자산", "리스부채", "재무제표 작성기준", "한국채택국제회계기준", "손상차손", "유효이자율"),
    "S2": ("기대신용손실", "공정가치 서열체계", "금융상품의 범주", "유효이자율"),
}


def markers_for(section: Column, markers: dict[str, tuple[str, ...]] = MARKERS) -> Column:
    """Markers of a section; the default ones where it has none of its own."""
    listed = lambda names: F.array(*map(F.lit, names))
    own = F.create_map(*[c for k, v in markers.items() if k != "default" for c in (F.lit(k), listed(v))]) if len(markers) > 1 else None
    default = listed(markers["default"])
    return default if own is None else F.coalesce(F.try_element_at(own, section), default)


def contamination(paras: DataFrame, doc: list[str], text: str, markers: list[str] | Column) -> DataFrame:
    """Markers looked for, hits, distinct and found ones, and shares of dirty characters and paragraphs of each document."""
    listed = F.array(*map(F.lit, markers)) if isinstance(markers, list) else markers
    hit = F.filter(listed, lambda m: F.contains(F.col(text), m))
    p = paras.select(*doc, F.length(text).alias("_len"), hit.alias("_hit"), F.size(listed).alias("_used"))
    dirty = F.size("_hit") > 0
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_hit"))))
    sums = [F.max("_used").alias("n_markers_used"), F.sum(F.size("_hit")).alias("n_marker_hits"), found.alias("_found"), F.count_if(dirty).alias("n_dirty"), F.sum(F.when(dirty, F.col("_len")).otherwise(0)).alias("dirty_chars"), F.sum("_len").alias("total_chars"), F.count(F.lit(1)).alias("_n")]
    share = F.round(F.coalesce(F.try_divide("dirty_chars", "total_chars"), F.lit(0.0)), 4)
    return p.groupBy(*doc).agg(*sums).select(*doc, "n_markers_used", "n_marker_hits", F.size("_found").alias("n_distinct_markers"), F.array_join("_found", ", ").alias("markers_found"), "n_dirty", "dirty_chars", "total_chars", share.alias("share_chars"), F.round(F.col("n_dirty") / F.col("_n"), 4).alias("share_paras"))


ARTIFACTS = {"label": X.EDITOR_LABEL, "file": X.TEMPLATE_FILE, "entity": X.BREAK_ENTITY}


def artifact_coverage(units: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, artifact, n_units, n_hit, coverage, occurrences, removed_chars, mean_per_hit, share): how far each
    kind of editor residue reaches, and how many characters its removal takes."""
    each = units.select(*by, F.length(text).alias("_n"), F.explode(F.array(*[F.struct(F.lit(k).alias("artifact"), F.regexp_count(F.col(text), F.lit(p)).alias("n"), (F.length(text) - F.length(F.regexp_replace(text, p, ""))).alias("cut")) for k, p in ARTIFACTS.items()])).alias("x"))
    hit = F.col("x.n") > 0
    g = each.groupBy(*by, "x.artifact").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(hit).alias("n_hit"), F.sum("x.n").cast("bigint").alias("occurrences"), F.sum("x.cut").cast("bigint").alias("removed_chars"), F.avg(F.when(hit, F.col("x.cut"))).alias("mean_per_hit"), F.sum("_n").alias("_chars"))
    return g.select(*by, "artifact", "n_units", "n_hit", F.round(F.col("n_hit") / F.col("n_units"), 4).alias("coverage"), "occurrences", "removed_chars", F.round("mean_per_hit", 1).alias("mean_per_hit"), F.round(F.try_divide(F.col("removed_chars"), F.col("_chars")), 6).alias("share"))


#: Names up to this length are met by what is left of them without a few characters; longer ones by 2-grams.
SHORT_NAME = 60


def _shortened(most: int):
    @arrow(T.ArrayType(T.StringType()))
    def shortened(names: pa.Array) -> pa.Array:
        """What is left of each name without any ``most`` or fewer of its characters."""
        out = []
        for k in names.to_pylist():
            left = [{k}]
            for _ in range(most):
                left.append({s[:i] + s[i + 1 :] for s in left[-1] for i in range(len(s))})
            out.append(list(set().union(*left)))
        return pa.array(out, pa.list_(pa.string()))

    return shortened


def match_names(names: DataFrame, choices: DataFrame, *, key: str, name: str, choice: str, threshold: float = 92.0) -> DataFrame:
    """(key, name, choice, match_type, score): equal normal forms first, the rest by best similarity.

    The fuzzy part first pairs names with choices that are equal once the name has lost at most one
    character and the choice at most two, so grams that all names share pair nothing. No other choice
    can be as good as the best of these, or as the threshold, for most names. Those left meet the choices that share
    one of their rarest 2-grams (any pair of 92 percent or more shares a 2-gram, unless one has a single
    character), of which there are more than a good enough choice can lack.
    """
    n = names.select(key, name, X.corp_name_key(F.col(name)).alias("_k")).where("_k <> ''")
    c = choices.select(F.col(choice).alias("choice"), X.corp_name_key(F.col(choice)).alias("_c")).where("_c <> ''").groupBy("_c").agg(F.min("choice").alias("choice"))
    exact = n.join(c, n._k == c._c).select(key, name, "choice", F.lit("exact").alias("match_type"), F.lit(100.0).alias("score"))
    rest = n.join(c.select(F.col("_c").alias("_k")), "_k", "left_anti")
    keys = materialize(rest.select("_k").distinct(), "name-keys")
    cut = lambda df, col, most, longest: spread(df.where(F.length(col) <= longest).select(col), col).select(col, F.explode(_shortened(most)(col)).alias("_s")).select(col, F.xxhash64("_s").alias("_s"))
    met = cut(keys, "_k", 1, SHORT_NAME).join(cut(c, "_c", 2, SHORT_NAME + 2), "_s").select("_k", "_c").distinct()
    score = lambda pairs: spread(pairs, "_k", "_c").withColumn("score", _indel("_k", "_c")).where(F.col("score") >= threshold)
    first = lambda pairs: pairs.groupBy("_k").agg(F.max_by(F.struct("_c", "score"), F.struct("score", F.col("_c"))).alias("b"))
    near = materialize(keys.join(first(score(met)), "_k", "left"), "near-names")
    # The best score of a choice that lacks two characters of the name, and of one with three more.
    size, least = F.length("_k"), F.coalesce("b.score", F.lit(threshold))
    done = (size <= SHORT_NAME) & (least * (size - 1) > 100 * (size - 2)) & (least * (2 * size + 3) > 200 * size)
    right = c.select("_c", F.explode(X.char_ngrams(F.col("_c"), 2)).alias("g"))
    left = near.where(~done).select("_k", least.alias("_least"), F.explode(X.char_ngrams(F.col("_k"), 2)).alias("g")).distinct()
    # Of a name's 2-grams, a choice lacks two for each character it lacks and one for each it adds.
    lacking = F.when(F.col("_least") * 3 >= 200, F.floor(F.length("_k") * 4 * (100 - F.col("_least")) / (200 - F.col("_least")) + 1e-9)).otherwise(F.length("_k"))
    rarest = F.row_number().over(Window.partitionBy("_k").orderBy(F.coalesce("_n", F.lit(0)), "g"))
    left = left.join(right.groupBy("g").agg(F.count(F.lit(1)).alias("_n")), "g", "left").withColumn("_r", rarest).where(F.col("_r") <= lacking + 1)
    close = F.abs(F.length("_k") - F.length("_c")) * 100 <= (100 - F.col("_least")) * (F.length("_k") + F.length("_c")) + 1e-9
    far = score(left.join(right, "g").where(close).select("_k", "_c").distinct())
    best = near.where(done & F.col("b").isNotNull()).select("_k", "b").unionByName(first(far))
    fuzzy = rest.join(best, "_k").join(c, F.col("b._c") == c._c).select(key, name, "choice", F.lit("fuzzy").alias("match_type"), F.round("b.score", 4).alias("score"))
    return exact.unionByName(fuzzy)


@arrow(T.DoubleType())
def _indel(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.array([indel_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], float))
