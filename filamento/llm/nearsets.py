"""Groups of records whose sets of character n-grams are similar: a size-aware heavy-light join.

Equal sets are one class. A boundary on the size of sets is chosen by cost. Sets up to it are light:
each enumerates a fixed number of fixed-size subsets of its n-grams (picked by shared random orders,
so that similar sets pick equal subsets) and meets the sets that enumerate an equal one. Sets beyond
it are heavy: they scan the inverted lists of the rarest n-grams of all sets near their size, which
is exact. Every candidate pair is then verified on the whole sets.

A light pair at the threshold of 0.7 is missed with a chance below 1e-3, at 0.75 below 1e-5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions.udf import arrow
from filamento.plans.runtime import HOT_SHARE, key_counts, materialize, salted_join

SIMILAR = 0.7
LEAST_CHARS = 300
ORDERS, SIZE, SUBSETS = 256, 7, 112  # random orders; n-grams of a subset; subsets of a light set
SKETCH = 128  # orders whose first n-gram is kept in four bits, for a cheap estimate before verifying
LIST_BUCKETS = 1 << 17  # n-grams are hashed to so many counters of list length
SALTS = 24  # tasks over which a subset very many sets enumerate is split
# Costs in microseconds, rounded from runs: a set's subsets and their rows in the join, an n-gram under all
# orders, a posting sent, a posting met and counted.
COST_SUBSETS, COST_GRAM, COST_SENT, COST_POSTING = 230.0, 0.33, 0.5, 0.3

_SPACE = re.compile(r"\s+")
_RNG = np.random.default_rng(7)
_MULTIPLY = (_RNG.integers(0, 1 << 63, ORDERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_CHOSEN = np.array([np.sort(_RNG.choice(ORDERS, SIZE, replace=False)) for _ in range(SUBSETS)])
_POWERS = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, SUBSETS, dtype=np.uint64)


def gram_set(entries: list[str | None] | None) -> np.ndarray:
    """Sorted distinct character 3-grams of the entries without white space, packed exactly."""
    out = []
    for p in entries or []:
        if p:
            a = np.frombuffer(_SPACE.sub("", p).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if len(a) > 2:
                out.append((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def mixed(grams: np.ndarray) -> np.ndarray:
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def firsts(grams: np.ndarray) -> np.ndarray:
    """The first n-gram (as a 32-bit value) of a set under each random order."""
    x = mixed(grams)
    out = np.full(ORDERS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(x), 4096):
        out = np.minimum(out, ((x[None, i : i + 4096] * _MULTIPLY[:, None]) >> np.uint64(32)).min(1))
    return out


def subsets(first: np.ndarray) -> np.ndarray:
    """Hashes of the enumerated subsets."""
    with np.errstate(over="ignore"):
        h = (first[_CHOSEN] * _POWERS[None]).sum(1, dtype=np.uint64) ^ _SALT
        h *= np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def sketch(first: np.ndarray) -> bytes:
    low = (first[:SKETCH] & np.uint64(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


_SET = T.StructType([T.StructField("key", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("subsets", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("lists", T.BinaryType())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per set; and one row without a key that counts the sets of each n-gram bucket."""
    lists = np.zeros(LIST_BUCKETS, np.int64)
    for b in batches:
        rows = []
        for key, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            g = gram_set(entries)
            if len(g):
                f = firsts(g)
                lists += np.bincount((mixed(g) >> np.uint64(47)).astype(np.int64), minlength=LIST_BUCKETS)
                rows.append((key, hashlib.blake2b(g.tobytes(), digest_size=16).digest(), len(g), subsets(f), sketch(f), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _ARROW)], _SET.names)
    at = np.flatnonzero(lists).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([None], t) if n != "lists" else pa.array([at.tobytes() + lists[at].astype(np.int32).tobytes()], t) for n, t in zip(_SET.names, _ARROW)], _SET.names)


_ARROW = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())


@arrow(T.ArrayType(T.StructType([T.StructField("b", T.IntegerType()), T.StructField("c", T.IntegerType())])))
def _unpacked(lists: pa.Array) -> pa.Array:
    out = []
    for v in lists.to_pylist():
        a = np.frombuffer(v, np.int32)
        out.append([{"b": int(x), "c": int(y)} for x, y in zip(a[: len(a) // 2], a[len(a) // 2 :])])
    return pa.array(out, pa.list_(pa.struct([("b", pa.int32()), ("c", pa.int32())])))


def boundary(sizes: list[tuple[int, int]], rare_list: float, n_sets: int, similar: float = SIMILAR) -> int:
    """Greatest light size: the one with the least cost of enumerating below and scanning above it.

    ``sizes`` is a histogram (size, sets) of bounded length; ``rare_list`` the mean list length of
    the n-grams in prefixes. A heavy set scans the part of its lists that sets near its size hold, and
    all sets that may be near a heavy one send their prefixes.
    """
    sizes = sorted(sizes)
    prefix = lambda n: (1 - similar) * n + 1
    near = [sum(c for m, c in sizes if similar * n <= m <= n / similar) for n, _ in sizes]
    light = [c * (COST_SUBSETS + COST_GRAM * n) for n, c in sizes]
    heavy = [c * COST_POSTING * prefix(n) * rare_list * w / max(1, n_sets) for (n, c), w in zip(sizes, near)]
    sent = [sum(c * COST_SENT * prefix(n) for n, c in sizes if n >= similar * first) for first, _ in sizes] + [0.0]
    costs = [sum(light[:i]) + sum(heavy[i:]) + sent[i] for i in range(len(sizes) + 1)]
    best = min(range(len(costs)), key=lambda i: (costs[i], -i))
    return sizes[best - 1][0] if best else 0


def classes(rows: DataFrame, key: str, entries: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Written rows of every set (repeated deliveries too) and the counters of list lengths."""
    chars = F.aggregate(F.coalesce(entries, F.array().cast("array<string>")), F.lit(0), lambda s, p: s + F.coalesce(F.length(p), F.lit(0)))
    long_enough = rows.where(F.col(key).isNotNull() & (chars >= least_chars)).select(F.col(key).cast("bigint"), entries)
    return materialize(long_enough.mapInArrow(_sets, _SET), "near-sets")


def similar_pairs(rows: DataFrame, key: str, entries: str, similar: float = SIMILAR, least_chars: int = LEAST_CHARS, light_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of class representatives, and (key, rep) of all rows.

    A representative is the least key of its class. Rows with fewer than ``least_chars`` characters
    in all, without an n-gram or without a key are in no class. Null and empty entries add nothing.
    ``light_size`` overrides the boundary chosen by cost.
    """
    sets = classes(rows, key, entries, least_chars)
    keyed = sets.where("key is not null")
    reps = keyed.groupBy("cls").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("subsets").alias("subsets"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "near-classes")
    members = keyed.select("cls", "key").distinct().join(reps.select("cls", "rep"), "cls").select("key", "rep")
    lists = np.zeros(LIST_BUCKETS)
    counted = sets.where("key is null").select(F.explode(_unpacked("lists")).alias("x")).groupBy("x.b").agg(F.sum("x.c").alias("c")).toArrow()
    lists[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    if light_size is None:
        light_size = _boundary(reps, lists, similar)
    near = _sketched(_light(reps.where(F.col("n") <= light_size)), reps, similar)
    if not reps.where(F.col("n") > light_size).isEmpty():
        near = near.unionByName(_heavy(rows, key, entries, reps, lists, light_size, similar))
    return _verified(near, rows, key, entries, similar), members


def _light(sets: DataFrame) -> DataFrame:
    """Pairs of sets that enumerate an equal subset. A subset that 1/HOT_SHARE of the sets enumerate is
    split over tasks; one that a single set enumerates meets nothing and is dropped before the join."""
    light = sets.select("rep", F.explode("subsets").alias("s"))
    counts = key_counts(light, ["s"]).where("_n > 1")
    shared = materialize(light.join(counts, "s").select("s", "rep", "_n"), "near-subsets")
    total = sets.agg(F.count(F.lit(1)).alias("n")).scalar()
    # every set counts once for each of its subsets
    hot = F.col("_n") * HOT_SHARE >= total
    salt = F.when(hot, F.pmod(F.col("rep"), F.lit(SALTS)).cast("int")).otherwise(0)
    left = shared.select("s", F.col("rep").alias("a"), salt.alias("salt"))
    right = shared.select("s", F.col("rep").alias("b"), F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return left.join(right, ["s", "salt"]).where("a < b").select("a", "b").distinct()


def _boundary(reps: DataFrame, lists: np.ndarray, similar: float) -> int:
    # sizes in steps of a twelfth: a histogram of bounded length
    step = F.ceil(F.log("n") / F.log(F.lit(1 + 1 / 12)))
    sizes = [(int(r.top), int(r.c)) for r in reps.groupBy(step.alias("s")).agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("c")).collect()]
    held = np.sort(lists[lists > 0])
    mass = np.cumsum(held)
    rare = held[: int(np.searchsorted(mass, mass[-1] * (1 - similar))) + 1] if len(held) else np.zeros(1)
    mean = float((rare * rare).sum() / max(1.0, rare.sum()))
    return boundary(sizes, mean, sum(c for _, c in sizes), similar)


_POSTING = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("gram", T.LongType())])


def _heavy(rows: DataFrame, key: str, entries: str, reps: DataFrame, lists: np.ndarray, light_size: int, similar: float) -> DataFrame:
    """Pairs with a heavy set that share one of the rarest n-grams of both (prefix filter: exact).

    A pair is proposed if it shares enough of them: all sets order their n-grams alike, so what is common
    beyond the prefix that ends first lies in the rest of that set. The count is exact, no estimate."""
    least = int(np.ceil(similar * (light_size + 1) - 1e-9))
    wanted = reps.where(F.col("n") >= least).select(F.col("rep").alias(key), "n")
    texts = wanted.join(rows.select(key, entries), key).groupBy(key).agg(F.first(entries).alias(entries))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps_, ns, gs = [], [], []
            for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = gram_set(e)
                x = mixed(g)
                keep = len(g) - int(np.ceil(similar * len(g) - 1e-9)) + 1
                at = np.lexsort((x, lists[(x >> np.uint64(47)).astype(np.int64)]))[:keep]
                gs.append(g[at].view(np.int64))
                reps_.append(np.full(len(at), k, np.int64))
                ns.append(np.full(len(at), len(g), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else []).cast(t) for c, t in ((reps_, pa.int64()), (ns, pa.int32()), (gs, pa.int64()))], _POSTING.names)

    scanned = materialize(texts.mapInArrow(postings, _POSTING), "near-postings")
    big = scanned.where(F.col("n") > light_size)
    other = scanned.select(F.col("rep").alias("rep2"), F.col("n").alias("n2"), "gram")
    # two heavy sets meet once
    once = (F.col("n2") <= light_size) | (F.col("rep") < F.col("rep2"))
    near = F.least("n", "n2") >= similar * F.greatest("n", "n2") - 1e-9
    met = salted_join(other, big, ["gram"]).where(once & near & (F.col("rep") != F.col("rep2")))
    rest = lambda n: F.ceil(similar * F.col(n) - 1e-9) - 1
    enough = F.col("common") >= similar / (1 + similar) * (F.col("n") + F.col("n2")) - F.greatest(rest("n"), rest("n2")) - 1e-6
    shared = met.groupBy("rep", "rep2").agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"), F.first("n2").alias("n2")).where(enough)
    return shared.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))


@arrow(T.DoubleType())
def _estimate(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (a, b))
    d = x ^ y
    return pa.array(((d < 16).sum(1) + ((d & 15) == 0).sum(1)) / SKETCH)


@arrow(T.DoubleType())
def _similarity(a: pa.Array, x: pa.Array, b: pa.Array, y: pa.Array) -> pa.Array:
    """Exact similarity of records ``a`` and ``b`` with entries ``x`` and ``y``; a record's set is made once a batch."""
    sets: dict[int, np.ndarray] = {}
    for keys, values in ((a, x), (b, y)):
        ids = keys.to_numpy()
        found, first = np.unique(ids, return_index=True)
        new = [k not in sets for k in found.tolist()]
        for k, entries in zip(found[new].tolist(), values.take(pa.array(first[new])).to_pylist()):
            sets[k] = gram_set(entries)
    out = []
    for p, q in zip(a.to_pylist(), b.to_pylist()):
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        out.append(both / (len(sets[p]) + len(sets[q]) - both))
    return pa.array(out, pa.float64())


def _sketched(pairs: DataFrame, reps: DataFrame, similar: float) -> DataFrame:
    """Light pairs that a four-bit sketch does not rule out.

    The sketch's estimate has a standard deviation below 0.044; pairs 4.5 of them under the
    threshold are dropped, so it loses less than the subsets do. Heavy pairs don't pass here.
    """
    s = reps.select("rep", "n", "sketch")
    at = lambda c: s.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    rough = pairs.join(at("a"), "a").join(at("b"), "b").where(F.least("n_a", "n_b") >= similar * F.greatest("n_a", "n_b") - 1e-9)
    expected = similar + (1 - similar) / 16
    return rough.where(_estimate("s_a", "s_b") >= expected - 4.5 * 0.042).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, key: str, entries: str, similar: float) -> DataFrame:
    """Pairs whose exact similarity is reached."""
    near = materialize(pairs, "near-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    texts = materialize(wanted.join(rows.select(F.col(key).cast("bigint").alias(key), entries), key).groupBy(key).agg(F.first(entries).alias(entries)), "near-texts")
    of = lambda c: texts.select(F.col(key).alias(c), F.col(entries).alias(f"e_{c}"))
    exact = near.join(of("a"), "a").join(of("b"), "b").withColumn("similarity", _similarity("a", "e_a", "b", "e_b"))
    return exact.where(F.col("similarity") >= similar - 1e-12).select("a", "b", "similarity")


def expanded(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b) of all similar rows: pairs of classes for all their members, and equal sets."""
    left, right = members.select(F.col("rep").alias("a"), F.col("key").alias("x")), members.select(F.col("rep").alias("b"), F.col("key").alias("y"))
    across = salted_join(salted_join(left, pairs.select("a", "b"), ["a"]), right, ["b"]).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    copied = members.where("key <> rep").select("rep").distinct()
    alike = members.join(copied, "rep", "left_semi")
    within = salted_join(alike, alike.select("rep", F.col("key").alias("other")), ["rep"]).where("key < other").select(F.col("key").alias(f"{key}_a"), F.col("other").alias(f"{key}_b"))
    return across.unionByName(within)


def groups(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, class_id, group_id, n_links): one row per record; groups are connected components.

    Every record takes the least label among itself, its neighbours and its label's own label
    (pointer jumping), until none changes; edges and labels are written tables, and the minimum over
    a hub's neighbours combines map-side. ``n_links`` counts other classes.
    """
    edges = materialize(pairs.select("a", "b"), "near-edges")
    links = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("label")), "near-labels")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        heard = both.join(labels.select(F.col("v").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("heard"))
        hop = labels.join(heard.select(F.col("b").alias("v"), "heard"), "v").select("v", F.least("label", "heard").alias("new"), "label")
        # pointer jumping: take the label of one's label
        jumped = hop.join(hop.select(F.col("v").alias("new"), F.col("new").alias("_far")), "new", "left").select("v", F.coalesce(F.least("new", "_far"), "new").alias("label"), (F.coalesce(F.least("new", "_far"), F.col("new")) != F.col("label")).alias("changed"))
        labels = materialize(jumped, "near-labels")
        if labels.where("changed").isEmpty():
            break
        labels = labels.select("v", "label")
    found = members.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").join(links, "rep", "left")
    return found.select(F.col("key").alias(key), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
