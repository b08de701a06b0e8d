"""Template residue and error-page text.

Entries are cut into sentences; digits are masked, and equal sentences are one unit. A labelled table
and rules give trusted labels to units. Units near a labelled one meet it in a SimHash table, are
verified by Hamming distance and 3-gram similarity, and take its label; this goes on from the newly
labelled ones until a whole connected component carries the label.

Of pairs at similarity SIMILAR or more, made by one to three edits of words or characters in the
sentences of the test tables, 98.4 % meet in a table and 99.9 % are within HAMMING; of those below
0.85, 96.3 %. A component joined by several links loses less.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions.udf import arrow
from filamento.functions.unicode import drop_invisible, nfkc
from filamento.llm import rules
from filamento.plans.runtime import materialize, salted_join

SIMILAR = 0.8
#: Bits of a SimHash, tables, bits of a table's key, and the greatest Hamming distance verified further.
BITS, TABLES, KEY_BITS, HAMMING = 128, 64, 16, 30
_RNG = np.random.default_rng(29)
_PICKED = np.array([np.sort(_RNG.choice(BITS, KEY_BITS, replace=False)) for _ in range(TABLES)])
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: For an octet, its low and high four bits spread over four 16-bit counters of one word.
_LANES = [np.array([sum(((v >> (4 * half + lane)) & 1) << (16 * lane) for lane in range(4)) for v in range(256)], np.uint64) for half in range(2)]


def simhash(texts: list[str]) -> np.ndarray:
    """128-bit SimHashes (rows of two int64) of texts over their character 3-grams, each place counted."""
    if not texts:
        return np.zeros((0, 2), np.int64)
    parts = [np.frombuffer(("\x02" + (t or "\x03") + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat = np.concatenate(parts).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - np.array([len(p) for p in parts])
    gram = flat.copy()
    gram[:-1] += flat[1:] << np.uint64(21)
    gram[:-2] += flat[2:] << np.uint64(42)
    keep = np.ones(len(gram), bool)
    keep[ends - 1] = False
    keep[ends - 2] = False
    n = np.add.reduceat(keep.astype(np.int64), starts)
    out = np.zeros((len(texts), 2), np.uint64)
    for word, factor in enumerate(_SPREAD):
        g = gram * np.uint64(factor)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        for byte in range(8):
            octet = ((g >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            for half in range(2):
                lanes = _LANES[half][octet]
                lanes[~keep] = 0
                # four 16-bit counters a word; a text of 2**16 grams or more has its counters split
                sums = np.add.reduceat(lanes, starts) if n.max() < 65536 else None
                for lane in range(4):
                    count = (sums >> np.uint64(16 * lane)) & np.uint64(65535) if sums is not None else np.add.reduceat((lanes >> np.uint64(16 * lane)) & np.uint64(65535), starts)
                    out[:, word] |= (count.astype(np.int64) * 2 > n).astype(np.uint64) << np.uint64(8 * byte + 4 * half + lane)
    return out.view(np.int64)


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """Key of each SimHash (rows of two int64) in every table: ``KEY_BITS`` of its bits."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    keys = np.zeros((len(hashes), TABLES), np.int32)
    for i in range(KEY_BITS):
        keys |= bits[:, _PICKED[:, i]].astype(np.int32) << i
    return keys


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the character 3-grams of two texts."""
    x, y = ({t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in (a, b))
    return len(x & y) / len(x | y)


def _entries(rows: DataFrame, key: str, entries: str, whole: str) -> DataFrame:
    """(key, para_no, sentence units): entries from 1, or the whole text as 0 where there is no entry."""
    has = F.coalesce(F.size(F.filter(entries, lambda p: p.isNotNull())), F.lit(0)) > 0
    listed = rows.where(has).select(F.col(key).alias("_key"), F.posexplode(entries).alias("_i", "_text")).select("_key", (F.col("_i") + 1).alias("para_no"), "_text")
    alone = rows.where(~has & F.col(whole).isNotNull()).select(F.col(key).alias("_key"), F.lit(0).alias("para_no"), F.col(whole).alias("_text"))
    text = listed.unionByName(alone).where("_text is not null")
    plain = F.translate(drop_invisible(nfkc(F.col("_text"))), "123456789", "000000000")
    units = text.select("_key", "para_no", F.explode(F.split(plain, r"(?U)(?<=[.!?。])\s+|\n+")).alias("unit")).withColumn("unit", F.trim("unit")).where("unit <> ''")
    return units.select("_key", "para_no", "unit", F.xxhash64("unit").alias("uid"))


_UNIT = T.StructType([T.StructField("uid", T.LongType()), T.StructField("unit", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())])


def labelled(units: DataFrame) -> DataFrame:
    """(uid, unit, kind, h0, h1) of (uid, unit): the trusted label, if there is one, and the SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            h = simhash(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rules.kinds(texts), pa.string()), pa.array(h[:, 0]), pa.array(h[:, 1])], _UNIT.names)

    return units.select("uid", "unit").mapInArrow(run, _UNIT)


@arrow(T.DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


_KEYED = T.StructType([T.StructField("uid", T.LongType()), T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("slot", T.IntegerType())])


def _slots(units: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(uid, h0, h1, slot): a row per table, its number and key in one; only ``wanted`` slots, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(np.int64).reshape(-1, 2)
            slots = table_keys(h) | (np.arange(TABLES, dtype=np.int32) << KEY_BITS)[None]
            keep = np.ones(slots.shape, bool) if wanted is None else (wanted[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
            row, _ = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in b.columns] + [pa.array(slots[keep])], _KEYED.names)

    return units.select("uid", "h0", "h1").mapInArrow(run, _KEYED)


def _occupied(slots: DataFrame) -> np.ndarray:
    """One bit for every slot of every table, set where it occurs: half a megabyte, whatever the input."""
    size = (TABLES << KEY_BITS) // 8
    part = 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            s = b.column(0).to_numpy()
            np.bitwise_or.at(bits, s >> 3, np.uint8(1) << (s & 7).astype(np.uint8))
        full = [(k, bits[k * part : (k + 1) * part].tobytes()) for k in range(size // part) if bits[k * part : (k + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int32()), pa.array([v for _, v in full], pa.binary())], ["part", "bits"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[k] = held.get(k, 0) | np.frombuffer(v, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "bits"])

    schema = "part int, bits binary"
    rows = slots.select("slot").mapInArrow(run, schema).repartition(16, "part").mapInArrow(union, schema).toArrow()
    out = np.zeros(size, np.uint8)
    for k, v in zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist()):
        out[k * part : (k + 1) * part] |= np.frombuffer(v, np.uint8)
    return out


def residue_units(units: DataFrame) -> DataFrame:
    """(uid, kind) of units that carry a residue label after propagation.

    ``units`` holds what ``labelled`` gives, once per uid. Units that agree with a labelled one in the
    key of any SimHash table are compared with it by Hamming distance, then by the similarity of
    their 3-grams; those at SIMILAR or more take its label and spread it in the next turn, until the
    connected components are whole. Only links that touch a label are looked for, so content never
    makes pairs with content, and units no labelled one meets in any table leave no row: a set of
    slots of fixed size tells them. A slot many units share is split by Spark's skew join. Units the
    rules call trusted content never take a label.
    """
    every = materialize(units.where("kind is null or kind in ('placeholder', 'filler', 'message')"), "residue-units")
    labels, pool = every.where("kind is not null"), every.where("kind is null").drop("kind")
    found, frontier = labels.select("uid", "kind"), labels
    distance = F.bit_count(F.col("h0").bitwiseXOR(F.col("s0"))) + F.bit_count(F.col("h1").bitwiseXOR(F.col("s1")))
    for turn in itertools.count(1):
        seeds = materialize(_slots(frontier).select(F.col("uid").alias("seed"), F.col("h0").alias("s0"), F.col("h1").alias("s1"), "slot"), "residue-seeds")
        near = _slots(pool, _occupied(seeds)).join(seeds, "slot").where(distance <= HAMMING).select("uid", "seed").distinct()
        texts = frontier.select(F.col("uid").alias("seed"), F.col("unit").alias("seed_unit"), "kind")
        checked = near.join(pool, "uid").join(texts, "seed").where(_similarity("unit", "seed_unit") >= SIMILAR)
        new = materialize(checked.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("unit", "h0", "h1")], F.min("kind").alias("kind")), "residue-new")
        if new.isEmpty():
            return found
        found = found.unionByName(new.select("uid", "kind"))
        pool = pool.join(new.select("uid"), "uid", "left_anti")
        pool = materialize(pool, "residue-pool") if turn % 4 == 0 else pool  # long chains keep a short plan
        frontier = new


def found(rows: DataFrame, key: str, entries: str, whole: str) -> DataFrame:
    """(key, para_no, kind): entries that are or contain residue; para_no 0 judges the whole text.

    Null and empty entries are no residue but keep their position; rows without a key are left out;
    repeated rows give one result row; clashing extra columns are ignored.
    """
    occurrences = materialize(_entries(rows.where(F.col(key).isNotNull()).select(key, entries, whole), key, entries, whole), "residue-occurrences")
    table = rows.sparkSession.createDataFrame([(t,) for t in rules.TABLE], "unit string").select(F.xxhash64("unit").alias("uid"), "unit")
    labels = residue_units(labelled(occurrences.select("uid", "unit").unionByName(table).distinct()))
    met = salted_join(occurrences.select("_key", "para_no", "uid"), labels, ["uid"])
    return met.groupBy(F.col("_key").alias(key), "para_no").agg(F.min("kind").alias("kind"))


def cleaned(rows: DataFrame, key: str, entries: str, whole: str) -> DataFrame:
    """(key, entries, whole): every key's entries, and its whole text, without residue.

    Entries that are or contain residue are taken out, and so are the lines of the whole text that equal
    one of them; null entries stay, and an array that is null or empty stays so. A whole text judged
    itself (which needs a section without entries) becomes null if it is residue. A key of whose
    content nothing but residue is left is excluded; one that never had any content stays. Of
    differing rows of a key the greatest values count; rows without a key are left out.
    """
    one = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(entries).alias(entries), F.max(whole).alias(whole)), "residue-rows")
    bad = found(one, key, entries, whole).groupBy(key).agg(F.collect_set(F.col("para_no").cast("int")).alias("_bad"))
    met = one.join(bad, key, "left")
    at = lambda wanted: lambda _, i: F.array_contains("_bad", i + 1) == F.lit(wanted)
    clean, dirty = F.filter(entries, at(False)), F.transform(F.filter(entries, at(True)), lambda p: F.trim(p))
    lines = F.filter(F.split(whole, "\n"), lambda line: ~F.coalesce(F.array_contains(dirty, F.trim(line)), F.lit(False)))
    text = F.when(~F.array_contains("_bad", 0), F.array_join(lines, "\n"))
    left = F.exists(clean, lambda p: p.isNotNull()) | (F.coalesce(F.size(entries), F.lit(0)) < 1) & text.isNotNull()
    judged = F.col("_bad").isNotNull()
    kept = met.where(~judged | F.coalesce(left, F.lit(False)))
    # not named as their columns yet: a later expression of the list would take the new ones
    return kept.select(key, F.when(judged, clean).otherwise(F.col(entries)).alias("_e"), F.when(judged, text).otherwise(F.col(whole)).alias("_w")).toDF(key, entries, whole)
