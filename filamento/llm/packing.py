"""Filling fixed-capacity containers with texts, measured in tokens of a public tokenizer.

Planning looks at how many pieces have each length, not at the pieces: best fit by falling length
over the counts. Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.plans.runtime import materialize

#: Folder of the tokenizers' vocabulary files and the file used; both are parameters.
TOKENIZERS = os.environ.get("FILAMENTO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens), once per id; a null text or id has no row, an empty text none either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by falling length over counts: slots (length, first rank, per container, first
    container, containers, offset).

    The pieces of one length with ranks from ``first rank`` on fill ``containers`` containers in
    turn, ``per container`` each, from ``offset`` on. Containers filled alike are one range, so the
    plan's length follows the number of distinct lengths, not of pieces.
    """
    room: list[int] = []  # distinct remaining spaces, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # remaining space to ranges of containers
    slots, made = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in ranges:
                bisect.insort(room, space)
                ranges[space] = []
            ranges[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(room, length)
            if i < len(room):
                space = room[i]
                first, n = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space]
                    room.pop(i)
            else:
                space = capacity
                first, n = made, -(-left // (capacity // length))
                made += n
            fit = space // length
            whole = min(n, left // fit)
            if whole:
                slots.append((length, rank, fit, first, whole, capacity - space))
                put(space - fit * length, first, whole)
                rank, left, first, n = rank + whole * fit, left - whole * fit, first + whole, n - whole
            if n and left:  # fewer pieces than one container takes
                slots.append((length, rank, left, first, 1, capacity - space))
                put(space - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(space, first, n)
    return slots


_PLACED = T.StructType([T.StructField(n, T.LongType()) for n in ("spec_id", "container_id", "at_token", "doc_id", "piece_no", "start_token", "n_tokens")])


def pack(tokens: DataFrame, specs: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """(spec_id, container_id, at_token, doc_id, piece_no, start_token, n_tokens).

    Each text goes whole into one container of every capacity; a longer one is cut into full pieces
    and a rest. Specs with a null or non-positive capacity are left out; of a repeated spec_id the
    greatest capacity counts. What reaches the driver is one count per spec and length up to the
    capacity. A length many texts share is ranked in parts: within a hash part, after the parts before.
    """
    chosen = {int(r.spec_id): int(r.c) for r in specs.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("c")).collect()}
    if not chosen:
        return tokens.sparkSession.createDataFrame([], _PLACED)
    per_spec = F.array(*[F.struct(F.lit(s).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("cap")) for s, c in sorted(chosen.items())])
    cut = tokens.select("doc_id", "n_tokens", F.explode(per_spec).alias("s")).select("doc_id", "n_tokens", "s.*")
    pieces = cut.select("spec_id", "cap", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / F.col("cap")).cast("bigint"))).alias("piece_no"))
    pieces = pieces.select("spec_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"), F.least(F.col("cap"), F.col("n_tokens") - F.col("piece_no") * F.col("cap")).alias("n_tokens"))
    histogram = pieces.groupBy("spec_id", "n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    counts: dict[int, dict[int, int]] = {s: {} for s in chosen}
    for r in histogram:
        counts[r["spec_id"]][r["n_tokens"]] = r["n"]
    parts = max(16, sum(r["n"] for r in histogram) // rows_per_task)
    slots = sorted((s, *slot) for s, cap in chosen.items() for slot in plan(counts[s], cap))
    table = np.array(slots, np.int64).reshape(-1, 7)
    where = {}
    for i, (s, length, *_) in enumerate(slots):
        where.setdefault((s, length), [i, i])[1] = i + 1

    from pyspark.sql import Window

    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    sizes = keyed.groupBy("spec_id", "n_tokens", "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("spec_id", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("spec_id", "n_tokens", "part").orderBy("doc_id", "piece_no")) - 1)
    ranked = within.join(before, ["spec_id", "n_tokens", "part"]).select("spec_id", "doc_id", "piece_no", "start_token", "n_tokens", (F.col("before") + F.col("rn")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec, doc, piece, start, length, rank = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            span = np.array([where[k] for k in zip(spec.tolist(), length.tolist())], np.int64).reshape(-1, 2)
            lo, hi = span[:, 0].copy(), span[:, 1].copy()
            while (hi - lo > 1).any():  # the last slot whose first rank is not beyond the piece's
                mid = (lo + hi) // 2
                go = (hi - lo > 1) & (table[np.minimum(mid, len(table) - 1), 2] <= rank)
                stay = (hi - lo > 1) & ~go
                lo[go], hi[stay] = mid[go], mid[stay]
            slot = table[lo]
            k = rank - slot[:, 2]
            columns = (spec, slot[:, 4] + k // slot[:, 3], slot[:, 6] + k % slot[:, 3] * length, doc, piece, start, length)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _PLACED.names)

    return ranked.mapInArrow(place, _PLACED)


def packed(documents: DataFrame, specs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts tokens once (written to the shared folder) and packs."""
    return pack(materialize(token_counts(documents, folder, vocabulary), "pack-tokens"), specs)
