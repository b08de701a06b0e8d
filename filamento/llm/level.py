"""Reading level of documents: regularised ordinal regression calibrated to graded text.

Features are lexical diversity, word rarity, connectives, a proxy of clause depth and lengths. Rarity
is measured twice: against the whole corpus, and against the levels at which graded documents use a
word. Word statistics live in tables of fixed size (words hashed to buckets), so what reaches the
driver does not grow with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.plans.runtime import materialize

#: Buckets of the word tables.
BUCKETS = 1 << 17
#: The model is fitted on at most this many graded documents, chosen by the hash of their id.
MAX_GRADED = 20_000
LEVELS = 5

WORD = re.compile(r"[가-힣]+|[a-z]+")
SENTENCE = re.compile(r"(?<=[.?!。])\s+|\n+")
# Connectives and markers of embedded clauses.
CONNECTIVE = re.compile(r"다만|한편|그러나|그리고|따라서|이에 따라|이와 함께|이후|때문에|불구하고|하되|경우|있음을|것을 조건으로|전제로|유보한 채|although|because|whereas|while|provided that|insofar|to the extent|notwithstanding|having regard|unless|when|and|but|so that")
CLAUSE = re.compile(r"(?:하고|하며|으며|이며|되며|이고|하여|되어|면서|지만|으나|하는|되는|있는|없는|관한|대한|따른|의한|기한|인한|함에|하되|으로서|때에는)(?=[\s,])|,|;|\b(?:that|which|who|whose|to|of|pursuant|relative)\b")


class _Words(dict):
    """Bucket of a word; a task meets each word's hash once."""

    def __missing__(self, word: str) -> int:
        b = zlib.crc32(word.encode()) % BUCKETS
        if len(self) < 1_000_000:
            self[word] = b
        return b


def buckets(text: str | None, words: _Words) -> np.ndarray:
    return np.array([words[w] for w in WORD.findall((text or "").lower())], np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words = np.zeros(BUCKETS, np.int64), _Words()
    for b in batches:
        found = [buckets(t, words) for t in b.column(0).to_pylist()]
        total += np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, words = np.zeros(BUCKETS), np.zeros(BUCKETS), _Words()
    for b in batches:
        for text, level in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            own = np.unique(buckets(text, words))
            n[own] += 1
            s[own] += level
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(s[at])], ["b", "n", "s"])


def features(text: str | None, tables: dict, words: _Words, own_level: float | None = None) -> list[float]:
    """Feature vector; ``own_level`` takes a graded document's own grade out of its words' grades."""
    t = (text or "").lower()
    found = WORD.findall(t)
    w = np.array([words[x] for x in found], np.int64)
    n = max(1, len(w))
    m = max(1, len(SENTENCE.findall(t)) + 1)
    letters = sum(map(len, found))
    rarity = np.sort(tables["rarity"][w]) if len(w) else np.zeros(1)
    k, s = tables["graded_n"][w], tables["graded_s"][w]
    if own_level is not None:
        k, s = k - 1, s - own_level
    told = k >= 3
    grade = np.sort((s[told] + 2 * tables["mean"]) / (k[told] + 2)) if told.any() else np.array([tables["mean"]])
    r, g = len(rarity), len(grade)
    out = (
        np.log(n), np.log(n / m), min(1.0, len(set(found)) / n), letters / n,
        rarity.sum() / r, rarity[r // 2], rarity[r * 4 // 5], 1 - rarity.searchsorted(9, "right") / r,
        len(CONNECTIVE.findall(t)) / m, np.log1p(len(CLAUSE.findall(t)) / m),
        grade.sum() / g, grade[g // 2], grade[g // 5], grade[g * 4 // 5],
        1 - grade.searchsorted(4.3, "right") / g, 1 - grade.searchsorted(3.6, "right") / g, grade.searchsorted(2.3) / g, np.log(g),
    )
    return [float(x) for x in out]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2.0, steps: int = 25) -> dict:
    """Ordinal logit with shared slopes and one intercept per boundary, by damped Newton steps.

    ``y`` holds levels 1 to LEVELS. Squares of the standardised features are terms too. Slopes carry
    a ridge penalty; a boundary no label crosses keeps a finite intercept through a small one.
    """
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z = _terms(x, mu, sd)
    p, b = z.shape[1], LEVELS - 1
    theta = np.zeros(p + b)
    above = (y[:, None] > np.arange(1, LEVELS)[None]).astype(float)
    penalty = np.r_[np.full(p, ridge), np.full(b, 0.1)]
    for _ in range(steps):
        eta = np.clip((z @ theta[:p])[:, None] + theta[p:][None], -30, 30)
        q = 1 / (1 + np.exp(-eta))
        g = (above - q) * weight[:, None]
        v = q * (1 - q) * weight[:, None] + 1e-9
        grad = np.r_[z.T @ g.sum(1), g.sum(0)] - penalty * theta
        h = np.zeros((p + b, p + b))
        h[:p, :p] = (z * v.sum(1)[:, None]).T @ z
        h[:p, p:] = z.T @ v
        h[p:, :p] = h[:p, p:].T
        h[p:, p:] = np.diag(v.sum(0))
        step = np.linalg.solve(h + np.diag(penalty), grad)
        theta = theta + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return {"mu": mu, "sd": sd, "slopes": theta[:p], "cuts": theta[p:]}


def _terms(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mu) / sd, -6, 6)
    return np.hstack([z, z * z])


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """Levels: one more than the number of boundaries that are passed with a chance of one half."""
    eta = (_terms(x, model["mu"], model["sd"]) @ model["slopes"])[:, None] + model["cuts"][None]
    return 1 + (eta > 0).sum(1)


_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("level", T.DoubleType())])


def train(documents: DataFrame, labels: DataFrame, max_graded: int = MAX_GRADED) -> tuple[dict, dict]:
    """(word tables, model). Null levels and levels outside 1 to LEVELS don't count; a repeated label
    of one rater counts once; several raters of a document are averaged. Word counts are over all
    documents and word grades over all graded ones; only the fit uses the bounded sample of these."""
    grades = labels.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id", "rater").agg(F.max("level").alias("level")).groupBy("doc_id").agg(F.avg("level").alias("level"))
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_graded)
    graded = materialize(documents.where("text is not null").select("doc_id", "text").join(grades, "doc_id").select("doc_id", "text", "level"), "graded")
    tables = {"rarity": np.zeros(BUCKETS), "graded_n": np.zeros(BUCKETS), "graded_s": np.zeros(BUCKETS), "mean": 3.0}
    counts = documents.select("text").mapInArrow(_counts, T.StructType([T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])).groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS)
    n[counts.column("b").to_numpy()] = counts.column("n").to_numpy()
    tables["rarity"] = np.log((n.sum() + 1) / (n + 1)).astype(np.float32)
    gs = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.DoubleType())])
    told = graded.mapInArrow(_graded, gs).groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    tables["graded_n"][told.column("b").to_numpy()] = told.column("n").to_numpy()
    tables["graded_s"][told.column("b").to_numpy()] = told.column("s").to_numpy()
    tables["mean"] = grades.agg(F.coalesce(F.avg("level"), F.lit(3.0)).alias("level")).first().level

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            levels = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t, tables, words, v) for t, v in zip(b.column(1).to_pylist(), levels)], pa.list_(pa.float64())), pa.array(levels, pa.float64())], ["doc_id", "x", "level"])

    rows = graded.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").mapInArrow(vectors, _FEATURES).toArrow()
    x, y = np.array(rows.column("x").to_pylist()), np.array(rows.column("level").to_pylist())
    if not len(y):
        x, y = np.zeros((1, len(features("", tables, _Words())))), np.array([3.0])
    # a mean between two levels counts half for each
    low, high = np.floor(y), np.ceil(y)
    return tables, fit(np.vstack([x, x]), np.r_[low, high], np.full(2 * len(y), 0.5))


def levels(documents: DataFrame, labels: DataFrame, max_graded: int = MAX_GRADED) -> DataFrame:
    """(doc_id, level) of every document; a null or empty text has the level of an empty text's features.
    Without any label every document has level 3."""
    tables, model = train(documents, labels, max_graded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            x = np.array([features(t, tables, words) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(x, model).astype(np.int32) if len(x) else [], pa.int32())], ["doc_id", "level"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("level", T.IntegerType())]))
