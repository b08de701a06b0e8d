"""Evaluation passages inside a training corpus.

Corpus texts are cut into overlapping passages and weighted by TF-IDF over the character n-grams of
the evaluation items. A randomised SVD, computed over all passages in distributed passes, gives a
latent space in which a coarse index of the items' windows is searched by cosine. Candidates are then
checked against the whole text: by their longest common run, and by longest common subsequence and
answers for paraphrases.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.plans.runtime import materialize

N = 6  # characters of an n-gram
RUN = 40  # characters of a leaking run
WINDOW, STRIDE = 60, 20  # any run of RUN characters lies in one window
SPAN = WINDOW - N + 1  # n-grams of a window
FEATURES = 8192  # n-grams are hashed to so many columns
RANK, EXTRA = 256, 16  # of the latent space, and columns beyond it while it is sought
COSINE = 0.25
CAPTURED = 0.5  # passages with a smaller share of their weight in the latent space are compared exactly
PROBES = 12  # cells of the coarse index a passage looks into
SHARE = 0.6  # of an item's characters in common order, from which a passage that keeps its answers is a paraphrase
OWN, OWN_SHARE = 4, 0.25  # n-grams only one item has, and the share of them a paraphrase of it keeps
BLOCK_ITEMS = 10_000  # items held in memory at once; more are taken in blocks
CHUNK = 1 << 17  # characters of texts that are cut into passages together, so that their arrays stay in the caches
DISTINCT = 1 << 13  # distinct passages multiplied at once
CELLS = 1 << 19  # pairs of passages and windows added up at once

_OTHER = re.compile(r"[\W_]+")
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 1000003
_KEPT = np.array([chr(c).isalnum() for c in range(1 << 16)])  # what _OTHER leaves of the first plane, and not its last place, where take() clips others to


def normal(text: str | None) -> str:
    """Letters and digits only, after NFKC and lower-casing."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normal texts, one text after another, and the bounds of each."""
    lowered = [unicodedata.normalize("NFKC", t).lower() if t else "" for t in texts]
    codes = points("".join(lowered))
    keep = _KEPT.take(codes, mode="clip")
    beyond = np.flatnonzero(codes >= len(_KEPT))
    keep[beyond] = [chr(c).isalnum() for c in codes[beyond].tolist()]
    at = np.flatnonzero(keep)
    return codes[at], np.searchsorted(at, np.cumsum([0, *map(len, lowered)]))


def _polynomial(a: np.ndarray, n: int) -> np.ndarray:
    """Of every n values in turn, the polynomial in _BASE: that of two halves, and of the last one where n is odd."""
    if n == 1:
        return a
    half, size = n // 2, len(a) - n + 1
    h = _polynomial(a, half)
    h = h[:size] * np.uint64(pow(_BASE, half, 1 << 64)) + h[half : half + size]
    return h * np.uint64(_BASE) + a[n - 1 :] if n % 2 else h


def hashes(codes: np.ndarray, n: int = N) -> np.ndarray:
    """64-bit hashes of the n-grams of code points, by position."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = _polynomial(codes.astype(np.uint64), n) * _MIX
    return h ^ (h >> np.uint64(31))


def grams(text: str, n: int = N) -> np.ndarray:
    """64-bit hashes of the n-grams of a normal text, by position."""
    return hashes(points(text), n)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Rows:
    """Sparse rows: the distinct known n-grams of each (as places in the vocabulary), and how many unknown it has."""

    def __init__(self, parts: list[np.ndarray], unknown: list[int]):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.flat = np.concatenate(parts).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.unknown = np.array(unknown, np.int64)

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray, unknown: np.ndarray) -> Rows:
        """Rows whose entries follow one another in ``flat``."""
        out = cls([], [])
        out.flat, out.sizes, out.unknown = flat.astype(np.int64), sizes.astype(np.int64), unknown.astype(np.int64)
        out.starts = np.cumsum(out.sizes) - out.sizes
        return out

    def __len__(self) -> int:
        return len(self.sizes)

    def chosen(self, rows: np.ndarray) -> Rows:
        return Rows.of(self.flat[_spans(self.starts[rows], self.sizes[rows])], self.sizes[rows], self.unknown[rows])

    def weights(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every entry in unit rows, and each row's share that is known: unknown n-grams
        weigh as the mean of the vocabulary and are orthogonal to every item."""
        w = idf[self.flat]
        known = np.add.reduceat(w * w, self.starts) if len(self) else np.zeros(0, np.float32)
        other = self.unknown * np.float32(np.mean(idf) ** 2 if len(idf) else 0)
        return w / np.repeat(np.sqrt(known), self.sizes), np.sqrt(known / (known + other))

    def times(self, w: np.ndarray, column: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows (entries weighing ``w``, each in its hashed column) times a dense matrix."""
        out = np.empty((len(self), right.shape[1]), np.float32)
        longest = np.argsort(-self.sizes, kind="stable")
        for i in range(0, len(self), 512):
            rows = longest[i : i + 512]  # first entries of all, second ones of those that have them, ...
            starts, sizes, sums = self.starts[rows], self.sizes[rows], np.zeros((len(rows), right.shape[1]), np.float32)
            for k in range(int(sizes[0])):
                at = starts[: np.searchsorted(-sizes, -k)] + k
                part = right[column[self.flat[at]]]
                part *= w[at, None]
                sums[: len(at)] += part
            out[rows] = sums
        return out

    def times_transposed(self, w: np.ndarray, column: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns that occur, and the rows of the transposed matrix times ``y`` at them."""
        at = column[self.flat]
        order = np.argsort(at, kind="stable")
        row, w = np.repeat(np.arange(len(self)), self.sizes)[order], w[order]
        columns, first = np.unique(at[order], return_index=True)
        bounds = [*first.tolist(), len(order)]
        out = np.empty((len(columns), y.shape[1]), np.float32)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out[k] = w[a:b] @ y[row[a:b]]
        return columns, out


class Items:
    """The evaluation items, their n-gram vocabulary and their windows."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        self.texts = [normal(t) for _, t in rows]
        hashed = [grams(t) for t in self.texts]
        self.vocabulary = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.vocabulary >> np.uint64(42)).astype(np.int64)] = True
        self.column = ((self.vocabulary * _MIX2) >> np.uint64(51)).astype(np.int64)
        windows, owner = [], []
        for k, h in enumerate(hashed):
            at = np.searchsorted(self.vocabulary, h)
            for s in range(0, max(1, len(h) - (RUN - N)), STRIDE):
                if len(at[s : s + SPAN]):
                    windows.append(np.unique(at[s : s + SPAN]))
                    owner.append(k)
        self.windows, self.owner = Rows(windows, [0] * len(windows)), np.array(owner, np.int64)

    def passages(self, x: str) -> tuple[int, list[int], list[np.ndarray], list[int]]:
        """Of a normal text: the number of its passages, and of those with a known n-gram (all others
        are zero rows) where they start, their distinct known n-grams and how many unknown they have."""
        codes = points(x)
        count, _, start, rows = self._cut(codes, np.array([0, len(codes)]))
        return count, start.tolist(), np.split(rows.flat, rows.starts[1:]) if len(rows) else [], rows.unknown.tolist()

    def passages_of(self, texts: list[str | None]) -> tuple[int, np.ndarray, np.ndarray, Rows]:
        """The same of many texts, which need not be normal: the number of all passages, and of those with
        a known n-gram the text, where they start in it, and their rows. Texts are taken CHUNK characters
        at a time, a longer one by itself."""
        ends = np.cumsum([len(t or "") for t in texts])
        found, i = [(0, *np.zeros((2, 0), np.int64), Rows([], []))], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
            count, text, start, rows = self._cut(*letters(texts[i:j]))
            found.append((count, text + i, start, rows))
            i = j
        counts, text, start, rows = zip(*found)
        return sum(counts), np.concatenate(text), np.concatenate(start), Rows.of(*(np.concatenate([getattr(r, c) for r in rows]) for c in ("flat", "sizes", "unknown")))

    def _cut(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, Rows]:
        sizes = np.diff(bounds)
        count = int(np.where(sizes, -(-np.maximum(0, sizes - WINDOW) // STRIDE) + 1, 0).sum())
        n_grams = np.maximum(0, sizes - N + 1)
        n_starts = -(-n_grams // STRIDE)
        before = np.cumsum(n_starts) - n_starts  # starts in the texts before each
        h = hashes(codes)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(42)).astype(np.int64)])
        where = np.searchsorted(self.vocabulary, h[at])
        same = self.vocabulary[np.minimum(where, len(self.vocabulary) - 1)] == h[at] if len(at) else at > 0
        at, where = at[same], where[same]
        text = np.searchsorted(bounds, at, "right") - 1
        whole = at + N <= bounds[text + 1]  # the others lie across two texts
        place, where, text = (at - bounds[text])[whole], where[whole], text[whole]
        held, known = [], []  # passages, numbered through all texts, and the n-grams in them
        for k in range(-(-SPAN // STRIDE)):
            start = place // STRIDE - k
            inside = (start >= 0) & (place - start * STRIDE < SPAN)
            held.append((before[text] + start)[inside])
            known.append(where[inside])
        held, known = np.concatenate(held), np.concatenate(known)
        numbers, n_known = np.unique(held, return_counts=True)
        passage, flat = np.divmod(np.unique(held * len(self.vocabulary) + known), max(1, len(self.vocabulary)))
        _, n_distinct = np.unique(passage, return_counts=True)
        text = np.searchsorted(before, numbers, "right") - 1
        start = (numbers - before[text]) * STRIDE
        return count, text, start, Rows.of(flat, n_distinct, np.minimum(SPAN, n_grams[text] - start) - n_known)


class Index:
    """Windows of the items in the latent space, in cells around about as many centres as each cell has
    windows; and the windows that hold each n-gram."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        w, _ = items.windows.weights(idf)
        q = items.windows.times(w, items.column, basis)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-6)
        rng = np.random.default_rng(11)
        self.centres = q[rng.choice(len(q), max(1, round(len(q) ** 0.5)), replace=False)]
        for _ in range(6):
            cell = self._nearest(q)
            order = np.argsort(cell, kind="stable")
            held, first = np.unique(cell[order], return_index=True)
            self.centres[held] = np.add.reduceat(q[order], first)
            self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-6)
        cell = self._nearest(q)
        self.order = np.argsort(cell, kind="stable")
        self.bounds = np.searchsorted(cell[self.order], np.arange(len(self.centres) + 1))
        self.vectors = q[self.order]
        # postings: of every n-gram, the windows that hold it and its weight there
        window = np.repeat(np.arange(len(q)), items.windows.sizes)
        by_gram = np.argsort(items.windows.flat, kind="stable")
        self.post_window, self.post_weight = window[by_gram], w[by_gram]
        self.post_bounds = np.searchsorted(items.windows.flat[by_gram], np.arange(len(items.vocabulary) + 1))

    def _nearest(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([(q[i : i + 4096] @ self.centres.T).argmax(1) for i in range(0, len(q), 4096)])

    def near(self, x: np.ndarray, least: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, cosine) of unit rows ``x`` and windows of their nearest cells, at ``least`` or more by row."""
        probes = min(probes, len(self.centres))
        cells = np.argpartition(-(x @ self.centres.T), probes - 1, axis=1)[:, :probes] if len(x) else np.zeros((0, probes), np.int64)
        rows, flat = np.repeat(np.arange(len(x)), probes), cells.ravel()
        order = np.argsort(flat, kind="stable")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for c, mine in zip(*_runs(flat[order], rows[order])):
            a, b = self.bounds[c], self.bounds[c + 1]
            cos = x[mine] @ self.vectors[a:b].T
            r, w = np.nonzero(cos >= least[mine, None])
            out.append((mine[r], self.order[a + w], cos[r, w]))
        return tuple(np.concatenate(p) for p in zip(*out))

    def exact(self, rows: Rows, w: np.ndarray, chosen: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for ``chosen`` rows by their own weights, over all windows that share an n-gram."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        part, n = rows.chosen(chosen), len(self.vectors)
        weight = w[_spans(rows.starts[chosen], part.sizes)]
        lo = self.post_bounds[part.flat]
        n_posts = self.post_bounds[part.flat + 1] - lo
        posts = np.concatenate([[0], np.cumsum(n_posts)])
        cells = np.cumsum(posts[part.starts + part.sizes] - posts[part.starts] + n)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(cells, (cells[i - 1] if i else 0) + CELLS, "right")))
            e = slice(part.starts[i], part.starts[j - 1] + part.sizes[j - 1])
            at = _spans(lo[e], n_posts[e])
            row = np.repeat(np.repeat(np.arange(j - i), part.sizes[i:j]), n_posts[e])
            cos = np.bincount(row * n + self.post_window[at], self.post_weight[at] * np.repeat(weight[e], n_posts[e]), (j - i) * n).reshape(j - i, n)
            r, found = np.nonzero(cos >= least[chosen[i:j], None])
            out.append((chosen[i + r], found, cos[r, found].astype(np.float32)))
            i = j
        return tuple(np.concatenate(p) for p in zip(*out))

    def candidates(self, items: Items, rows: Rows, idf: np.ndarray, basis: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, cosine) at COSINE or more. A row's unknown share scales all its cosines, so rows
        that know too little can't reach it and are left out; of the rest, those the latent space
        holds too little of are compared exactly."""
        w, share = rows.weights(idf)
        least = (COSINE / np.maximum(share, 1e-6)).astype(np.float32)
        able = np.flatnonzero(share >= COSINE)
        part = rows.chosen(able)
        wp, _ = part.weights(idf)
        x = part.times(wp, items.column, basis)
        held = np.linalg.norm(x, axis=1)
        rich = held**2 >= CAPTURED
        r1, w1, c1 = self.near(x[rich] / held[rich, None], least[able[rich]], probes)
        r2, w2, c2 = self.exact(part, wp, np.flatnonzero(~rich), least[able])
        row = np.concatenate([able[np.flatnonzero(rich)[r1]], able[r2]])
        item, cos = items.owner[np.concatenate([w1, w2])], np.concatenate([c1, c2]) * share[row]
        order = np.lexsort((-cos, item, row))
        row, item, cos = row[order], item[order], cos[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[first], item[first], cos[first]


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct sorted keys and the values of each."""
    found, first = np.unique(keys, return_index=True)
    return found.tolist(), np.split(values, first[1:]) if len(found) else []


_PASSAGE = T.StructType([T.StructField("known", T.ArrayType(T.IntegerType())), T.StructField("n", T.LongType())])
_BLOCK = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("sums", T.BinaryType())])
BLOCKS = 16


def _passages(documents: DataFrame, shared) -> DataFrame:
    """Known n-grams and number of unknown ones of passages; rows without known ones count all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            total, _, _, rows = items.passages_of(b.column(0).to_pylist())
            n = len(rows.flat)
            bounds = pa.array(np.concatenate([rows.starts, [n, n]]), pa.int32(), mask=np.arange(len(rows) + 2) == len(rows))  # the last row is null
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, pa.array(rows.flat, pa.int32())), pa.array([*rows.unknown.tolist(), total], pa.int64())], _PASSAGE.names)

    return documents.where("doc_id is not null and text is not null").select("text").mapInArrow(run, _PASSAGE)


def _product(passages: DataFrame, shared, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Xᵀ X right over all passages X: each task sums its own, and blocks of rows are summed by key.

    Equal passages are multiplied once and count as often as they occur. What comes back has the fixed
    size FEATURES x columns. A block's sums are added as they stream in.
    """
    width, size = right.shape[1], FEATURES // BLOCKS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = shared.value.column
        total = np.zeros((FEATURES, width), np.float32)

        def multiply(counts: Counter) -> None:
            flat = np.frombuffer(b"".join(k for k, _ in counts), np.int32)
            rows = Rows.of(flat, np.array([len(k) // 4 for k, _ in counts]), np.array([n for _, n in counts]))
            w, share = rows.weights(idf)
            w = w * np.repeat(share, rows.sizes)
            times = np.array(list(counts.values()), np.float32)
            at, sums = rows.times_transposed(w, column, rows.times(w, column, right) * times[:, None])
            total[at] += sums

        counts: Counter = Counter()
        for b in batches:
            known = b.column(0)
            data, ends = known.flatten().to_numpy().astype(np.int32, copy=False).tobytes(), np.cumsum(pc.list_value_length(known).to_numpy()).tolist()
            counts.update(zip((data[4 * i : 4 * j] for i, j in zip([0, *ends], ends)), b.column(1).to_pylist()))
            if len(counts) >= DISTINCT:
                multiply(counts)
                counts.clear()
        if counts:
            multiply(counts)
        full = [k for k in range(BLOCKS) if total[k * size : (k + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([total[k * size : (k + 1) * size].tobytes() for k in full], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])

    rows = passages.where("known is not null").mapInArrow(local, _BLOCK).repartition(BLOCKS, "block").mapInArrow(add, _BLOCK).toArrow()
    out = np.zeros((BLOCKS, size, width), np.float32)
    for k, v in zip(rows.column("block").to_pylist(), rows.column("sums").to_pylist()):
        out[k] += np.frombuffer(v, np.float32).reshape(-1, width)
    return out.reshape(FEATURES, width)


def latent_basis(passages: DataFrame, shared, idf: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the leading right singular vectors, by two randomised passes."""
    right = np.random.default_rng(20).standard_normal((FEATURES, RANK + EXTRA)).astype(np.float32)
    for _ in range(2):
        right, _ = np.linalg.qr(_product(passages, shared, idf, right))
    return np.ascontiguousarray(right[:, :RANK], np.float32)


class Runs:
    """Longest common runs of one text with chosen items, by one look-up of the text's RUN-grams."""

    def __init__(self, texts: list[str], least: int = RUN):
        self.texts, self.least = texts, least
        hashed = [grams(t, least) for t in texts]
        flat = np.concatenate([*hashed, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.item = np.repeat(np.arange(len(texts)), [len(h) for h in hashed])[order]
        self.at = np.concatenate([*(np.arange(len(h)) for h in hashed), np.zeros(0, np.int64)]).astype(np.int64)[order]

    def longest(self, x: str, items: set[int]) -> dict[int, int]:
        """Item to the length of its longest run with ``x``, for those of ``items`` that have one."""
        h = grams(x, self.least)
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        best: dict[int, int] = {}
        open_: dict[tuple[int, int], int] = {}  # (item, diagonal) to the end of the run being counted
        for i in np.flatnonzero(hi > lo).tolist():
            for k in range(int(lo[i]), int(hi[i])):
                item, j = int(self.item[k]), int(self.at[k])
                if item not in items or open_.get((item, i - j), -1) > i:
                    continue
                y = self.texts[item]
                if x[i : i + self.least] == y[j : j + self.least]:
                    n = self.least
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    open_[item, i - j] = i + n - self.least
                    best[item] = max(best.get(item, 0), n)
        return best


class Answers:
    """What an item asks about: its numbers, and the n-grams no other item has (names, amounts, terms).
    Items made after one pattern share the rest, so that alone tells no leak."""

    def __init__(self, texts: list[str]):
        self.numbers = [re.findall(r"\d+", y) for y in texts]
        sets = [np.unique(grams(y, OWN)) for y in texts]
        _, at, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        once = np.split(n[at] == 1, np.cumsum([len(s) for s in sets]))
        self.own = [s[o] for s, o in zip(sets, once)]

    def kept(self, around: str, item: int) -> bool:
        if not all(v in around for v in self.numbers[item]):
            return False
        own = self.own[item]
        return not len(own) or float(np.isin(own, grams(around, OWN)).mean()) >= OWN_SHARE


def subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``y``."""
    if not x or not y:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(y):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(y)) - 1
    v = full
    for c in x:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


def share_in_order(around: str, item: str, piece: int = RUN) -> float:
    """Share of an item's characters that a text holds in the same order: over the whole item, or, for
    parts that changed places, over its pieces, each where most of its 4-grams are."""
    whole = subsequence(around, item) / max(1, min(len(item), len(around)))
    if whole >= SHARE or len(item) < 2 * piece:
        return whole
    places: dict[str, list[int]] = {}
    for i in range(len(around) - 3):
        places.setdefault(around[i : i + 4], []).append(i)
    held = 0
    for s in range(0, len(item), piece):
        part = item[s : s + piece]
        votes: dict[int, int] = {}
        for j in range(len(part) - 3):
            for i in places.get(part[j : j + 4], ()):
                votes[(i - j) // 8] = votes.get((i - j) // 8, 0) + 1
        if votes:
            at = 8 * max(votes, key=lambda v: (votes[v], -v))
            held += subsequence(around[max(0, at - 12) : at + len(part) + 20], part)
    return max(whole, held / len(item))


_LEAK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("run", T.IntegerType()), T.StructField("common_share", T.DoubleType()), T.StructField("answer_kept", T.BooleanType())])
_LEAK_ARROW = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_())


def _checked(documents: DataFrame, shared, idf: np.ndarray, index) -> DataFrame:
    """Candidates of every document and what the checks of its whole text say of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (windows, basis) = shared.value, index.value
        runs = Runs(items.texts)
        answers = Answers(items.texts)
        for b in batches:
            texts = b.column(1).to_pylist()
            _, doc, start, rows = items.passages_of(texts)
            row, item, cos = windows.candidates(items, rows, idf, basis)
            near: dict[int, dict[int, list[tuple[float, int]]]] = {}
            for d, i, c, s in zip(doc[row].tolist(), item.tolist(), cos.tolist(), start[row].tolist()):
                near.setdefault(d, {}).setdefault(i, []).append((c, s))
            out, ids = [], b.column(0).to_pylist()
            for d, found in near.items():
                x = normal(texts[d])
                longest = runs.longest(x, set(found))
                for item, at in found.items():
                    y, n, share, kept = items.texts[item], longest.get(item, 0), None, None
                    if not n:
                        kept, checked = False, -1
                        for s in sorted({s for _, s in at}):
                            if s < checked:  # the stretch looked at last holds this passage and an item's length around it
                                continue
                            checked = s + WINDOW
                            around = x[max(0, s - len(y)) : s + 2 * WINDOW + len(y)]
                            if answers.kept(around, item):
                                kept, share = True, max(share or 0.0, share_in_order(around, y))
                    out.append((ids[d], items.ids[item], max(c for c, _ in at), n, share, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, _LEAK_ARROW)], _LEAK.names)

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, _LEAK)


def _block(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame | None:
    held = Items(sorted(rows))
    if not len(held.windows):
        return None
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(held)  # bounded by BLOCK_ITEMS
    passages = materialize(_passages(documents, shared), "leak-passages")
    total = passages.where("known is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    df = np.zeros(len(held.vocabulary))
    counted = passages.where("known is not null").select(F.explode("known").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).toArrow()
    df[counted.column("v").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((total + 1) / (df + 1)).astype(np.float32) + np.float32(0.01)
    basis = latent_basis(passages, shared, idf)
    return _checked(documents, shared, idf, context.broadcast((Index(held, idf, basis), basis)))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, run, common_share, answer_kept) of candidate pairs.

    ``run`` is the longest common run of letters and digits if it reaches RUN, else 0: the pairs with
    a run are leaks. For the rest, ``common_share`` (the share of the item's characters found in the same
    order around a candidate passage, or of its pieces where those changed places) and
    ``answer_kept`` (the numbers of the item all occur there, and at least OWN_SHARE of the n-grams no
    other item has) tell paraphrases. Every candidate passage of a pair is looked at: the greatest share
    of those that keep the answers is told, and none where no passage keeps them. Null texts and ids have no pairs; an item shorter than RUN can
    have no run. Repeated rows give one row. The corpus is read twice for every BLOCK_ITEMS items, and
    no text of it is shuffled.
    """
    told = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    blocks = -(-told.count() // BLOCK_ITEMS)
    out = documents.sparkSession.createDataFrame([], _LEAK)
    for b in range(blocks):
        mine = told.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _block(documents, [(r.item_id, r.text) for r in mine])
        out = out if found is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in _LEAK.names[2:]))
