"""Edit distances and matching blocks of whole texts: exact at any length, without the quadratic loops in Python."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from difflib import SequenceMatcher

import numpy as np

#: Matching blocks are looked for from the first of these lengths of which two texts share at most HITS.
LENGTHS, HITS = (8, 2), 2_000_000
#: Pairs of texts whose distances are counted together, and the cells of a table one group of them fills.
GROUP, CELLS = 1000, 4_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _ranks(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of k (a power of two) characters that start at each place: equal runs, equal numbers."""
    step, bits = 1, 64
    while step < k:
        if 2 * bits > 64:
            names, both = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y, bits = both[: len(x)], both[len(x) :], max(1, len(names).bit_length())
        x, y = ((v[:-step] << bits | v[step:]) if len(v) > step else v[:0] for v in (x, y))
        step, bits = 2 * step, 2 * bits
    return x, y


def _gap_of(starts: list[int], ends: list[int], n: int, k: int, total: int) -> np.ndarray:
    """The gap that holds the run of k characters at each place, ``total`` where none does."""
    out = np.full(n, total)
    for g, (s, e) in enumerate(zip(starts, ends)):
        out[s : max(s, e - k + 1)] = g
    return out


def matched_length(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib's SequenceMatcher(None, a, b, autojunk=False).

    That takes the longest common block, the first in a and then in b of equals, and goes on to the left
    and right of it. Here blocks are taken in that order over all gaps at once, from a list of the maximal
    runs both texts share; one that reaches over its gap comes again as what is left of it. When no gap
    holds a common run of two characters, the rest is one scan of each gap.
    """
    if a == b:
        return len(a)
    x, y = _codes(a), _codes(b)
    n, m = len(a), len(b)
    a0, a1, b0, b1 = [0], [n], [0], [m]
    total, lengths, refused = 0, [*LENGTHS], 0
    while lengths:
        k = lengths.pop(0)
        gx, gy = _ranks(x, y, k)
        if not len(gx) or not len(gy):
            continue
        ga, gb = (_gap_of(s, e, len(v), k, len(a0)) for s, e, v in ((a0, a1, gx), (b0, b1, gy)))
        at, to = np.flatnonzero(ga < len(a0)), np.flatnonzero(gb < len(b0))
        if len(a0) == 1:
            ka, kb = gx[at], gy[to]
        else:
            both = np.unique(np.concatenate([gx[at], gy[to]]), return_inverse=True)[1]
            ka, kb = both[: len(at)] * len(a0) + ga[at], both[len(at) :] * len(a0) + gb[to]
        order = np.argsort(kb, kind="stable")
        kb, to = kb[order], to[order]
        low, high = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
        hits = high - low
        found = int(hits.sum())
        if found > HITS:
            # Texts that repeat themselves share many short runs: longer ones first, which split the gaps.
            if k > refused and 4 * k <= min(n, m):
                refused, lengths = k, [4 * k, k, *lengths]
                continue
            gaps = ((a[s:e], b[lo:hi]) for s, e, lo, hi in zip(a0, a1, b0, b1))
            return total + sum(block.size for x, y in gaps for block in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        if not found:
            continue
        i = np.repeat(at, hits)
        j = to[np.arange(found) + np.repeat(low - (np.cumsum(hits) - hits), hits)]
        width = n + m + 1
        key = np.sort((j - i + n) * width + i)
        first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        size = np.diff(first, append=found) + k - 1
        i = key[first] % width
        j = key[first] // width - n + i
        order = np.lexsort((j, i, -size))
        parts: list[tuple[int, int, int]] = []
        for run in zip((-size[order]).tolist(), i[order].tolist(), j[order].tolist()):
            while parts and parts[0] < run:
                total += _take(heapq.heappop(parts), parts, k, a0, a1, b0, b1)
            total += _take(run, parts, k, a0, a1, b0, b1)
        while parts:
            total += _take(heapq.heappop(parts), parts, k, a0, a1, b0, b1)
    for s, e, lo, hi in zip(a0, a1, b0, b1):
        if lo < hi:
            for c in a[s:e]:
                p = b.find(c, lo, hi)
                if p >= 0:
                    total += 1
                    lo = p + 1
    return total


def _take(run: tuple[int, int, int], parts: list, k: int, a0: list[int], a1: list[int], b0: list[int], b1: list[int]) -> int:
    """Take a run that lies in one gap, which splits it, and give its length; else keep its parts for later."""
    size, i, j = run
    g, end = bisect_right(a0, i) - 1, i - size
    if g >= 0 and end <= a1[g] and b0[g] <= j and j - size <= b1[g]:
        ea, eb = a1[g], b1[g]
        a1[g], b1[g] = i, j
        a0.insert(g + 1, end), a1.insert(g + 1, ea), b0.insert(g + 1, j - size), b1.insert(g + 1, eb)
        return -size
    g = max(g, 0)
    while g < len(a0) and a0[g] < end:
        s, e = max(a0[g] - i, b0[g] - j, 0), min(a1[g] - i, b1[g] - j, -size)
        if e - s >= k:
            heapq.heappush(parts, (s - e, i + s, j + s))
        g += 1
    return 0


def matching_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks by both lengths; two empty texts are alike."""
    return 2.0 * matched_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def distance(a: str, b: str) -> int:
    """Levenshtein distance: one integer holds a whole column of the table."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        hit = places.get(c, 0)
        same = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | full & ~(same | up), same & up
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | full & ~(same | plus), plus & same
    return score


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Levenshtein distance of each pair: groups of pairs of like length together, single long ones alone."""
    out = [0] * len(pairs)
    sides = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    todo = sorted((p for p, (a, b) in enumerate(sides) if a != b), key=lambda p: len(sides[p][0]))
    while todo:
        longest = [len(sides[p][0]) for p in todo[:GROUP]]
        size = next((s for s in range(len(longest), 0, -1) if s * longest[s - 1] <= CELLS), 1)
        group, todo = todo[:size], todo[size:]
        told = [sides[p] for p in group]
        # Microseconds as measured: some twenty steps for each word and column together, one integer's for each column alone.
        together = -(-longest[size - 1] // 64) * max(len(b) for _, b in told) * (10 + size / 50)
        some = _grouped(told) if together < sum(len(b) * (2 + len(a) / 360) for a, b in told) else [distance(a, b) for a, b in told]
        for p, d in zip(group, some):
            out[p] = d
    return out


def _grouped(pairs: list[tuple[str, str]]) -> list[int]:
    """Distances of pairs sorted by the length of their first side, the longer one: 64 rows of the table
    are a word of each pair, and what leaves a word's last row enters the next one's first."""
    size, n, m = len(pairs), np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    words, columns = -(-int(n[-1]) // 64), int(m.max())
    a, b = _codes("".join(a for a, _ in pairs)), _codes("".join(b for _, b in pairs))
    known = np.zeros(0x110000, np.int64)
    known[a] = 1
    letters = int(known.sum()) + 2  # the last two: behind the end of a first side, not in any first side
    known = np.where(known, np.cumsum(known) - 1, letters - 1)
    rows = np.full((words * 64, size), letters - 2)
    text = np.full((columns, size), letters - 1)
    rows.T[np.arange(words * 64) < n[:, None]] = known[a]
    text.T[np.arange(columns) < m[:, None]] = known[b]
    base = np.arange(size) * letters
    rows += base
    text += base
    table = np.zeros(size * letters, np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    plus_in, minus_in = np.ones((columns, size), np.uint64), np.zeros((columns, size), np.uint64)
    score = n.copy()
    for w in range(words):
        s = int(np.searchsorted(n, 64 * w, "right"))  # pairs that reach this word
        own = rows[64 * w : 64 * w + 64, s:]
        for bit in range(64):
            table[own[bit]] |= np.uint64(1 << bit)
        hits = table[text[:, s:]]
        table[own] = 0
        ends = (n[s:] - 1) // 64 == w
        last = np.where(ends, one << ((n[s:] - 1) % 64).astype(np.uint64), 0).astype(np.uint64)
        e = int(ends.sum())  # sorted: they come first
        up, down = np.full(size - s, ~np.uint64(0)), np.zeros(size - s, np.uint64)
        v, same, plus, minus = (np.empty(size - s, np.uint64) for _ in range(4))
        rise, fall = np.empty((columns, e), np.uint64), np.empty((columns, e), np.uint64)
        for t in range(columns):
            hit, p_in, m_in = hits[t], plus_in[t, s:], minus_in[t, s:]
            np.bitwise_or(hit, down, out=v)
            np.bitwise_or(hit, m_in, out=hit)
            np.bitwise_and(hit, up, out=same)
            np.add(same, up, out=same)
            np.bitwise_xor(same, up, out=same)
            np.bitwise_or(same, hit, out=same)
            np.bitwise_or(same, up, out=plus)
            np.invert(plus, out=plus)
            np.bitwise_or(plus, down, out=plus)
            np.bitwise_and(up, same, out=minus)
            if e:
                np.bitwise_and(plus[:e], last[:e], out=rise[t])
                np.bitwise_and(minus[:e], last[:e], out=fall[t])
            np.left_shift(plus, one, out=same)
            np.bitwise_or(same, p_in, out=same)
            np.right_shift(plus, top, out=p_in)
            np.left_shift(minus, one, out=up)
            np.bitwise_or(up, m_in, out=up)
            np.right_shift(minus, top, out=m_in)
            np.bitwise_and(same, v, out=down)
            np.bitwise_or(same, v, out=same)
            np.invert(same, out=same)
            np.bitwise_or(up, same, out=up)
        if e:
            inside = np.arange(columns)[:, None] < m[s : s + e]
            score[s : s + e] += ((rise != 0) & inside).sum(0) - ((fall != 0) & inside).sum(0)
    return score.tolist()
