"""Edit distances and matching blocks against difflib and the plain table; the four measures of whole texts."""

import random
import time
from difflib import SequenceMatcher

import pytest

from filamento.operators import edits as E
from filamento.operators import similarity as M
from filamento.plans import registry


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def texts(seed, n, most):
    rnd = random.Random(seed)
    for _ in range(n):
        letters = rnd.choice(["ab", "abcdefgh", "가나다라마바사😀 "])
        a = "".join(rnd.choices(letters, k=rnd.randrange(most)))
        yield a, "".join(rnd.choices(letters, k=rnd.randrange(most))) if rnd.random() < 0.6 else a[: rnd.randrange(most)] + rnd.choice(["", "나", "ab"]) + a[rnd.randrange(most) :]


@pytest.mark.parametrize("hits", [20, 100, E.HITS])
def test_matching_blocks_are_those_of_difflib(monkeypatch, hits):
    monkeypatch.setattr(E, "HITS", hits)
    for a, b in texts(3, 400, 90):
        assert E.matching_ratio(a, b) == ratio(a, b), (a, b)


def test_matching_blocks_take_a_fraction_of_difflibs_time():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("가나다라마바사아자차카타파하", k=rnd.randrange(1, 5))) for _ in range(200)]
    a, b = (" ".join(rnd.choices(words, k=500)) for _ in "ab")
    took = []
    for f in (E.matching_ratio, ratio):
        began = time.process_time()
        f(a, b)
        took.append(time.process_time() - began)
    assert took[0] * 3 < took[1]


def test_distances_together_and_alone():
    pairs = [*texts(4, 200, 200), ("", "가"), ("가", ""), ("", ""), ("가" * 64, "가" * 63), ("가" * 128, "나" * 64)]
    want = [distance(a, b) for a, b in pairs]
    assert E.distances(pairs) == want and [E.distance(a, b) for a, b in pairs] == want
    held = sorted(((p if len(p[0]) >= len(p[1]) else p[::-1]) for p in pairs if p[0] and p[1]), key=lambda p: len(p[0]))
    assert E._grouped(held) == [distance(a, b) for a, b in held]


def test_impact_has_texts_of_any_length(spark, tmp_path):
    rnd = random.Random(5)
    a = "".join(rnd.choices("가나다라마바사아자차 ", k=20_400))
    b = a[:9000] + "".join(rnd.choices("카타파하", k=300)) + a[9100:] + " &cr;"
    short = {"2": ("매출이 &cr;늘었습니다", "매출이 크게 늘었습니다"), "3": ("같은 글입니다", "같은 글입니다")}
    rows = [(corp, 2020 + k, sid, t) for sid, held in (("s1", {"1": (a, b)}), ("s2", short)) for corp, sides in held.items() for k, t in enumerate(sides)]
    spark.createDataFrame(rows, "corp_code string, fy int, section_id string, text string").write.parquet(str(tmp_path / "section_contents.parquet"))
    got = {r.sid: r for r in registry.queries()["m13_artifact_impact_whole"](spark, str(tmp_path)).collect()}
    clean = lambda t: t.replace("&cr;", "").strip()
    assert got["S1"].difflib_before == pytest.approx(1 - E.matching_ratio(a, b), abs=1e-4) and 0 < got["S1"].difflib_before < 0.1
    assert got["S1"].levenshtein_after == pytest.approx(1 - (1 - E.distance(a, clean(b)) / max(len(a), len(clean(b)))), abs=2e-4)
    pairs = [short["2"], short["3"]]
    assert got["S2"].difflib_before == pytest.approx(sum(1 - ratio(*p) for p in pairs) / 2, abs=1e-4)
    assert got["S2"].difflib_after == pytest.approx(sum(1 - ratio(clean(p), clean(q)) for p, q in pairs) / 2, abs=1e-4)
    assert got["S2"].levenshtein_after == pytest.approx(sum(distance(clean(p), clean(q)) / max(len(clean(p)), len(clean(q))) for p, q in pairs) / 2, abs=1e-4)


def test_edit_ratios_of_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("", ""), ("ab", "ac")], "a string, b string").select(M.edit_ratios("a", "b").alias("x"))
    assert [r.x and tuple(r.x) for r in df.collect()] == [None, None, (1.0, 1.0), (0.5, 0.5)]
