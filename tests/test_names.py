"""Fuzzy names against all pairs, and names that all share one ending."""

import random

import pytest
from pyspark.sql import functions as F

from filamento.operators import sections as S
from filamento.operators import similarity as M


@pytest.mark.parametrize("threshold", [92.0, 88.0, 75.0])
def test_best_choice_is_that_of_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold))
    listed = sorted({"".join(rnd.choices("가나다라", k=rnd.randrange(3, 9))) + rnd.choice(["산업", "에너지", "홀딩스사업본부", "전자" * 32]) for _ in range(150)})
    bent = lambda t: "".join(rnd.choice(["", ch + rnd.choice("가마")]) if rnd.random() < 0.1 else ch for ch in t)
    names = sorted({bent(rnd.choice(listed)) for _ in range(150)} | {"무관한이름", "가"})
    got = M.match_names(spark.createDataFrame([(n, n) for n in names], "k string, n string"), spark.createDataFrame([(t,) for t in listed], "c string"), key="k", name="n", choice="c", threshold=threshold)
    want = set()
    for n in names:
        score, best = max((S.indel_ratio(n, t), t) for t in listed)
        if n in listed or score >= threshold:
            want.add((n, n if n in listed else best, "exact" if n in listed else "fuzzy", 100.0 if n in listed else round(score, 4)))
    assert {(r.n, r.choice, r.match_type, r.score) for r in got.collect()} == want and len({w[2] for w in want}) == 2


def test_a_shared_ending_pairs_nothing(spark, monkeypatch):
    """All names share seven characters; only names and choices of one stem may be compared."""
    seen = spark.sparkContext.accumulator(0)
    plain = M.indel_ratio

    @M.arrow("double")
    def counted(a, b):
        seen.add(len(a))
        return M.pa.array([plain(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], M.pa.float64())

    monkeypatch.setattr(M, "_indel", counted)
    rnd = random.Random(7)
    stems = sorted({"".join(rnd.choices("가나다라마바사아자차카타파하", k=5)) for _ in range(400)})
    df = spark.createDataFrame([(s + "홀딩스사업본무", s + "홀딩스사업본부") for s in stems], "n string, c string")
    got = {(r.n, r.choice) for r in M.match_names(df.withColumn("k", F.col("n")), df.select("c"), key="k", name="n", choice="c", threshold=88.0).collect()}
    assert got == {(s + "홀딩스사업본무", s + "홀딩스사업본부") for s in stems}
    assert 0 < seen.value < 20 * len(stems)
