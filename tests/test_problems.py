"""Versions known at event time, and changes between snapshots, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from filamento.functions.unicode import canonical
from filamento.operators.bitemporal import known_version, rectangles, sweep
from filamento.operators.snapshots import snapshot_changes

V = "s string, snap date, known timestamp, id bigint, known_at string"
E = "e bigint, s string, d date, version string"
OPTS = {"entity": "s", "event_id": "e", "at": "d", "valid_from": "snap", "known_at": "known", "version": "id"}
day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)


def versions(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], V)


def brute(vs, d):
    known = [(v[1], v[2], v[3]) for v in vs if v[1] <= d and v[2] < dt.datetime.combine(d, dt.time())]
    return max(known)[2] if known else None


def test_known_versions_against_brute_force(spark):
    rnd = random.Random(5)
    vs = [(rnd.choice("AAAAAB"), day(rnd.randrange(60)), dt.datetime(2020, 1, 1) + dt.timedelta(rnd.randrange(70), rnd.choice([0, 3600, 86399])), i) for i in range(120)]
    es = [(i, rnd.choice("AABC"), day(rnd.randrange(80))) for i in range(300)]
    out = known_version(spark.createDataFrame([(*e, "x") for e in es] + [(1, None, day(3), "x"), (2, "A", None, "x")], E), versions(spark, vs + vs[:5]), **OPTS)
    got = {(r.e, r.version, r.latest) for r in out.collect()}
    want = set()
    for e, s, d in es:
        mine = [v for v in vs if v[0] == s]
        b = brute(mine, d)
        if b is not None:
            want.add((e, b, max((v[1], v[2], v[3]) for v in mine)[2]))
    assert got == want


def test_points_off_the_diagonal_and_far_dates(spark):
    rnd = random.Random(15)
    vs = [(rnd.choice("AAB"), day(rnd.randrange(400)), dt.datetime(2020, 1, 1) + dt.timedelta(rnd.randrange(500), rnd.choice([0, 7200])), i) for i in range(90)]
    es = [(i, rnd.choice("AB"), day(rnd.randrange(500)), day(rnd.randrange(600))) for i in range(200)] + [(900, "A", dt.date(9999, 12, 31), dt.date(9999, 12, 31)), (901, "A", dt.date(1850, 1, 1), dt.date(9999, 12, 31)), (902, "A", day(3), None)]
    events = spark.createDataFrame(es, "e bigint, s string, d date, seen date")
    got = {(r.e, r.version) for r in known_version(events, versions(spark, vs), **OPTS, recorded_at="seen", cell_days=50).collect()}
    want = set()
    for e, s, d, seen in es:
        known = [(v[1], v[2], v[3]) for v in vs if seen and v[0] == s and v[1] <= d and v[2] < dt.datetime.combine(seen, dt.time())]
        if known:
            want.add((e, max(known)[2]))
    assert got == want and 900 in {e for e, _ in got} and len(got) > 100


def test_rectangles_are_disjoint_and_few():
    rnd = random.Random(9)
    points = [(rnd.randrange(20), rnd.randrange(20), i) for i in range(60)]
    best = {}
    for v, r, i in points:
        best[v, r] = max(best.get((v, r), -1), i)
    rects = sweep([(v, r, i) for (v, r), i in best.items()])
    assert len(rects) <= 2 * len(best)
    for v in range(22):
        for r in range(22):
            inside = [x for x in rects if x[0] <= v and (x[1] is None or v < x[1]) and x[2] <= r and (x[3] is None or r < x[3])]
            known = [(a, b, i) for (a, b), i in best.items() if a <= v and b <= r]
            assert [x[4] for x in inside] == ([max(known)[2]] if known else [])


def test_known_version_of_nothing(spark):
    none = versions(spark, []).limit(0)
    events = spark.createDataFrame([(1, "A", day(1), "x")], E)
    assert known_version(events, none, **OPTS).isEmpty() and rectangles(none, "s", "snap", "known", "id").isEmpty()
    assert known_version(events.limit(0), versions(spark, [("A", day(0), dt.datetime(2019, 1, 1), 1)]), **OPTS).isEmpty()


def test_a_hot_entity_is_whole(spark):
    events = spark.range(3000).select(F.col("id").alias("e"), F.lit("A").alias("s"), F.date_add(F.lit(day(0)), (F.col("id") % 90).cast("int")).alias("d"))
    out = known_version(events, versions(spark, [("A", day(0), dt.datetime(2019, 1, 1), 7), ("A", day(40), dt.datetime(2020, 2, 20), 8)]), **OPTS)
    assert out.count() == 3000 and {r.version for r in out.select("version").distinct().collect()} == {7, 8}


def changes(spark, rows):
    df = spark.createDataFrame(rows, "c string, y int, k string, p string, at int, change string")
    out = snapshot_changes(df.withColumn("p", canonical(F.col("p"))), series=["c"], period="y", key="k", content=F.col("p"), loaded_at="at")
    return {(r.c, r.y, r.k, r.change) for r in out.collect()}


def test_snapshot_changes(spark):
    rows = [("A", 2015, "1", "가 나", 1, ""), ("A", 2015, "2", "x", 1, ""), ("A", 2015, "3", None, 1, ""), ("A", 2015, "4", "old", 1, ""), ("A", 2015, "4", "new", 2, "")]
    rows += [("A", 2017, "1", "가​  나 ", 1, ""), ("A", 2017, "3", "", 1, ""), ("A", 2017, "4", "ｎew", 1, ""), ("A", 2017, "5", "z", 1, ""), ("A", 2017, None, "q", 1, ""), (None, 2017, "9", "q", 1, ""), ("B", 2016, "1", "b", 1, "")]
    want = {("A", 2017, "2", "removed"), ("A", 2017, "3", "modified"), ("A", 2017, "5", "added")}
    assert changes(spark, rows) == changes(spark, rows + rows) == want
    assert changes(spark, rows[:1]) == set()


def test_snapshot_changes_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("AB"), rnd.randrange(2015, 2019), str(rnd.randrange(6)), rnd.choice(["x", "y", None]), i, "") for i in range(80)]
    state = {}
    for c, y, k, p, at, _ in sorted(rows, key=lambda r: r[4]):
        state.setdefault((c, y), {})[k] = p
    want = set()
    for c in "AB":
        years = sorted(y for s, y in state if s == c)
        for a, b in zip(years, years[1:]):
            old, new = state[c, a], state[c, b]
            want |= {(c, b, k, "added") for k in new.keys() - old} | {(c, b, k, "removed") for k in old.keys() - new} | {(c, b, k, "modified") for k in old.keys() & new if old[k] != new[k]}
    assert changes(spark, rows) == want
