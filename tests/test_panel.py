"""Panels: no crossing of entities, as-of joins without look-ahead, the trading calendar."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filamento.operators import panel as P

KEY = {"key": "stock_code", "date": "date"}
D = lambda s: dt.date.fromisoformat(s)


@pytest.fixture
def panel(spark):
    rows = [("A", D(f"2024-01-0{i}"), x) for i, x in ((1, 100.0), (2, 110.0), (3, 121.0))] + [("B", D(f"2024-01-0{i}"), x) for i, x in ((1, 500.0), (2, 550.0), (3, 605.0))]
    return spark.createDataFrame(rows, "stock_code string, date date, px double").orderBy(F.rand(3))


def values(df, c):
    return {(r.stock_code, r.date.day): r[c] for r in df.collect()}


def test_first_rows_have_no_past(panel):
    for df in (P.shifted(panel, "px", 1, out="o", **KEY), P.difference(panel, "px", 1, out="o", **KEY), P.pct_change(panel, "px", 1, out="o", **KEY), P.rolling(panel, "px", 2, "mean", out="o", **KEY)):
        v = values(df, "o")
        assert v["A", 1] is None and v["B", 1] is None and v["B", 2] is not None
        P.assert_no_cross_boundary(df, columns=["o"], **KEY)


def test_forward_return(panel):
    v = values(P.forward_return(panel, "px", 1, out="o", **KEY), "o")
    assert v["A", 1] == pytest.approx(0.1) and v["A", 3] is None


def test_crossing_is_caught(panel):
    from pyspark.sql import Window

    bad = panel.withColumn("o", F.lag("px").over(Window.orderBy("stock_code", "date")))
    with pytest.raises(P.BoundaryError):
        P.assert_no_cross_boundary(bad, columns=["o"], **KEY)
    with pytest.raises(KeyError):
        P.shifted(panel.drop("date"), "px", 1, out="o", **KEY)


def test_zero_price_gives_null(spark):
    df = spark.createDataFrame([("A", D("2024-01-01"), 0.0), ("A", D("2024-01-02"), 5.0)], "stock_code string, date date, px double")
    assert values(P.pct_change(df, "px", 1, out="o", **KEY), "o")["A", 2] is None
    assert values(P.forward_return(df, "px", 1, out="o", **KEY), "o")["A", 1] is None


def test_as_of(spark):
    panel = spark.createDataFrame([("A", D(x)) for x in ("2025-01-02", "2025-03-13", "2025-03-14", "2025-09-30")] + [("B", D("2025-03-17")), (None, D("2025-03-17")), ("A", None)], "stock_code string, date date")
    facts = spark.createDataFrame([("A", D("2025-03-14"), 0.12, None), ("B", D("2025-03-21"), 0.99, "x")], "stock_code string, avail date, roa double, note string")
    out = P.as_of(panel, facts, key="stock_code", date="date", available="avail", values=["roa", "note"])
    got = {(r.stock_code, str(r.date)): r.roa for r in out.collect()}
    assert got == {("A", "2025-01-02"): None, ("A", "2025-03-13"): None, ("A", "2025-03-14"): 0.12, ("A", "2025-09-30"): 0.12, ("B", "2025-03-17"): None, (None, "2025-03-17"): None, ("A", "None"): None}
    P.assert_no_lookahead(out, "date", "avail")
    empty = P.as_of(panel, facts.limit(0), key="stock_code", date="date", available="avail", values=["roa"])
    assert empty.columns == ["stock_code", "date", "avail", "roa"] and empty.where("roa is not null").isEmpty()


def test_lookahead_is_caught(spark):
    df = spark.createDataFrame([(D("2024-01-01"), D("2024-01-02"))], "date date, avail date")
    with pytest.raises(P.LookAheadError):
        P.assert_no_lookahead(df, "date", "avail")


def test_as_of_does_not_depend_on_partitioning(spark):
    panel = spark.range(400).select((F.col("id") % 7).cast("string").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 37 % 900).cast("int")).alias("date"))
    facts = spark.range(150).select((F.col("id") % 7).cast("string").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 53 % 900).cast("int")).alias("avail"), F.col("id").alias("v"))
    run = lambda n: sorted(map(str, P.as_of(panel.repartition(n), facts.repartition(n), key="k", date="date", available="avail", values=["v"]).collect()))
    assert run(1) == run(7)
    best = {}
    for f in facts.collect():
        best.setdefault((f.k, f.avail), []).append(f.v)
    for r in P.as_of(panel, facts, key="k", date="date", available="avail", values=["v"]).collect():
        past = [(a, max(v)) for (k, a), v in best.items() if k == r.k and a <= r.date]
        assert r.v == (max(past)[1] if past else None)


def test_calendar(spark):
    days = ["2025-02-26", "2025-02-27", "2025-02-28", "2025-03-04", "2025-03-05", "2025-03-06", "2025-03-07", "2025-03-10", "2025-03-11"]
    calendar = spark.createDataFrame([(D(x),) for x in days], "day date")
    asked = spark.createDataFrame([(D(x),) for x in ("2025-03-04", "2025-03-07", "2025-02-28", "2025-03-01", "2025-03-02", "2025-03-11")], "d date")
    got = {str(r.d): str(r.e) for r in P.next_trading_day(asked, calendar, "d", "day", "e").collect()}
    assert got == {"2025-03-04": "2025-03-05", "2025-03-07": "2025-03-10", "2025-02-28": "2025-03-04", "2025-03-01": "2025-03-04", "2025-03-02": "2025-03-04", "2025-03-11": "None"}
    with pytest.raises(Exception, match="calendar ends"):
        P.next_trading_day(asked, calendar, "d", "day", "e", require=True).collect()
