"""Point-in-time panels: windows that never cross an entity, as-of joins, look-ahead checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamento.plans.runtime import salted_join


class LookAheadError(ValueError):
    """A panel row uses a fact that was not yet available."""


class BoundaryError(ValueError):
    """A windowed value reaches into another entity's rows."""


def daily(df: DataFrame, key: str, date: str, *values: str) -> DataFrame:
    """One row per key and date (greatest values), combined map-side: the windows below then hold at
    most one row per calendar day of an entity, however many rows it had. Null keys or dates drop."""
    present = df.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    return present.groupBy(key, date).agg(*[F.max(v).alias(v) for v in values])


def _require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def _order(df: DataFrame, key: str, date: str) -> Window:
    _require(df, key, date)
    return Window.partitionBy(key).orderBy(date)


def shifted(df: DataFrame, value: str, periods: int, *, key: str, date: str, out: str) -> DataFrame:
    """Value of the row ``periods`` before in the entity; negative periods look ahead."""
    w = _order(df, key, date)
    return df.withColumn(out, F.lag(value, periods).over(w) if periods >= 0 else F.lead(value, -periods).over(w))


def difference(df: DataFrame, value: str, periods: int, *, key: str, date: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, periods).over(_order(df, key, date)))


def pct_change(df: DataFrame, value: str, periods: int, *, key: str, date: str, out: str) -> DataFrame:
    """Relative change; null where the earlier value is zero or missing."""
    before = F.lag(value, periods).over(_order(df, key, date))
    return df.withColumn(out, (F.col(value) - before) / F.nullif(before, F.lit(0.0)))


def rolling(df: DataFrame, value: str, window: int, how: str, *, key: str, date: str, out: str, min_periods: int | None = None) -> DataFrame:
    """mean, sum, std, min, max or count of the last ``window`` rows, null below ``min_periods`` values."""
    fn = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}[how]
    w = _order(df, key, date).rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) >= (window if min_periods is None else min_periods), fn(value).over(w)))


def forward_return(df: DataFrame, price: str, horizon: int, *, key: str, date: str, out: str) -> DataFrame:
    """Return over the next ``horizon`` rows: a label, never a feature. Null at zero prices."""
    return df.withColumn(out, F.try_divide(F.lead(price, horizon).over(_order(df, key, date)), F.col(price)) - 1)


def next_trading_day(dates: DataFrame, calendar: DataFrame, date: str, day: str, out: str, require: bool = False) -> DataFrame:
    """First calendar day strictly after each date; null past its end, or an error if required.

    Distinct dates and calendar days meet in one window whose size is bounded by the calendar, and
    the resulting map (a row per date) is joined back.
    """
    marks = dates.select(F.unix_date(F.col(date).cast("date")).alias("_d")).where("_d is not null").distinct().withColumn("_cal", F.lit(0))
    days = calendar.select(F.unix_date(F.col(day).cast("date")).alias("_d")).where("_d is not null").distinct().withColumn("_cal", F.lit(1))
    ahead = Window.orderBy("_d").rangeBetween(1, Window.unboundedFollowing)
    lookup = marks.unionByName(days).withColumn(out, F.date_from_unix_date(F.min(F.when(F.col("_cal") == 1, F.col("_d"))).over(ahead))).where("_cal = 0").select("_d", out)
    if require:
        lookup = lookup.withColumn(out, F.coalesce(out, F.raise_error(F.lit("the calendar ends before the next trading day")).cast("date")))
    return dates.withColumn("_d", F.unix_date(F.col(date).cast("date"))).join(lookup, "_d", "left").drop("_d")


def as_of(panel: DataFrame, facts: DataFrame, *, key: str, date: str, available: str, values: list[str], bucket_days: int = 90) -> DataFrame:
    """``panel`` with the fact values last available at each row's date (equal days included).

    Of several facts of one key and day the greatest values row counts. Distinct (key, day) points
    are located, so repeated rows cost nothing; time is cut into buckets, each starting from the last
    fact before it, so a hot entity is spread over its buckets. All values come from one fact, also
    where some are null. Without facts the value columns are null. The fact's own day comes out as
    ``available``, for the look-ahead check.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    bucket = lambda: F.floor(F.col("_t") / bucket_days).cast("int")
    f = facts.where(F.col(key).isNotNull() & F.col(available).isNotNull()).groupBy(key, day(available).alias("_t")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_b", bucket())
    p = panel.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(key, day(date).alias("_t")).distinct().withColumn("_b", bucket())
    last = f.groupBy(key, "_b").agg(F.max_by(F.struct("_t", "_v"), "_t").alias("_last"))
    kind = last.schema["_last"].dataType
    steps = last.unionByName(p.select(key, "_b").distinct().withColumn("_last", F.lit(None).cast(kind))).groupBy(key, "_b").agg(F.first("_last", True).alias("_last"))
    carried = steps.withColumn("_carry", F.last("_last", True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_b", "_carry")
    rows = f.select(key, "_b", "_t", F.struct("_t", "_v").alias("_fact"), F.lit(0).alias("_side")).unionByName(p.select(key, "_b", "_t", F.lit(None).cast(kind).alias("_fact"), F.lit(1).alias("_side")))
    within = Window.partitionBy(key, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_got", F.last("_fact", True).over(within)).where("_side = 1").join(carried, [key, "_b"], "left")
    located = found.select(key, "_t", F.coalesce("_got", "_carry").alias("_got"))
    joined = salted_join(panel.withColumn("_t", day(date)), located, [key, "_t"], "left")
    return joined.select(*panel.columns, F.date_from_unix_date(F.col("_got")["_t"]).alias(available), *[F.col("_got")["_v"][v].alias(v) for v in values])


def lookahead_violations(df: DataFrame, date: str, available: str) -> DataFrame:
    return df.where(F.col(available) > F.col(date).cast("date"))


def assert_no_lookahead(df: DataFrame, date: str, available: str) -> DataFrame:
    if not lookahead_violations(df, date, available).isEmpty():
        raise LookAheadError("facts are used before they are available")
    return df


def assert_no_cross_boundary(df: DataFrame, *, key: str, date: str, columns: list[str]) -> DataFrame:
    """The first row of every entity must have no value in columns that look backwards."""
    _require(df, key, date, *columns)
    firsts = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(date))).where("_rn = 1")
    bad: Column = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNotNull()
    if not firsts.where(bad).isEmpty():
        raise BoundaryError(f"{columns} reach across {key}")
    return df
