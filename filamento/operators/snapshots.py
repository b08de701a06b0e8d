"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamento.plans.runtime import materialize, salted_join


def row_hash(*values: Column) -> Column:
    """Hash of a canonical row; null is a value of its own and differs from every string."""
    parts = [F.when(v.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.md5(F.concat(*parts)))


def snapshot_changes(rows: DataFrame, *, series: list[str], period: str, key: str, content: Column, loaded_at: str) -> DataFrame:
    """(series, period, key, change) with change in added, modified, removed.

    Rows of one (series, period) form a snapshot; of a key delivered several times in it the latest
    ``loaded_at`` counts (ties: the greatest canonical hash). Snapshots are consecutive when no
    period of the series lies between them; the first has no changes, and ``period`` is that of the
    later one. ``content`` is the canonical content: null equals null and differs from the rest.
    Rows with a null series column or period belong to no snapshot. A null key still makes a
    snapshot, but is no record. Order of rows means nothing; an empty table gives no rows.

    Both sides hold each key once, so the full outer join has no hot key. The rows are read and hashed
    once; counting the rows of each snapshot gives the calendar of its series and the hot snapshots
    that are salted when rows meet that calendar.
    """
    present = reduce(and_, [F.col(c).isNotNull() for c in (*series, period)])
    hashed = rows.where(present).select(*series, period, key, F.col(loaded_at).alias("_at"), row_hash(content).alias("_hash"))
    latest = hashed.groupBy(*series, period, key).agg(F.max(F.struct("_at", "_hash")).alias("_m"))
    state = materialize(latest.select(*series, period, key, F.col("_m._hash").alias("_hash")), "snapshots")
    sizes = materialize(state.groupBy(*series, period).agg(F.count(F.lit(1)).alias("_n")), "snapshot-sizes")
    order = Window.partitionBy(*series).orderBy(period)
    calendar = sizes.select(*series, period, F.lead(period).over(order).alias("_next"), F.lag(period).over(order).isNull().alias("_first"))
    known = salted_join(state.where(F.col(key).isNotNull()), calendar, [*series, period], counts=sizes)
    before = known.where(F.col("_next").isNotNull()).select(*series, F.col("_next").alias(period), key, F.col("_hash").alias("_old"))
    after = known.where(~F.col("_first")).select(*series, period, key, F.col("_hash").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return before.join(after, [*series, period, key], "full_outer").select(*series, period, key, change.alias("change")).where("change is not null")
