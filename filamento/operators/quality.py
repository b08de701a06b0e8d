"""Quality and diagnostic aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """n, mean, median and exact interpolated quantiles per group; null groups drop, null values don't count."""
    keep = F.lit(True)
    for c in by:
        keep = keep & F.col(c).isNotNull()
    q = [F.percentile(value, p).alias(n) for n, p in (quantiles or {}).items()]
    return df.where(keep).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), *q)


def paragraph_length_stats(paras: DataFrame, doc: list[str], text: str) -> DataFrame:
    """n, mean, median, p10, p90, n_under_10 and share_under_10 of paragraph lengths."""
    n = F.length(text)
    short = F.count_if(n < 10)
    return paras.where(F.col(text).isNotNull()).groupBy(*doc).agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.1).alias("p10"), F.percentile(n, 0.9).alias("p90"), short.alias("n_under_10"), (short / F.count(F.lit(1))).alias("share_under_10"))


def rate(condition: Column) -> Column:
    """Share of rows where a condition holds; null counts as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def cross_section(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, standard deviation (n - 1), standard error and the 95 % interval per group."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return g.withColumn("se", se).withColumn("lo", F.col("mean") - 1.96 * se).withColumn("hi", F.col("mean") + 1.96 * se)


def history_z(groups: DataFrame, series: list[str], value: str) -> DataFrame:
    """z of each group's value against all values of its series; 0 where they don't vary."""
    w = Window.partitionBy(*series)
    sd = F.stddev_samp(value).over(w)
    return groups.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def step_flags(share_up: Column, up: float = 0.75, down: float = 0.25) -> Column:
    """up, down or none: consensus of the share of rising members."""
    return F.when(share_up >= up, "up").when(share_up <= down, "down").otherwise("none")


def spikes(df: DataFrame, entity: str | list[str], by: list[str], value: str, above: float = 0.0) -> DataFrame:
    """Per ``by``: mean, demeaned mean, z (null where an entity doesn't vary) and share more than ``above`` over the entity's mean."""
    w = Window.partitionBy(*([entity] if isinstance(entity, str) else entity))
    dev = F.col(value) - F.avg(value).over(w)
    x = df.withColumn("_d", dev).withColumn("_z", dev / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))
    return x.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg("_d").alias("demeaned"), F.avg("_z").alias("z"), rate(F.col("_d") > above).alias("share_positive"))


def table_ratios(tables: DataFrame, orphans: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc, n_tables, n_captioned, share_captioned, orphan_chars, body_chars, share_orphan) of documents
    with tables. ``tables`` is (doc, caption), ``orphans`` (doc, orphan_chars), ``bodies`` (doc, body_chars)."""
    g = tables.groupBy("doc").agg(F.count(F.lit(1)).alias("n_tables"), F.count("caption").alias("n_captioned"))
    met = g.join(bodies, "doc", "left").join(orphans, "doc", "left").withColumn("orphan_chars", F.coalesce("orphan_chars", F.lit(0)))
    share = lambda a, b, digits: F.round(F.try_divide(F.col(a), F.col(b)), digits)
    return met.select("doc", "n_tables", "n_captioned", share("n_captioned", "n_tables", 4).alias("share_captioned"), "orphan_chars", "body_chars", share("orphan_chars", "body_chars", 5).alias("share_orphan"))


def layout_ratios(tables: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_tables, n_layout, layout_chars, table_chars and both shares) of (is_layout, n_chars) tables."""
    chars = F.sum(F.when(F.col("is_layout"), F.col("n_chars")).otherwise(0))
    g = tables.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tables"), F.count_if("is_layout").alias("n_layout"), chars.alias("layout_chars"), F.sum("n_chars").alias("table_chars"))
    return g.withColumns({"share_layout": F.round(F.try_divide(F.col("n_layout"), F.col("n_tables")), 4), "share_layout_chars": F.round(F.try_divide(F.col("layout_chars"), F.col("table_chars")), 4)})


def dominance(df: DataFrame, scope: list[str], member: str, limit: float) -> DataFrame:
    """Share of each member in its scope's rows, with an alert above ``limit``."""
    g = df.groupBy(*scope, member).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*scope))
    return g.withColumn("share", share).withColumn("alert", share > limit)


def gate(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, limit, verdict) of a one-row table of metrics: PASS, FAIL or undecided (null)."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("limit"), F.when(F.col(m).isNull(), "undecided").when(F.col(m) >= x if op == ">=" else F.col(m) <= x, "PASS").otherwise("FAIL").alias("verdict")) for m, (op, x) in limits.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def first_by(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """One row per ``subset``: the first in ``order`` (give a unique one). A map-side combined minimum."""
    rest = [c for c in df.columns if c not in subset]
    m = F.min(F.struct(*order, F.struct(*rest).alias("_r"))).alias("_m")
    return df.groupBy(*subset).agg(m).select(*subset, *[F.col("_m")["_r"][c].alias(c) for c in rest])
