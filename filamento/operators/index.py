"""Filing index and universe operators: selection, ranking, relational look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamento.functions import text as X
from filamento.plans.runtime import salted_join
from filamento.sources.remote import MarketCapSourceUnavailable

RANKS = {"original": 0, "attachment_added": 1, "material_amendment": 2}


def annual_rows(filings: DataFrame, years: tuple[int, int] | None = None, december_only: bool = False) -> DataFrame:
    """Filings whose name, after one leading bracket, is an annual report with a period.

    Adds ``period_year`` and ``month``. Null names drop out.
    """
    bare = X.strip(F.regexp_replace("report_nm", r"(?U)^\[[^\]]*\]\s*", ""))
    out = filings.where(bare.rlike(r"(?U)^사업보고서\s*\(") & ~bare.contains("분기") & ~bare.contains("반기"))
    out = out.withColumn("period_year", X.period_part(F.col("report_nm"), 1)).withColumn("month", X.period_part(F.col("report_nm"), 2)).where("period_year is not null")
    if years:
        out = out.where(F.col("period_year").between(*years))
    return out.where("month = 12") if december_only else out


def pick_original(candidates: DataFrame, group: list[str], name: str, date: str, number: str) -> DataFrame:
    """Per group the body-original filing: kind first, then date, then number; and whether any
    material amendment exists. A grouped minimum, so a group of any size combines map-side."""
    kind = X.report_type(F.col(name))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), kind)
    best = F.min(F.struct(rank.alias("rank"), F.coalesce(date, F.lit("")).alias("date"), F.col(number).alias("number"), kind.alias("kind"))).alias("b")
    g = candidates.groupBy(*group).agg(best, F.bool_or(kind == "material_amendment").alias("is_correction_exists"), F.count(F.lit(1)).alias("n_candidates"))
    return g.select(*group, F.col("b.number").alias(number), F.col("b.kind").alias("kind"), (F.col("b.kind") == "material_amendment").alias("is_correction"), "is_correction_exists", "n_candidates")


def excluded_reason(name: Column, sector: Column | None, mcap: Column, sectors: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    """First reason for leaving a listing out: sector, name pattern, missing or non-positive value."""
    out = F.when(sector.isin(*sectors), "sector") if sector is not None else F.when(F.lit(False), "")
    return out.when(name.rlike("|".join(patterns)), "name").when(mcap.isNull() | (mcap <= 0), "mcap")


def snapshot(listings: DataFrame, market_values: DataFrame, financial: DataFrame, *, code: str, name: str, value: str, method: str | None, patterns: tuple[str, ...]) -> DataFrame:
    """Every code of the listings and of the market values with name, value, whether it is in the financial
    sector and why it is left out (null: it is kept). Each side is one row per code, of equal codes the greatest.

    ``method`` names where market values come from; without one they would be a silent guess, and
    MarketCapSourceUnavailable is raised.
    """
    if not method:
        raise MarketCapSourceUnavailable("no source of market values is configured")
    one = lambda df, c: df.where(F.col(code).isNotNull()).groupBy(code).agg(F.max(c).alias(c))
    sector = financial.select(code).where(F.col(code).isNotNull()).distinct().withColumn("_sector", F.lit("financial"))
    met = one(listings, name).join(one(market_values, value), code, "full_outer").join(sector, code, "left")
    reason = excluded_reason(F.col(name), F.col("_sector"), F.col(value), ("financial",), patterns)
    return met.select(code, name, value, F.col("_sector").isNotNull().alias("is_financial"), reason.alias("excluded_reason"))


def ranked_top(df: DataFrame, group: str, by: str, tie: str, top: int | None, rank: str) -> DataFrame:
    """Rank 1..n by falling ``by`` within ``group`` (ties by ``tie``), the first ``top`` if given.

    With ``top`` Spark keeps only the best rows of each task before the shuffle (a group limit).
    """
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    out = df.withColumn(rank, F.row_number().over(w))
    return out.where(F.col(rank) <= top) if top else out


def listed_at(snapshots: DataFrame, listings: DataFrame, *, at: str, code: str, listed: str, delisted: str) -> DataFrame:
    """(at, code): listings with ``listed`` <= at < ``delisted`` (null: open end; null ``listed``: always).

    Snapshot days are few (bounded by the calendar, one row a year) and are the broadcast side.
    """
    days = F.broadcast(snapshots.select(at).where(F.col(at).isNotNull()).distinct())
    spans = listings.where(F.col(code).isNotNull()).select(code, listed, delisted).distinct()
    inside = (F.col(listed).isNull() | (F.col(listed) <= F.col(at))) & (F.col(delisted).isNull() | (F.col(delisted) > F.col(at)))
    return spans.join(days, inside).select(at, code).distinct()


def missing_previous(keys: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, period - 1) needed by a later row but absent; the table's first period needs none."""
    have = keys.select(entity, period).where(F.col(entity).isNotNull() & F.col(period).isNotNull()).distinct()
    first = have.agg(F.min(period).alias("_first")).scalar()
    need = have.where(F.col(period) > first).select(entity, (F.col(period) - 1).alias(period))
    return need.join(have, [entity, period], "left_anti")


def same_group_pairs(members: DataFrame, scope: list[str], group: str, code: str) -> DataFrame:
    """Unordered pairs a < b of one group and scope; both sides distinct."""
    m = members.where(F.col(group).isNotNull() & F.col(code).isNotNull()).select(*scope, group, code).distinct()
    return m.withColumnRenamed(code, "a").join(m.withColumnRenamed(code, "b"), [*scope, group]).where("a < b").select(*scope, group, "a", "b")


def latest_by(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``; a map-side combined maximum."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])).alias("_m")).select(key, *[F.col(f"_m._v{i}").alias(v) for i, v in enumerate(values)])


def with_lookup(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left look-up that keeps the row count: ``other`` is unique by ``keys``; hot keys are salted."""
    return salted_join(df, other, keys, "left")
