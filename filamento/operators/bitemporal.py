"""Attributes as they were known when an event happened.

Versions of an entity live in a plane of valid time (when an attribute holds) and recorded time
(when it became available). The plane is split into disjoint rectangles, each with one current
version; rectangles are indexed by a grid of cells on both axes and every event is located in its cell.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions.udf import arrow
from filamento.plans.runtime import key_counts, materialize, salted_join

RECT = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("v_lo", "v_hi", "r_lo", "r_hi")), T.StructField("version", T.LongType()), T.StructField("latest", T.LongType())]))


def sweep(points: list[tuple[int, int, int]]) -> list[tuple[int, int | None, int, int | None, int]]:
    """Disjoint current-version rectangles of (valid from, recorded from, version) points.

    Recorded time is swept upwards. The open steps cover the valid axis; a new version opens the
    step from its valid day to the next open one and closes what it replaces. Each version closes
    at most one step and opens at most two, so there are at most 2n rectangles; upper ends that
    stay open are None. Within a day, points come in ascending preference.
    """
    starts: list[int] = []
    step: list[tuple[int, int]] = []  # (recorded from, version) of the step that begins at starts[i]
    out = []

    def close(i: int, r: int | None) -> None:
        since, version = step[i]
        if r is None or since < r:
            out.append((starts[i], starts[i + 1] if i + 1 < len(starts) else None, since, r, version))

    for v, r, version in sorted(points, key=lambda p: (p[1], p[0])):
        i = bisect.bisect_left(starts, v)
        if i < len(starts) and starts[i] == v:
            close(i, r)
            step[i] = (r, version)
            continue
        if i:
            close(i - 1, r)
            step[i - 1] = (r, step[i - 1][1])
        starts.insert(i, v)
        step.insert(i, (r, version))
    for i in range(len(starts)):
        close(i, None)
    return out


@arrow(RECT)
def _rectangles(versions: pa.Array) -> pa.Array:
    rows = []
    for group in versions.to_pylist():
        rects = sweep([(x["v"], x["r"], x["version"]) for x in group])
        last = max(group, key=lambda x: (x["v"], x["k"], x["version"]))["version"]
        rows.append([dict(zip(("v_lo", "v_hi", "r_lo", "r_hi", "version", "latest"), (*t, last))) for t in rects])
    fields = [("v_lo", pa.int32()), ("v_hi", pa.int32()), ("r_lo", pa.int32()), ("r_hi", pa.int32()), ("version", pa.int64()), ("latest", pa.int64())]
    return pa.array(rows, type=pa.list_(pa.struct(fields)))


def rectangles(versions: DataFrame, entity: str, valid_from: str, known_at: str, version: str) -> DataFrame:
    """(entity, v_lo, v_hi, r_lo, r_hi, version, latest); days since 1970, upper ends exclusive and null where open.

    ``latest`` is the version that comes last of all. Rows with a null entity, valid day, recording
    time or id are no versions. A version recorded on a day counts from the next day on. Before the
    sweep, versions of one valid and one recorded day collapse to their last in a map-side combined
    aggregate, so a sweep's input is bounded by the calendar, however many rows an entity has.
    """
    v = versions.where(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(known_at).isNotNull() & F.col(version).isNotNull())
    cells = v.groupBy(F.col(entity), F.unix_date(F.col(valid_from).cast("date")).alias("v"), (F.unix_date(F.col(known_at).cast("date")) + 1).alias("r")).agg(
        F.max(F.struct(F.unix_micros(F.col(known_at).cast("timestamp")).alias("k"), F.col(version).cast("bigint").alias("version"))).alias("m")
    )
    grouped = cells.groupBy(entity).agg(F.collect_list(F.struct("v", "r", F.col("m.k").alias("k"), F.col("m.version").alias("version"))).alias("g"))
    return grouped.select(entity, F.explode(_rectangles("g")).alias("x")).select(entity, "x.*")


def located(events: DataFrame, rects: DataFrame, *, entity: str, event_id: str, valid_at: str, recorded_at: str | None = None, cell_days: int = 180) -> DataFrame:
    """(event_id, version, latest, further columns of ``rects``) of every event that lies in a rectangle.

    An event is the point (day of ``valid_at``, day of ``recorded_at``), the latter the same column
    unless named: what was known at its recorded day of its valid day. The plane is cut into square
    cells; rectangles are entered in the cells that hold events, however far they reach, and an event
    meets only those of its own entity and cell. Counting the events of each cell finds those cells and
    the hot ones, which are salted. Events with a null entity or time, or in no rectangle, are left
    out; repeated events give one row; other columns of the events are ignored. Any date will do.
    """
    carried = [c for c in rects.columns if c not in (entity, "v_lo", "v_hi", "r_lo", "r_hi")]
    cell = lambda day: F.floor(F.col(day) / cell_days).cast("int")
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    points = events.select(F.col(event_id).alias("_event"), entity, day(valid_at).alias("_v"), day(recorded_at or valid_at).alias("_r")).where(F.col(entity).isNotNull() & F.col("_v").isNotNull() & F.col("_r").isNotNull())
    points = points.withColumns({"_vc": cell("_v"), "_rc": cell("_r")})
    held = materialize(key_counts(points, [entity, "_vc", "_rc"]), "event-cells")
    meets = lambda c, lo, hi: (F.col(lo) < (F.col(c) + 1) * cell_days) & (F.col(hi).isNull() | (F.col(hi) > F.col(c) * cell_days))
    grid = rects.join(held.drop("_n"), entity).where(meets("_vc", "v_lo", "v_hi") & meets("_rc", "r_lo", "r_hi"))
    inside = lambda p, lo, hi: (F.col(lo) <= F.col(p)) & (F.col(hi).isNull() | (F.col(p) < F.col(hi)))
    met = salted_join(points, grid, [entity, "_vc", "_rc"], counts=held).where(inside("_v", "v_lo", "v_hi") & inside("_r", "r_lo", "r_hi"))
    return met.select(F.col("_event").alias(event_id), *carried).distinct()


def known_version(events: DataFrame, versions: DataFrame, *, entity: str, event_id: str, at: str, valid_from: str, known_at: str, version: str, recorded_at: str | None = None, cell_days: int = 180) -> DataFrame:
    """(event_id, version, latest) of every event with a version known when it happened (or at ``recorded_at``)."""
    rects = rectangles(versions, entity, valid_from, known_at, version)
    return located(events, rects, entity=entity, event_id=event_id, valid_at=at, recorded_at=recorded_at, cell_days=cell_days)
