"""Session-level helpers: table reads, shared-folder materialisation and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 64


#: Rows of an Arrow batch: texts are long, and a batch lives several times over on both sides.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Where the session leaves Arrow batches at Spark's default of 10,000 rows,
    they are lowered to BATCH_ROWS; a value of the session's own stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none gets one of its own: on a
    cluster such a folder would be on one machine, so its absence is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="filamento-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Paths of the tables this process has written and not dropped.
_written: list[str] = []


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/filamento/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables ``materialize`` has written in this process; results that still read them are gone.
    The number of tables dropped. For long sessions, between jobs."""
    dropped = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by keys into all shuffle partitions, before a step that multiplies rows: adaptive
    execution would otherwise gather a small input of a large computation in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n): rows per key without nulls, combined map-side before their shuffle."""
    return df.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys holding at least 1/share of all rows counted in ``counts``: never more than ``share`` of them."""
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.where(F.col("_n") * share >= total).select(*keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 24, share: int = HOT_SHARE, counts: DataFrame | None = None) -> DataFrame:
    """Equi join in which the hot keys of ``big`` are split over ``salts`` tasks.

    Only hot keys (at most ``share``, so their table is broadcast with a proven bound) are salted:
    rows of ``big`` take one of ``salts`` values, rows of ``small`` are repeated once per value.
    ``counts`` are key_counts of ``big`` where the caller has them already; else they are taken in a
    pass over its key columns, so a ``big`` that is dear to compute should be a written table.
    ``how`` is inner, left, left_semi or left_anti, with ``big`` on the left. Row counts do not change.
    """
    hot = F.broadcast(hot_keys(key_counts(big, keys) if counts is None else counts, keys, share).withColumn("_hot", F.lit(True)))
    left = big.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in keys] or [F.rand(7)]), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
