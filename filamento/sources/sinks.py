"""Sinks: partitioned Parquet, CSV, upserts, idempotent re-runs and fingerprinted caches."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.plans.runtime import materialize


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, UTF-8 without a byte-order mark; blanks around values are kept."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


_WRITTEN = T.StructType([T.StructField("name", T.StringType()), T.StructField("n_bytes", T.LongType())])


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file per row in a shared folder, its name and content (text or bytes) from two columns.

    Tasks write beside the target and move the file there, so a task that runs again replaces its own
    work and no reader sees a part of a file. Null names or contents and names with a slash are
    refused. (name, n_bytes) of what was written, as a table that is written itself.
    """
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for n, c in zip(names, b.column(1).to_pylist()):
                if not n or c is None or "/" in n:
                    raise ValueError(f"no file can be written for {n!r}")
                data = c.encode() if isinstance(c, str) else c
                part = f"{root}/.{n}-{uuid.uuid4().hex}"
                with target.open_output_stream(part) as out:
                    out.write(data)
                target.move(part, f"{root}/{n}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], _WRITTEN.names)

    return materialize(df.select(name, content).mapInArrow(run, _WRITTEN), "files-written")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Both tables with one row per key: the new one's (``keep`` last) or the old one's (first).

    Within a side, of equal keys the greatest row counts. Null is a key value. The result can be
    written over a copy of ``old``; there is no in-place merge. A grouped maximum, combined map-side.
    """
    rest = [c for c in old.columns if c not in keys]
    side = lambda df, n: df.select(*keys, F.struct(F.lit(n).alias("_side"), *rest).alias("_row"))
    first, second = (0, 1) if keep == "last" else (1, 0)
    both = side(old, first).unionByName(side(new, second))
    return both.groupBy(*keys).agg(F.max("_row").alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without an output yet: a second run does nothing."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint(*modules: ModuleType) -> str:
    """Digest of the source of the modules an output depends on."""
    return hashlib.sha256("\n".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def cached(spark: SparkSession, path: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was written under the same fingerprint, else made anew and written."""
    try:
        have = spark.read.parquet(path)
        if have.columns and "_fingerprint" in have.columns and have.select("_fingerprint").distinct().limit(2).collect() == [(mark,)]:
            return have.drop("_fingerprint")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().withColumn("_fingerprint", F.lit(mark)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_fingerprint")


def split_failures(df: DataFrame, error: str, stage: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, failure log (stage, key, reason, detail of 500 characters))."""
    good = df.where(F.col(error).isNull()).drop(error)
    bad = df.where(F.col(error).isNotNull()).select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), F.split_part(F.col(error), F.lit(":"), F.lit(1)).alias("reason"), F.substring(error, 1, 500).alias("detail"))
    return good, bad
