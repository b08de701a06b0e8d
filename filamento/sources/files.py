"""File sources: typed CSV, snapshots with the year in the name, JSON documents, keyed text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """A file lacks a required column."""


class MissingData(FileNotFoundError):
    """Required input files are absent: an empty result would hide that."""


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under an explicit schema; code columns are declared STRING and keep zeros."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_snapshots(spark: SparkSession, pattern: str, schema: str, required: list[str], require: bool = True) -> DataFrame:
    """All CSV files of a pattern with ``year`` from each file's name; rows with a null in a required
    column drop. Without files: MissingData if ``require``, else an empty frame with the schema."""
    known = [c.split()[0] for c in schema.split(",")]
    if missing := [c for c in required if c not in known]:
        raise MissingColumns(str(missing))
    try:
        df = read_csv(spark, pattern, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if require:
            raise MissingData(pattern) from e
        return spark.createDataFrame([], schema).withColumn("year", F.lit(None).cast("int"))
    return df.withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).try_cast("int")).dropna(subset=required)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, fields by schema; a malformed document has nulls."""
    return spark.read.schema(schema).json(path, multiLine=True)


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files without a byte, which Spark's scans leave out. Like those scans, the driver lists the folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in fs.globStatus(where) or []]
    held = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return [f.getPath().getName() for f in held if f.isFile() and f.getLen() == 0]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of UTF-8 files, one row per file; an empty file has an empty text. Hidden files are no files."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    empty = [n for n in _empty_files(spark, path) if n[0] not in "._"]
    return files.unionByName(spark.createDataFrame([(n, "") for n in empty], "name string, text string")) if empty else files


def read_keyed_texts(spark: SparkSession, path: str) -> DataFrame:
    """(corp, fy, section, text) of files ``{corp}_{fy}_{S#}.txt``; other names are skipped."""
    part = lambda i: F.regexp_extract("name", r"^(\d+)_(\d{4})_(S\d)\.txt$", i)
    return read_texts(spark, path).where(part(0) != "").select(part(1).alias("corp"), part(2).cast("int").alias("fy"), part(3).alias("section"), "text")
