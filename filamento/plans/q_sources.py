"""Source and sink queries (S and K rows of the survey): files are written to the shared folder and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions import text as X
from filamento.functions.codes import corp_code
from filamento.functions.udf import arrow
from filamento.operators import html as H
from filamento.plans.base import Book
from filamento.plans.runtime import shared_dir, table
from filamento.sources import archive as A
from filamento.sources import files as FS
from filamento.sources import sinks as K
from filamento.sources.archive import decode

book = Book()
q = book.query
_CORP = "lpad(regexp_replace(corp_code, '[^0-9]', '', 'g'), 8, '0')"


def _path(spark, name):
    return f"{shared_dir(spark)}/filamento/{name}-{uuid.uuid4().hex}"


def _sections(spark, d):
    return table(spark, d, "section_contents").where("text is not null").select("section_key", "name", "text").distinct()


@q("s01_body_of_archive", "SELECT DISTINCT CAST(section_key AS VARCHAR) AS rcept_no, 'body.html' AS member, length(text) AS n, CAST(NULL AS VARCHAR) AS error FROM section_contents WHERE text IS NOT NULL")
def s01(spark, d):
    """Archive files with an attachment and a body: the body is chosen and read whole."""
    path = _path(spark, "archives")
    body = F.struct(F.lit("body.html").alias("name"), F.to_binary(F.concat(F.lit("사업의 내용"), F.col("text")), F.lit("utf-8")).alias("content"))
    extra = F.struct(F.lit("첨부_감사보고서.html").alias("name"), F.to_binary(F.repeat(F.lit("x"), 5000), F.lit("utf-8")).alias("content"))
    K.write_files(_sections(spark, d).select(F.concat("section_key", F.lit(".zip")).alias("name"), A.zipped(F.array(extra, body)).alias("z")), path, "name", "z")
    return A.read_bodies(spark, path).select("rcept_no", "member", (F.length("text") - 6).cast("bigint").alias("n"), "error")


@arrow(T.StringType())
def around(texts: pa.Array) -> pa.Array:
    head = '<?xml version="1.0" encoding="utf-8"?>'
    return pa.array([decode((head + t).encode("cp949", "replace"))[len(head) :] for t in texts.to_pylist()], pa.string())


@q("s02_decoded_bytes")
def s02(spark, d):
    """Texts written in cp949 under a wrong declaration come back whole where cp949 has their characters."""
    s = _sections(spark, d)
    return s.select("section_key", (around("text") == F.col("text")).alias("same"))


@q("s03_firm_codes", "SELECT DISTINCT lpad(regexp_replace(corp_code,'[^0-9]','','g'),8,'0') AS corp_code, regexp_matches(coalesce(stock_code, ''), '^\\d{6}$') AS is_listed FROM filings_index WHERE corp_code IS NOT NULL")
def s03(spark, d):
    firms = table(spark, d, "filings_index").where("corp_code is not null").select(corp_code(F.col("corp_code")).alias("c"), F.coalesce("stock_code", F.lit("")).alias("s")).distinct()
    xml = F.concat(F.lit("<result><list><corp_code>"), F.col("c"), F.lit("</corp_code><corp_name>n</corp_name><stock_code>"), F.col("s"), F.lit("</stock_code></list></result>"))
    z = firms.select(A.zipped(F.array(F.struct(F.lit("CORPCODE.xml").alias("name"), F.to_binary(xml, F.lit("utf-8")).alias("content")))).alias("z"))
    return A.firm_codes(z, "z").select("corp_code", "is_listed").distinct()


@q("s04_parquet_scan", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS qty, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL")
def s04(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1998-01-01 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("qty"), F.count(F.lit(1)).alias("n"))


@q("s05_csv_scan", "SELECT DISTINCT corp_code, stock_code, fy, rcept_no FROM filings_index")
def s05(spark, d):
    path = _path(spark, "csv")
    K.write_csv(table(spark, d, "filings_index").select("corp_code", "stock_code", "fy", "rcept_no"), path)
    return FS.read_csv(spark, path, "corp_code string, stock_code string, fy int, rcept_no string").distinct()


@q("s06_snapshot_files", "SELECT DISTINCT market, fy AS year FROM universe WHERE market IS NOT NULL AND fy IS NOT NULL")
def s06(spark, d):
    """Files ``groups_{year}.csv`` of the markets of each year, the year read from the name."""
    path = _path(spark, "snapshots")
    years = table(spark, d, "universe").where("market is not null and fy is not null").groupBy("fy").agg(F.concat(F.lit("market\n"), F.array_join(F.array_sort(F.collect_set("market")), "\n"), F.lit("\n")).alias("csv"))
    K.write_files(years.select(F.concat(F.lit("groups_"), "fy", F.lit(".csv")).alias("name"), "csv"), path, "name", "csv")
    return FS.read_snapshots(spark, f"{path}/groups_*.csv", "market string", ["market"])


@q("s07_json_documents", "SELECT DISTINCT section_key, name, len(paragraphs) AS n FROM section_contents WHERE paragraphs IS NOT NULL AND name IS NOT NULL")
def s07(spark, d):
    path = _path(spark, "json")
    rows = table(spark, d, "section_contents").where("paragraphs is not null and name is not null").select("section_key", "name", "paragraphs").distinct()
    K.write_files(rows.select(F.concat("section_key", F.lit(".json")).alias("file"), F.to_json(F.struct("section_key", "name", "paragraphs"), {"ignoreNullFields": "false"}).alias("json")), path, "file", "json")
    back = FS.read_json_documents(spark, path, "section_key bigint, name string, paragraphs array<string>")
    return back.select("section_key", "name", F.size("paragraphs").cast("bigint").alias("n"))


@q("s08_keyed_texts", f"SELECT {_CORP} AS corp, fy, upper(section_id) AS section, length(max(text)) AS n FROM section_contents WHERE corp_code IS NOT NULL AND fy IS NOT NULL AND text IS NOT NULL AND section_id IS NOT NULL GROUP BY ALL")
def s08(spark, d):
    """Text files named ``{corp}_{fy}_{S#}.txt``, the names read back; of equal names the greatest text."""
    path = _path(spark, "texts")
    s = table(spark, d, "section_contents").where("corp_code is not null and fy is not null and text is not null and section_id is not null")
    named = s.groupBy(F.concat_ws("_", corp_code(F.col("corp_code")), F.col("fy").cast("string"), F.concat(F.upper("section_id"), F.lit(".txt"))).alias("name")).agg(F.max("text").alias("text"))
    K.write_files(named, path, "name", "text")
    return FS.read_keyed_texts(spark, path).select("corp", "fy", "section", F.length("text").cast("bigint").alias("n"))


@q("k04_document_files", "SELECT DISTINCT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def k04_files(spark, d):
    """One file per document, written by the tasks that hold it."""
    path = _path(spark, "documents")
    docs = table(spark, d, "documents").where("text is not null").select(F.concat("doc_id", F.lit(".txt")).alias("name"), "text")
    K.write_files(docs, path, "name", "text")
    return FS.read_texts(spark, path).select(F.regexp_extract("name", r"^(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("n"))


@q("k01_partitioned_parquet", "SELECT fy, count(*) AS n FROM filings_index WHERE fy IS NOT NULL GROUP BY 1")
def k01(spark, d):
    path = _path(spark, "parquet")
    K.write_parquet(table(spark, d, "filings_index").where("fy is not null"), path, ["fy"])
    return spark.read.parquet(path).groupBy("fy").agg(F.count(F.lit(1)).alias("n"))


@q("k03_upsert", "SELECT section_key, max(CASE WHEN section_key % 3 = 0 THEN -1 ELSE n END) AS n FROM paragraph_stats WHERE section_key IS NOT NULL GROUP BY 1")
def k03(spark, d):
    old = table(spark, d, "paragraph_stats").where("section_key is not null").select("section_key", "n").groupBy("section_key").agg(F.max("n").alias("n"))
    new = old.where("section_key % 3 = 0").withColumn("n", F.lit(-1))
    return K.upsert(old, new, ["section_key"])


@q("k04_documents_by_year", "SELECT fy, section_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE fy IS NOT NULL GROUP BY ALL")
def k04(spark, d):
    path = _path(spark, "corpus")
    K.write_parquet(table(spark, d, "documents").where("fy is not null").select("fy", "section_id", "text"), path, ["fy"])
    return spark.read.parquet(path).groupBy("fy", "section_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@q("k08_remaining_tasks", "SELECT DISTINCT rcept_no FROM filings_index WHERE rcept_no NOT IN (SELECT rcept_no FROM section_contents WHERE rcept_no IS NOT NULL)")
def k08(spark, d):
    return K.remaining(table(spark, d, "filings_index").select("rcept_no").distinct(), table(spark, d, "section_contents"), ["rcept_no"])


@q("k09_fingerprinted_cache", "SELECT sid, count(*) AS n FROM (SELECT DISTINCT section_key, upper(section_id) AS sid FROM section_contents) GROUP BY 1")
def k09(spark, d):
    path, mark = _path(spark, "cache"), K.fingerprint(X, H)
    make = lambda: table(spark, d, "section_contents").select("section_key", F.upper("section_id").alias("sid")).distinct()
    K.cached(spark, path, mark, make)
    return K.cached(spark, path, mark, make).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@q("a19_failure_log")
def failures(spark, d):
    """Archives of which every seventh is broken: the reasons counted, no row lost."""
    z = _sections(spark, d).select("section_key", F.when(F.col("section_key") % 7 == 0, F.to_binary(F.lit("no zip"), F.lit("utf-8"))).otherwise(A.zipped(F.array(F.struct(F.lit("a.html").alias("name"), F.to_binary("text", F.lit("utf-8")).alias("content"))))).alias("z"))
    _, bad = K.split_failures(z.select("section_key", A.body_of("z").alias("b")).select("section_key", "b.text", "b.error"), "error", "body", "section_key")
    return bad.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


queries, oracle_sql = book.queries, book.oracle_sql
