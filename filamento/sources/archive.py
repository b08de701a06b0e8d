"""Filing archives: choosing the body member, decoding it, and the firm-code list (Arrow steps)."""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions.udf import arrow

# Body extensions, names of attachments, names that mark a body, encodings tried.
BODY_EXTENSIONS = (".html", ".htm", ".xml")
ATTACHMENT = re.compile(r"감사보고서|연결감사|attach|첨부", re.I)
BODY_MARKERS = ("사업의 내용", "회사의 개요", "재무에 관한 사항")
ENCODINGS = ("utf-8", "cp949", "euc-kr")
_DECLARED = re.compile(rb"encoding\s*=\s*[\"']([\w-]+)[\"']", re.I)


def decode(data: bytes) -> str:
    """Text in the first encoding that fits strictly: the declared one, then the usual ones (UTF-16
    only behind its mark); if none does, in the one with the fewest replacement characters."""
    declared = _DECLARED.search(data[:400])
    names = [declared[1].decode("ascii", "ignore").lower()] if declared else []
    names += [e for e in ENCODINGS if e not in names]
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        names.append("utf-16")
    rough: list[str] = []
    for name in names:
        try:
            return data.decode(name)
        except LookupError:
            continue
        except UnicodeDecodeError:
            rough.append(data.decode(name, "replace"))
    return min(rough, key=lambda t: t.count("�"), default=data.decode("utf-8", "replace"))


def body(data: bytes) -> tuple[str, str]:
    """(member, text) of an archive's body: members that are no attachment, the largest first; the
    first that holds a body marker, else the largest. ValueError if nothing qualifies."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = [m for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith(BODY_EXTENSIONS)]
        members = [m for m in members if not ATTACHMENT.search(m.filename)] or members
        if not members:
            raise ValueError("no HTML or XML member")
        members.sort(key=lambda m: -m.file_size)
        first = None
        for m in members:
            text = decode(z.read(m))
            first = first or (m.filename, text)
            if any(k in text for k in BODY_MARKERS):
                return m.filename, text
        return first


_BODY = T.StructType([T.StructField("member", T.StringType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@arrow(_BODY)
def body_of(archives: pa.Array) -> pa.Array:
    """(member, text, error) of each archive: a failure is a row with its reason, never an abort."""
    out = []
    for a in archives.to_pylist():
        try:
            member, text = body(a)
            out.append({"member": member, "text": text, "error": None})
        except (ValueError, zipfile.BadZipFile, TypeError) as e:
            out.append({"member": None, "text": None, "error": f"{type(e).__name__}: {e}"[:500]})
    return pa.array(out, pa.struct([("member", pa.string()), ("text", pa.string()), ("error", pa.string())]))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(rcept_no, member, text, error) of the archives ``{rcept_no}.zip`` under a path.

    Archives unpack to megabytes each, so Arrow batches should stay small
    (spark.sql.execution.arrow.maxRecordsPerBatch).
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("rcept_no"), body_of("content").alias("b")).select("rcept_no", "b.*")


_FIRM = T.StructType([T.StructField(n, T.StringType()) for n in ("corp_code", "corp_name", "stock_code", "modify_date")])


@arrow(T.ArrayType(_FIRM))
def _firms(archives: pa.Array) -> pa.Array:
    out = []
    for a in archives.to_pylist():
        with zipfile.ZipFile(io.BytesIO(a)) as z:
            root = ET.fromstring(z.read(z.namelist()[0]))
        out.append([{f.name: (x.findtext(f.name) or "").strip() for f in _FIRM} for x in root.iter("list")])
    return pa.array(out, pa.list_(pa.struct([(f.name, pa.string()) for f in _FIRM])))


def firm_codes(archives: DataFrame, content: str) -> DataFrame:
    """Rows of the firm-code list in an archive, with ``is_listed`` for six-digit stock codes."""
    return archives.where(F.col(content).isNotNull()).select(F.explode(_firms(content)).alias("f")).select("f.*").withColumn("is_listed", F.col("stock_code").rlike(r"^\d{6}$"))


@arrow(T.BinaryType())
def zipped(members: pa.Array) -> pa.Array:
    """Archives of (name, content) members; for fixtures and exports."""
    out = []
    for ms in members.to_pylist():
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for m in ms or []:
                z.writestr(m["name"], m["content"])
        out.append(buffer.getvalue())
    return pa.array(out, pa.binary())
