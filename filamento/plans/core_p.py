"""Queries of the core training-data problems (2 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamento.functions.codes import corp_code, stock_code
from filamento.functions.unicode import canonical
from filamento.operators.bitemporal import located, rectangles
from filamento.operators.snapshots import snapshot_changes
from filamento.plans.runtime import table


_STATE = ("is_delisted_later", "delist_date")


def _rectangles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Price events, rectangles of the universe's versions, and the attributes of each version."""
    versions = table(spark, d, "universe").withColumn("stock_code", stock_code(F.col("stock_code")))
    events = table(spark, d, "panel").withColumn("stock_code", stock_code(F.col("stock_code")))
    attributes = versions.groupBy(F.col("universe_id").alias("version")).agg(F.max(F.struct("snapshot_date", *_STATE, "rank_mcap")).alias("now"))
    return events, rectangles(versions, "stock_code", "snapshot_date", "known_at", "universe_id"), attributes


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, universe_id): events whose known version differs from the final one of the stock.

    Rectangles are compared with the final version first; events are located in those that differ."""
    events, rects, attributes = _rectangles(spark, d)
    final = attributes.select(F.col("version").alias("latest"), F.col("now").alias("last"))
    same = [F.col(f"now.{c}").eqNullSafe(F.col(f"last.{c}")) for c in _STATE]
    differing = rects.join(attributes, "version").join(final, "latest").where(~(same[0] & same[1])).select(*rects.columns)
    return located(events, differing, entity="stock_code", event_id="event_id", valid_at="date").select("event_id", F.col("version").alias("universe_id"))


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every price event with the universe attributes known when it happened (null before any)."""
    events, rects, attributes = _rectangles(spark, d)
    known = located(events, rects.join(attributes, "version"), entity="stock_code", event_id="event_id", valid_at="date")
    priced = events.groupBy("event_id", "stock_code", "date").agg(F.max("px").alias("px"))
    day = lambda c: F.col(c).cast("string").alias(c.rpartition(".")[2])
    return priced.join(known, "event_id", "left").select("event_id", "stock_code", day("date"), "px", F.col("version").alias("universe_id"), day("now.snapshot_date"), "now.is_delisted_later", day("now.delist_date"), "now.rank_mcap")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "para_snapshots").select(corp_code(F.col("corp_code")).alias("corp_code"), F.upper(F.trim("section_id")).alias("section_id"), F.col("fy").cast("bigint").alias("fy"), "para_key", canonical(F.col("paragraph")).alias("content"), "loaded_at")
    return snapshot_changes(rows, series=["corp_code", "section_id"], period="fy", key="para_key", content=F.col("content"), loaded_at="loaded_at")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_attributes": p2_attributes, "p3_found": p3_found}


_VALID = """
WITH v AS (SELECT lpad(regexp_replace(stock_code,'[^0-9]','','g'),6,'0') AS s, * FROM universe WHERE stock_code IS NOT NULL),
e AS (SELECT DISTINCT event_id, lpad(regexp_replace(stock_code,'[^0-9]','','g'),6,'0') AS s, CAST(date AS DATE) AS d FROM panel WHERE stock_code IS NOT NULL),
k AS (SELECT e.event_id, v.universe_id, v.is_delisted_later AS f, v.delist_date AS dd, v.snapshot_date AS sd, v.rank_mcap, v.s,
 row_number() OVER (PARTITION BY e.event_id, e.d ORDER BY v.snapshot_date DESC, v.known_at DESC, v.universe_id DESC) AS rn
 FROM e JOIN v ON e.s=v.s AND v.snapshot_date<=e.d AND v.known_at < CAST(e.d AS TIMESTAMP)),
l AS (SELECT s, is_delisted_later AS f, delist_date AS dd, row_number() OVER (PARTITION BY s ORDER BY snapshot_date DESC, known_at DESC, universe_id DESC) AS rn FROM v)
"""


#: Full-width forms and the spaces NFKC makes plain: all the characters of the tables that it changes.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "
_CANONICAL = "trim(regexp_replace(regexp_replace(translate(COLUMN, '" + _WIDE + "', '" + _PLAIN.replace("'", "''") + "'), '[\\x{200b}-\\x{200f}\\x{2060}\\x{feff}\\x{ad}\\x{180e}]', '', 'g'), '\\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH r AS (SELECT lpad(regexp_replace(corp_code,'[^0-9]','','g'),8,'0') AS corp_code, upper(trim(section_id)) AS section_id, CAST(fy AS BIGINT) AS fy, para_key, {_CANONICAL.replace("COLUMN", "paragraph")} AS c, loaded_at FROM para_snapshots WHERE corp_code IS NOT NULL AND section_id IS NOT NULL AND fy IS NOT NULL),
s AS (SELECT corp_code, section_id, fy, para_key, c FROM r QUALIFY row_number() OVER (PARTITION BY corp_code, section_id, fy, para_key ORDER BY loaded_at DESC, c) = 1),
k AS (SELECT *, lead(fy) OVER w AS nxt, lag(fy) OVER w AS prv FROM (SELECT DISTINCT corp_code, section_id, fy FROM s) WINDOW w AS (PARTITION BY corp_code, section_id ORDER BY fy)),
b AS (SELECT s.corp_code, s.section_id, k.nxt AS fy, s.para_key, s.c FROM s JOIN k USING (corp_code, section_id, fy) WHERE k.nxt IS NOT NULL AND s.para_key IS NOT NULL),
a AS (SELECT s.* FROM s JOIN k USING (corp_code, section_id, fy) WHERE k.prv IS NOT NULL AND s.para_key IS NOT NULL)
SELECT coalesce(a.corp_code, b.corp_code) AS corp_code, coalesce(a.section_id, b.section_id) AS section_id, coalesce(a.fy, b.fy) AS fy, coalesce(a.para_key, b.para_key) AS para_key, CASE WHEN b.para_key IS NULL THEN 'added' WHEN a.para_key IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM b FULL JOIN a ON a.corp_code = b.corp_code AND a.section_id = b.section_id AND a.fy = b.fy AND a.para_key = b.para_key WHERE a.para_key IS NULL OR b.para_key IS NULL OR a.c IS DISTINCT FROM b.c""",
        "p2_found": _VALID + "SELECT DISTINCT k.event_id, k.universe_id FROM k JOIN l ON k.s=l.s AND l.rn=1 WHERE k.rn=1 AND (k.f IS DISTINCT FROM l.f OR k.dd IS DISTINCT FROM l.dd)",
        "p2_attributes": _VALID
        + """, p AS (SELECT event_id, lpad(regexp_replace(stock_code,'[^0-9]','','g'),6,'0') AS stock_code, date, max(px) AS px FROM panel GROUP BY ALL)
SELECT p.event_id, p.stock_code, CAST(CAST(p.date AS DATE) AS VARCHAR) AS date, p.px, k.universe_id, CAST(CAST(k.sd AS DATE) AS VARCHAR) AS snapshot_date, k.f AS is_delisted_later, CAST(CAST(k.dd AS DATE) AS VARCHAR) AS delist_date, k.rank_mcap FROM p LEFT JOIN (SELECT DISTINCT event_id, universe_id, sd, f, dd, rank_mcap FROM k WHERE rn=1) k USING (event_id)""",
    }
