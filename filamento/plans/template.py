"""Flagship query: paragraphs that several filers share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamento.plans.runtime import table


def template_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of 30 or more characters found under at least two sources, with their counts."""
    paras = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n+")).alias("p")).select("source", F.trim("p").alias("paragraph")).where("source is not null and length(paragraph) >= 30")
    return paras.groupBy("paragraph").agg(F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_rows")).where("n_sources >= 2")


def queries() -> dict:
    return {"template_paragraphs": template_paragraphs}


def oracle_sql() -> dict[str, str]:
    return {
        "template_paragraphs": """WITH p AS (SELECT source, trim(unnest(regexp_split_to_array(text, '\\n+')), ' ') AS paragraph FROM documents WHERE source IS NOT NULL)
SELECT paragraph, count(DISTINCT source) AS n_sources, count(*) AS n_rows FROM p WHERE length(paragraph) >= 30 GROUP BY 1 HAVING count(DISTINCT source) >= 2"""
    }
