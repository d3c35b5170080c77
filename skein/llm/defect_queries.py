"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import defects as D
from skein.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.defects(table(spark, sf_dir, "rollout_rows"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage and defect the rows that have it."""
    rows = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", "stage")
    return rows.join(p3_found(spark, sf_dir), "rollout_row_id").groupBy("stage", "defect").agg(F.count("*").alias("n_rows"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts)}
ORACLE: dict[str, str] = {}
