"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import overlap as O
from skein.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = O.overlaps(table(spark, sf_dir, "task_rows"))
    return pair.select(F.least("train_row_id", "held_row_id").alias("task_row_id_a"), F.greatest("train_row_id", "held_row_id").alias("task_row_id_b"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overlap_report(table(spark, sf_dir, "task_rows"))


QUERIES = {f.__name__: f for f in (p6_found, p6_report)}
ORACLE: dict[str, str] = {}
