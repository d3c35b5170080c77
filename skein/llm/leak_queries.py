"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import leaks as L
from skein.session import cut, table


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_leaks(table(spark, sf_dir, "documents"), cut(_found(spark, sf_dir))).select("doc_id", "source", "n_chars")


QUERIES = {f.__name__: f for f in (p7_found, p7_matches, p7_clean)}
ORACLE: dict[str, str] = {}
