"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import truncation as T
from skein.llm.mixing_queries import VOCABULARY
from skein.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.truncated(table(spark, sf_dir, "documents"), VOCABULARY).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rates(table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES = {f.__name__: f for f in (p9_found, p9_rates)}
ORACLE: dict[str, str] = {}
