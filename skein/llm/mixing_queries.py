"""Queries of problem 8. Sizes are tokens of a public tokenizer, which SQL can't count."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing as M
from skein.session import cut, table

VOCABULARY = os.environ.get("SKEIN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), VOCABULARY)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.share_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def p8_kept_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target with documents: its share reached within a hundredth, no record used too often, no slot given to two blocks."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed = cut(p8_mixture(spark, sf_dir))
    twice = mixed.select("source", "block", "slot").distinct().groupBy("slot").agg(F.count("*").alias("n"), F.first("source").alias("source")).groupBy("source").agg(F.max("n").alias("n"))
    report = M.share_report(mixed, targets).where("records > 0").join(twice, "source", "left")
    return report.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01).alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("uses_kept"), (F.coalesce("n", F.lit(1)) == 1).alias("slots_single"))


QUERIES = {f.__name__: f for f in (p8_mixture, p8_shares, p8_token_counts, p8_kept_rules)}
ORACLE = {
    "p8_kept_rules": """SELECT source, true AS share_met, true AS uses_kept, true AS slots_single FROM mix_targets
WHERE source IN (SELECT lower(trim(source, e' \\t\\n\\r\\x0b\\f')) FROM documents WHERE length(text) > 0) AND target_share > 0 AND max_repeats > 0""",
}
