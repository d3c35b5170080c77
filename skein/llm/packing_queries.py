"""Queries of problem 2. Many placements are right, so none has SQL but the attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import packing as P
from skein.session import cut, table


def p2_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pack(P.usable_attempts(table(spark, sf_dir, "token_cache")), table(spark, sf_dir, "loop_configs"))


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fill_report(p2_containers(spark, sf_dir), table(spark, sf_dir, "loop_configs"))


def p2_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.usable_attempts(table(spark, sf_dir, "token_cache"))


def p2_kept_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per config what any right placement keeps: attempts and tokens placed, split attempts and pieces; what none has; and whether little room is left."""
    configs = table(spark, sf_dir, "loop_configs")
    packed = cut(p2_containers(spark, sf_dir))
    attempt = packed.groupBy("config_name", "cache_row_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("length"), F.count_distinct("start").alias("starts"))
    whole = attempt.join(configs, "config_name").groupBy("config_name").agg(
        F.count("*").alias("attempts"),
        F.sum("length").cast("bigint").alias("tokens"),
        F.count_if(F.col("pieces") > 1).alias("split_attempts"),
        F.count_if((F.col("pieces") > 1) & (F.col("length") <= F.col("capacity_tokens"))).alias("split_too_early"),
        F.count_if(F.col("starts") < F.col("pieces")).alias("placed_twice"),
    )
    box = packed.groupBy("config_name", "batch_index", "container_index").agg(F.sum("length").alias("load")).join(configs, "config_name")
    boxes = box.groupBy("config_name", "batch_index").agg(F.count("*").alias("n"), F.max("load").alias("load"), F.sum("load").alias("filled"), F.first("capacity_tokens").alias("capacity"), F.first("train_batch_size").alias("size"))
    rules = boxes.groupBy("config_name").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), F.count_if(F.col("n") > F.col("size")).alias("large_batches"), (F.sum("filled") >= 0.98 * F.sum(F.col("n") * F.col("capacity"))).alias("filled"))
    return whole.join(rules, "config_name")


QUERIES = {f.__name__: f for f in (p2_containers, p2_fill, p2_attempts, p2_kept_rules)}
_ATTEMPTS = """SELECT cache_row_id, CAST(original_length AS BIGINT) AS length FROM token_cache WHERE original_length > 0
QUALIFY row_number() OVER (PARTITION BY task_id, attempt_index, CASE WHEN task_id IS NULL OR attempt_index IS NULL THEN cache_row_id END
  ORDER BY cache_schema_version DESC NULLS LAST, created_at DESC NULLS LAST, cache_row_id DESC) = 1"""
ORACLE = {
    "p2_attempts": _ATTEMPTS,
    "p2_kept_rules": f"""WITH a AS ({_ATTEMPTS})
SELECT config_name, count(*) AS attempts, sum(length)::BIGINT AS tokens, count(*) FILTER (length > capacity_tokens) AS split_attempts, 0::BIGINT AS split_too_early, 0::BIGINT AS placed_twice, 0::BIGINT AS overfull, 0::BIGINT AS large_batches, true AS filled
FROM loop_configs CROSS JOIN a GROUP BY config_name""",
}
