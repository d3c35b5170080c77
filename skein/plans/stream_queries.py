"""Streams drained over the supplied tables, whose results batch SQL gives as well."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import shared_folder
from skein.streaming import incremental as I


def _out(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"


def in05_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = I.arriving(spark, f"{sf_dir}/rollout_rows.parquet").where("task_id IS NOT NULL").select("task_id", "attempt_index")
    return I.first_per_key(stream, ["task_id", "attempt_index"], _out(spark))


def in01_resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = I.arriving(spark, f"{sf_dir}/task_rows.parquet").where("task_id IS NOT NULL").select("task_id")
    return I.resumed_append(stream, "task_id", _out(spark))


def in04_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = I.arriving(spark, f"{sf_dir}/turn_messages.parquet").select("task_id", "collected_at")
    counts = I.window_counts(stream, "collected_at", "1 hour", ["task_id"], _out(spark))
    return counts.select(F.unix_timestamp("start").alias("start_s"), "task_id", "n")


QUERIES = {f.__name__: f for f in (in05_first_per_key, in01_resumed_append, in04_window_counts)}
ORACLE = {
    "in05_first_per_key": "SELECT DISTINCT task_id, attempt_index FROM rollout_rows WHERE task_id IS NOT NULL",
    "in01_resumed_append": "SELECT DISTINCT task_id FROM task_rows WHERE task_id IS NOT NULL",
    "in04_window_counts": "SELECT CAST(epoch(date_trunc('hour', collected_at)) AS BIGINT) AS start_s, task_id, COUNT(*) AS n FROM turn_messages GROUP BY 1, 2",
}
