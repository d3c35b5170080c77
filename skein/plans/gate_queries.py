"""Queries over gates and summaries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import gates as G
from skein.session import table


def fl04_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "token_cache").select("cache_row_id", "original_length")
    return G.length_filter(k, F.col("original_length").cast("bigint"), 2048).select("cache_row_id", "n_tokens")


def fl08_integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "token_cache")
    return G.integrity_gate(k, F.col("original_length") > F.col("sequence_length"), F.col("original_length") == F.col("sequence_length"), F.col("loss_token_count") > F.col("original_length"), 0.05)


def fl13_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(0.0))).alias("rewards"))
    return G.relabelled(o, "rewards", 2.0).select("o_custkey", "resolved")


def ag07_step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.step_summary(table(spark, sf_dir, "rollout_rows"), "step_index")


def pj29_patch_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.struct("ts", "event_id", F.when(F.col("event_type") == "purchase", "apply_patch").otherwise("read").alias("tool"), F.col("event_id").cast("string").alias("patch"), (F.col("event_id") % 3).cast("int").alias("exit_code"))
    steps = e.groupBy("user_id").agg(F.sort_array(F.collect_list(step)).alias("s"))
    return steps.select("user_id", G.patch_memory(F.col("s"), 40).alias("memory"))


def jn11_merged_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", "task_id", F.col("task_family").alias("own"))
    t = table(spark, sf_dir, "task_rows").where("task_id IS NOT NULL").groupBy("task_id").agg(F.min("task_family").alias("truth"))
    return r.join(t, "task_id", "left").select("rollout_row_id", G.merged_truth(F.col("own"), F.col("truth")).alias("family"))


def sl11_chosen_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "turn_messages").where("task_id IS NOT NULL AND attempt_index IS NOT NULL AND turn_index IS NOT NULL")
    turns = m.groupBy("task_id", "attempt_index", "turn_index").agg(F.count("tool_output").alias("answers"))
    return G.chosen_turn(turns, ["task_id", "attempt_index"], "turn_index", F.col("answers") > 0, 7)


QUERIES = {f.__name__: f for f in (fl04_length_filter, fl08_integrity_gate, fl13_relabelled, ag07_step_summary, pj29_patch_memory, jn11_merged_truth, sl11_chosen_turn)}
ORACLE = {
    "fl04_length_filter": "SELECT cache_row_id, CAST(original_length AS BIGINT) AS n_tokens FROM token_cache WHERE original_length <= 2048",
    "fl08_integrity_gate": """WITH g AS (SELECT count(*) AS n, avg(CAST(coalesce(original_length > sequence_length, false) AS DOUBLE)) AS truncation_rate, count(*) FILTER (NOT coalesce(original_length = sequence_length, false)) AS unequal,
  count(*) FILTER (coalesce(loss_token_count > original_length, false)) AS leaking FROM token_cache) SELECT *, truncation_rate <= 0.05 AND unequal = 0 AND leaking = 0 AS passed FROM g""",
    "fl13_relabelled": "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) >= 2.0 AS resolved FROM orders GROUP BY 1",
    "ag07_step_summary": """WITH f AS (SELECT step_index, task_family, count(*) AS k FROM rollout_rows GROUP BY ALL), t AS (SELECT step_index, task_family AS top_family FROM f QUALIFY row_number() OVER (PARTITION BY step_index ORDER BY k DESC, coalesce(task_family, chr(65535))) = 1)
SELECT p.step_index, n, tasks, resolved, latency, top_family FROM (SELECT step_index, count(*) AS n, count(DISTINCT task_id) AS tasks, count(*) FILTER (coalesce(resolved, false)) AS resolved, avg(latency_ms) AS latency FROM rollout_rows GROUP BY 1) p JOIN t USING (step_index)""",
    "pj29_patch_memory": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS j FROM n WHERE i <= 40 AND event_type = 'purchase' AND event_id % 3 = 0)
SELECT u.user_id, coalesce(string_agg(j || '. ' || event_id, chr(10) ORDER BY j), '') AS memory FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k ON k.user_id = u.user_id GROUP BY 1""",
    "sl11_chosen_turn": """WITH t AS (SELECT task_id, attempt_index, turn_index, count(tool_output) > 0 AS ok, count(*) OVER (PARTITION BY task_id, attempt_index) AS n, row_number() OVER (PARTITION BY task_id, attempt_index ORDER BY turn_index) - 1 AS k
  FROM turn_messages WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL AND turn_index IS NOT NULL GROUP BY task_id, attempt_index, turn_index)
SELECT task_id, attempt_index, coalesce(arg_min(turn_index, sha256(concat_ws('|', '7', task_id, attempt_index, turn_index))) FILTER (ok), max(turn_index) FILTER (k = (n - 1) // 2)) AS turn_index FROM t GROUP BY ALL""",
    "jn11_merged_truth": "SELECT rollout_row_id, coalesce(task_family, truth) AS family FROM rollout_rows LEFT JOIN (SELECT task_id, min(task_family) AS truth FROM task_rows WHERE task_id IS NOT NULL GROUP BY 1) USING (task_id)",
}
