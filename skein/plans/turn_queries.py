"""Queries over turns and tokens, each beside its SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import tokens as K
from skein.operators import pool as P
from skein.operators import turns as T
from skein.session import table

TOKENIZER = os.environ.get("SKEIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

_FRAMES = """turns AS (SELECT task_id, attempt_index, turn_index, arg_min(assistant_response, CASE WHEN assistant_response IS NOT NULL THEN message_id END) AS assistant,
  arg_min(tool_output, CASE WHEN tool_output IS NOT NULL THEN message_id END) AS tool FROM turn_messages WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL AND turn_index IS NOT NULL GROUP BY ALL),
frames AS (SELECT *, coalesce(regexp_matches(assistant, '\\S'), false) AND coalesce(regexp_matches(tool, '\\S'), false) AS active,
  coalesce(array_to_string(list_filter(list(coalesce(assistant, '')) OVER (PARTITION BY task_id, attempt_index ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: regexp_matches(x, '\\S')), chr(10) || chr(10)), '') AS recent FROM turns)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.turn_frames(table(spark, sf_dir, "turn_messages"))


def pj24_turn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("task_id", "attempt_index", "turn_index", "active", F.md5("recent").alias("recent_md5"))


def pj39_active_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.active_turns(_frames(spark, sf_dir)).select("task_id", "attempt_index", "turn_index", F.col("place").cast("bigint").alias("place"))


def ag20_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows").groupBy("task_id", "attempt_index").agg(F.bool_or("resolved").alias("resolved"))
    return T.batch_metrics(_frames(spark, sf_dir), r)


def fl06_probe_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows")
    status = F.col("verifier_status")
    kind = T.probe_class(F.when(status.isNotNull(), status != "invalid"), F.col("exit_code"), F.col("task_id").contains("__"), F.col("container_id").isNotNull())
    return r.select("rollout_row_id", kind.alias("class"))


def ag16_group_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.group_results(table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL"), ["task_id"], "resolved")


def ag10_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.create_map(F.col("event_type"), F.coalesce("value", F.lit(0.0))).alias("m"))
    return T.metric_means(e, "m")


def wn05_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return r.select("rollout_row_id", T.global_row_number(zero("step_index"), 512, 4, F.col("rollout_row_id") % 512, zero("attempt_index")).alias("number"))


def pj33_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "turn_messages").where("assistant_response IS NOT NULL")
    return m.select("message_id", K.token_records(F.col("assistant_response"), TOKENIZER, 512).alias("t")).select("message_id", "t.*")


def sl09_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_slice(table(spark, sf_dir, "task_rows").select("task_row_id", "task_id"), ["task_row_id"], 40, 90)


def st05_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_custkey")
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    marked = a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.distinct().exceptAll(b.distinct()).withColumn("kind", F.lit("only")))
    return marked.select(F.col("o_custkey").alias("custkey"), "kind")


QUERIES = {f.__name__: f for f in (pj24_turn_frames, pj39_active_turns, ag20_batch_metrics, fl06_probe_classes, ag16_group_results, ag10_metric_means, wn05_row_numbers, pj33_token_records, sl09_slice, st05_set_operations)}
ORACLE = {
    "pj24_turn_frames": f"WITH {_FRAMES} SELECT task_id, attempt_index, turn_index, active, md5(recent) AS recent_md5 FROM frames",
    "pj39_active_turns": f"WITH {_FRAMES} SELECT task_id, attempt_index, turn_index, row_number() OVER (PARTITION BY task_id, attempt_index ORDER BY turn_index) - 1 AS place FROM frames WHERE active",
    "ag20_batch_metrics": f"""WITH {_FRAMES}, per AS (SELECT task_id, attempt_index, count(*) FILTER (active) AS active, count(*) FILTER (coalesce(tool, '') <> '') AS answered FROM frames GROUP BY ALL),
r AS (SELECT task_id, attempt_index, bool_or(resolved) AS resolved FROM rollout_rows GROUP BY ALL)
SELECT count(*) AS attempts, avg(CAST(coalesce(resolved, false) AS DOUBLE)) AS resolved_share, avg(CAST(active > 0 AS DOUBLE)) AS active_share, avg(CAST(answered > 0 AS DOUBLE)) AS answered_share, avg(CAST(active AS DOUBLE)) AS active_per_attempt
FROM per LEFT JOIN r USING (task_id, attempt_index)""",
    "fl06_probe_classes": """SELECT rollout_row_id, CASE WHEN verifier_status IS NULL THEN 'unknown:not_probed' WHEN verifier_status = 'invalid' THEN 'bad:image_failed' WHEN container_id IS NULL THEN 'bad:runner_missing'
  WHEN NOT contains(task_id, '__') THEN 'bad:selector_invalid' WHEN coalesce(exit_code, 0) <> 0 THEN 'bad:nonzero_exit' ELSE 'ok:' END AS class FROM rollout_rows""",
    "ag16_group_results": "SELECT task_id, bool_and(coalesce(resolved, false)) AS all_passed, count(*) AS tests FROM rollout_rows WHERE task_id IS NOT NULL GROUP BY 1",
    "ag10_metric_means": "SELECT event_type AS name, sum(coalesce(value, 0.0)) / (SELECT count(*) FROM events) AS mean FROM events GROUP BY 1",
    "wn05_row_numbers": "SELECT rollout_row_id, CAST(coalesce(step_index, 0) AS BIGINT) * 2048 + rollout_row_id % 512 * 4 + coalesce(attempt_index, 0) AS number FROM rollout_rows",
    "sl09_slice": "SELECT task_row_id, task_id FROM task_rows ORDER BY task_row_id LIMIT 50 OFFSET 40",
    "st05_set_operations": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 150000), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey AS custkey, 'both' AS kind FROM a WHERE o_custkey IN (SELECT o_custkey FROM b) UNION ALL SELECT o_custkey, 'only' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)""",
}
