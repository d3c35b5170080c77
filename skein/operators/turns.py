"""Turns of recorded attempts: expanded, framed by what came before, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["task_id", "attempt_index"]


def turn_frames(df: DataFrame, earlier: int = 3) -> DataFrame:
    """One row per (task_id, attempt_index, turn_index): the assistant's text, the tool's, the texts of up to ``earlier`` turns before, and whether the turn is active.

    A turn is active if the assistant said something and a tool answered in the
    same turn. Repeated rows of a turn count once (the smallest message_id's).
    """
    said = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("message_id")))
    turns = df.where("task_id IS NOT NULL AND attempt_index IS NOT NULL AND turn_index IS NOT NULL").groupBy(*KEYS, "turn_index").agg(said("assistant_response").alias("assistant"), said("tool_output").alias("tool"))
    filled = lambda c: F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    by = Window.partitionBy(*KEYS).orderBy("turn_index").rowsBetween(-earlier, -1)
    recent = F.array_join(F.filter(F.collect_list(F.coalesce("assistant", F.lit(""))).over(by), lambda x: x.rlike(r"\S")), "\n\n")
    return turns.withColumns({"recent": recent, "active": filled("assistant") & filled("tool")})


def active_turns(frames: DataFrame) -> DataFrame:
    """The rows of active turns, numbered within their attempt from 0."""
    by = Window.partitionBy(*KEYS).orderBy("turn_index")
    return frames.where("active").withColumn("place", F.row_number().over(by) - 1)


def batch_metrics(frames: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: attempts, the shares that are resolved, have an active turn or a tool's answer, and active turns per attempt; 0 of nothing."""
    per = frames.groupBy(*KEYS).agg(F.count_if("active").alias("active"), F.count_if(F.coalesce("tool", F.lit("")) != "").alias("answered"))
    both = per.join(resolved.select(*KEYS, "resolved").dropDuplicates(KEYS), KEYS, "left")
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return both.agg(F.count("*").alias("attempts"), share(F.coalesce("resolved", F.lit(False))).alias("resolved_share"), share(F.col("active") > 0).alias("active_share"), share(F.col("answered") > 0).alias("answered_share"), share(F.col("active")).alias("active_per_attempt"))


def probe_class(ok: Column, exit_code: Column, selector: Column, runner: Column) -> Column:
    """status:reason of a probe, the first that holds of six."""
    return (
        F.when(ok.isNull(), "unknown:not_probed").when(~ok, "bad:image_failed").when(runner.isNotNull() & ~runner, "bad:runner_missing")
        .when(selector.isNotNull() & ~selector, "bad:selector_invalid").when(F.coalesce(exit_code, F.lit(0)) != 0, "bad:nonzero_exit").otherwise("ok:")
    )


def group_results(df: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """Per group of tests whether all passed; a test without result fails."""
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(passed), F.lit(False))).alias("all_passed"), F.count("*").alias("tests"))


def metric_means(df: DataFrame, metrics: str) -> DataFrame:
    """Per key of a map column the sum over the number of all rows, so a row without the key counts 0."""
    n = df.count()
    each = df.select(F.explode(metrics).alias("name", "value")).groupBy("name").agg(F.sum("value").alias("_sum"))
    return each.select("name", (F.col("_sum") / n).alias("mean"))


def global_row_number(step: Column, batch: int, attempts: int, position: Column, attempt: Column) -> Column:
    """The number of an attempt over all steps."""
    return step * (batch * attempts) + position * attempts + attempt
