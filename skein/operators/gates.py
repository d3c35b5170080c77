"""Gates and summaries over whole frames: what is too long, what doesn't hold together, what a step amounts to."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.coerce import strip


def length_filter(df: DataFrame, length: Column, budget: int) -> DataFrame:
    """Rows of at most ``budget``, with ``n_tokens``; a row of unknown length is dropped."""
    return df.withColumn("n_tokens", length).where(F.col("n_tokens") <= budget)


def integrity_gate(df: DataFrame, truncated: Column, sizes_equal: Column, leaks: Column, limit: float) -> DataFrame:
    """One row: rows, truncation rate, unequal ones, leaking ones, and whether all is within bounds."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = df.agg(F.count("*").alias("n"), zero(F.avg(F.coalesce(truncated, F.lit(False)).cast("double"))).alias("truncation_rate"), F.count_if(~F.coalesce(sizes_equal, F.lit(False))).alias("unequal"), F.count_if(F.coalesce(leaks, F.lit(False))).alias("leaking"))
    return per.withColumn("passed", (F.col("truncation_rate") <= limit) & (F.col("unequal") == 0) & (F.col("leaking") == 0))


def relabelled(df: DataFrame, rewards: str, threshold: float = 1.0) -> DataFrame:
    """``resolved`` by the sum of the rewards, whatever it was."""
    return df.withColumn("resolved", F.aggregate(rewards, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) >= threshold)


def pool_fingerprint(df: DataFrame, order: str, columns: list[str], targets: list[str]) -> DataFrame:
    """One row: the count and the SHA-256 of the rows in order.

    A row is its ``columns``, each closed by a zero byte, then its lists of ``targets``, each element closed by a
    zero byte, the first list by a one and the others by a two. A digest in order is sequential by nature: the
    rows are made into text where they are, sorted by range, and stream through the driver one partition at a time.
    """
    zero = F.lit("\u0000")
    text = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), zero) for c in columns]
    for k, c in enumerate(targets):
        text += [F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.coalesce(x, F.lit("")), zero)), ""), F.lit("\u0001" if k == 0 else "\u0002")]
    digest, n = hashlib.sha256(), 0
    for row in df.select(order, F.concat(*text).alias("_text")).orderBy(order).toLocalIterator():
        digest.update(row._text.encode("utf-8"))
        n += 1
    return df.sparkSession.createDataFrame([(n, digest.hexdigest())], "n long, digest string")


def step_summary(df: DataFrame, step: str) -> DataFrame:
    """Per step the rows, tasks, resolved ones, mean latency, and the commonest family (ties by name)."""
    family = df.groupBy(step, "task_family").agg(F.count("*").alias("k"))
    top = family.groupBy(step).agg(F.min_by("task_family", F.struct(-F.col("k"), F.coalesce("task_family", F.lit("￿")))).alias("top_family"))
    per = df.groupBy(step).agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"), F.count_if(F.coalesce("resolved", F.lit(False))).alias("resolved"), F.avg("latency_ms").alias("latency"))
    return per.join(top, step)


def chosen_turn(df: DataFrame, keys: list[str], order: str, eligible: Column, seed: int) -> DataFrame:
    """Per attempt one eligible turn by a seeded hash, the same on every run; the middle turn where none is eligible."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumns({"_ok": F.coalesce(eligible, F.lit(False)), "_n": F.count("*").over(by), "_k": F.row_number().over(by.orderBy(order)) - 1})
    some = ranked.groupBy(*keys).agg(F.min_by(order, F.when(F.col("_ok"), F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, order])), 256))).alias("by_hash"), F.max(F.when(F.col("_k") == F.floor((F.col("_n") - 1) / 2), F.col(order))).alias("middle"))
    return some.select(*keys, F.coalesce("by_hash", "middle").alias(order))


def patch_memory(steps: Column, most: int) -> Column:
    """The numbered patches of the successful edits among the first ``most`` steps (tool, patch, exit_code)."""
    kept = F.filter(F.slice(steps, 1, most), lambda s: (s["tool"] == "apply_patch") & (F.coalesce(s["exit_code"], F.lit(0)) == 0) & (F.coalesce(strip(s["patch"]), F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), strip(s["patch"]))), "\n")


#: What the verifier's outcome says to a model.
NOT_CONFIGURED = "No verifier tests were configured for this task."
NOT_CLEAN = "The final verifier did not complete cleanly, so the attempt is not verified as passing all required tests."
PASSED, NOT_PASSED = "All required verifier tests passed.", "Not all required verifier tests passed."
NO_SUBMIT, BAD_SUBMIT, GOOD_SUBMIT = "The student did not make a final submit call.", "The student made a final submit call, but its format was invalid.", "The student made a valid final submit call."


def verifier_text(missing: Column, error: Column, resolved: Column, submitted: Column, submit_valid: Column, report: Column, heading: str) -> Column:
    """What the verifier's outcome says, under a heading; empty where nothing is known. ``report`` speaks only where all else is silent."""
    failed, told = F.coalesce(strip(error), F.lit("")), F.coalesce(strip(report), F.lit(""))
    outcome = F.when(missing, NOT_CONFIGURED).when(failed != "", NOT_CLEAN).when(resolved, PASSED).when(~resolved, NOT_PASSED)
    submission = F.when(~submitted, NO_SUBMIT).when(submit_valid, GOOD_SUBMIT).when(~submit_valid, BAD_SUBMIT)
    said = F.array_compact(F.array(outcome, submission, F.when(failed != "", F.concat(F.lit("Verifier error: "), failed))))
    lines = F.when(F.size(said) > 0, F.array_join(said, "\n")).when(told != "", F.concat(F.lit("The final verifier reported: "), told))
    return F.coalesce(F.concat(F.lit(heading + "\n"), lines), F.lit(""))


def feedback_at_turn(mode: str, turn: Column, turns: Column, current: bool) -> Column:
    """Whether a turn's prompt carries the verifier's text: ``none``, ``all_turns``, else the last prompt only (of the last turn, or of the one before where the next turn is supervised)."""
    if mode in ("none", "all_turns"):
        return F.lit(mode == "all_turns")
    last = turns - (1 if current else 2)
    return (turns > 0) & (last >= 0) & (turn == last)


def merged_truth(extra: Column, truth: Column) -> Column:
    """The extra value where there is one, else the truth's."""
    return F.coalesce(extra, truth)


def typed_column(df: DataFrame, column: str) -> DataFrame:
    """``column`` as double if all its values are numbers (nulls NaN, booleans 0 and 1), else as text (nulls empty)."""
    text = F.col(column).cast("string")
    number = F.coalesce(F.expr(f"try_cast(`{column}` AS double)"), F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0))
    bad = df.agg(F.count_if(F.col(column).isNotNull() & number.isNull())).first()[0]
    return df.withColumn(column, F.coalesce(text, F.lit("")) if bad else F.coalesce(number, F.lit(float("nan"))))


def same_key_set(stored: DataFrame, now: DataFrame, key: str) -> None:
    """Raise if the stored keys and the present ones differ; names up to five of them."""
    off = stored.select(key).exceptAll(now.select(key)).union(now.select(key).exceptAll(stored.select(key))).limit(5).collect()
    if off:
        raise ValueError(f"fixed set has changed: {', '.join(str(r[0]) for r in off)}")
