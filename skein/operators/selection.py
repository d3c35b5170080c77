"""Selecting rollouts by rule, with every rejection's reasons kept, and the numbers on top of that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.running import exact_quantile


@dataclass(frozen=True)
class Policy:
    """Which rules reject a row. Conditions that aren't asked for cost nothing in the plan."""

    terminal: bool = False
    format_valid: bool = False
    resolved: bool = False
    zero_exit: bool = False
    errors: tuple[str, ...] = ()
    reject_label: str = "reject"


#: The policies of the stages that select rows.
STAGE_POLICIES = {"format_rft": Policy(format_valid=True), "positive_rft": Policy(resolved=True)}


def _said(c: str) -> Column:
    return F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) != ""


def rejection_reasons(policy: Policy) -> Column:
    """Reasons in fixed order, joined by commas, null if none.

    Reads container_ok, infra_invalid, invalid_reason, has_submit, format_ok,
    resolved, exit_code and the policy's error columns; nulls count as false,
    except that an unknown exit code passes.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = [F.when(~yes("container_ok"), "container_init_failed"), F.when(yes("infra_invalid"), F.coalesce(F.nullif(F.btrim("invalid_reason"), F.lit("")), F.lit("infra_invalid")))]
    if policy.terminal:
        reasons.append(F.when(~yes("has_submit"), "non_terminal"))
    if policy.format_valid:
        reasons.append(F.when(~yes("format_ok"), "format_invalid"))
    if policy.resolved:
        reasons.append(F.when(~yes("resolved"), "unresolved"))
    if policy.zero_exit:
        reasons.append(F.when(F.coalesce("exit_code", F.lit(0)) != 0, "nonzero_exit_code"))
    reasons += [F.when(_said(c), c) for c in policy.errors]
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*reasons))), ","), F.lit(""))


def select_rows(df: DataFrame, policy: Policy) -> DataFrame:
    """``df`` with selected, label and reasons."""
    reasons = rejection_reasons(policy)
    return df.withColumn("reasons", reasons).withColumn("selected", F.col("reasons").isNull()).withColumn("label", F.when(F.col("reasons").isNull(), "accept").otherwise(policy.reject_label))


def partition_by_length(df: DataFrame, length: str, limit: int) -> DataFrame:
    """Selected rows beyond ``limit`` become rejected, with a reason of their own; all rows stay in one frame."""
    over = F.col("selected") & (F.coalesce(F.col(length), F.lit(limit + 1)) > limit)
    return df.withColumn("reasons", F.when(over, "over_length").otherwise(F.col("reasons"))).withColumn("selected", F.col("selected") & ~over)


def count_by(df: DataFrame, column: str, default: str) -> DataFrame:
    """Rows per trimmed value; null and blank under ``default``."""
    name = F.coalesce(F.nullif(F.btrim(F.col(column)), F.lit("")), F.lit(default))
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame) -> DataFrame:
    """How often each reason occurs among rejected rows."""
    one = F.explode(F.split(F.coalesce("reasons", F.lit("unknown")), ","))
    return df.where(~F.col("selected")).select(one.alias("reason")).select(F.coalesce(F.nullif(F.btrim("reason"), F.lit("")), F.lit("unknown")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def difficulty_band(selected: Column, rollouts: Column) -> Column:
    """near_impossible without any selected row, easy from three quarters on, else learnable."""
    enough = F.greatest(F.lit(1), F.ceil(rollouts * 0.75))
    return F.when((rollouts == 0) | (selected == 0), "near_impossible").when(selected >= enough, "easy").otherwise("learnable")


def band_records(df: DataFrame) -> DataFrame:
    """Per task the rollouts, resolved, selected, over-long and invalid ones, and the band."""
    per = df.groupBy("task_id").agg(
        F.count("*").alias("rollouts"),
        F.count_if(F.coalesce("resolved", F.lit(False))).alias("n_resolved"),
        F.count_if("selected").alias("n_selected"),
        F.count_if(F.coalesce("reasons", F.lit("")) == "over_length").alias("n_over_length"),
        F.count_if(F.coalesce("infra_invalid", F.lit(False))).alias("n_invalid"),
    )
    return per.withColumn("band", difficulty_band(F.col("n_selected"), F.col("rollouts")))


def manifest_counts(df: DataFrame) -> DataFrame:
    """Rows by (selected, family) and by (selected, band) in one pass of grouping sets."""
    rows = df.select("selected", F.coalesce("task_family", F.lit("unknown")).alias("family"), F.coalesce("difficulty_band", F.lit("unbanded")).alias("band"))
    sets = rows.groupingSets([["selected", "family"], ["selected", "band"]], "selected", "family", "band").agg(F.count("*").alias("n"), F.grouping("band").alias("g"))
    return sets.select("selected", F.when(F.col("g") == 1, "family").otherwise("band").alias("kind"), F.coalesce("family", "band").alias("name"), "n")


def format_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Mean of each flag, nulls as false, 0.0 of no rows: one row."""
    return df.agg(*(F.coalesce(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")), F.lit(0.0)).alias(f) for f in flags))


def pair_rewards(student: DataFrame, teacher: DataFrame, keys: list[str], reward: str) -> DataFrame:
    """Full outer pairs per key, first row per key wins (by row_index), missing rewards 0.0."""
    once = lambda d, name: d.groupBy(*keys).agg(F.min_by(F.col(reward), F.col("row_index")).alias(name))
    both = once(student, "student").join(once(teacher, "teacher"), keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(*keys, zero("student").alias("student"), zero("teacher").alias("teacher"), (zero("teacher") - zero("student")).alias("delta"), F.col("teacher").isNull().alias("teacher_missing"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, means, and how many improved, worsened or tied."""
    return pairs.agg(F.count("*").alias("n"), F.avg("student").alias("student_mean"), F.avg("teacher").alias("teacher_mean"), F.avg("delta").alias("delta_mean"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("worsened"), F.count_if(F.col("delta") == 0).alias("tied"))


def token_profile(df: DataFrame, total: str, real: str, loss: str) -> DataFrame:
    """Total, real and loss tokens with their ratios, one row; ratios of nothing are 0."""
    sums = df.agg(*(F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(n) for c, n in ((total, "total"), (real, "useful"), (loss, "loss"))))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return sums.select("total", "useful", "loss", ratio("useful", "total").alias("useful_ratio"), ratio("loss", "useful").alias("loss_ratio"))


def weighted_means(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Per key the weighted mean over the parts that have it, the weight and the maximum."""
    has = F.col(value).isNotNull()
    w = F.when(has, F.col(weight))
    return df.groupBy(key).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.sum(w).alias("weight"), F.max(value).alias("most"))


def entropy_histogram(df: DataFrame, value: str) -> DataFrame:
    """Mean, maximum, four buckets and the share above the exact 0.8 quantile."""
    found = exact_quantile(df, value, 0.8).select("threshold").first()
    v, top = F.col(value), F.lit(found.threshold if found else None).cast("double")
    return df.where(v.isNotNull()).agg(
        F.avg(v).alias("mean"), F.max(v).alias("most"), F.count_if(v < 1).alias("below_1"), F.count_if((v >= 1) & (v < 2)).alias("from_1"), F.count_if((v >= 2) & (v < 4)).alias("from_2"), F.count_if(v >= 4).alias("from_4"), F.avg((v > top).cast("double")).alias("high_share"), F.max(top).alias("threshold")
    )


def bad_rollup(df: DataFrame) -> DataFrame:
    """(task_id, why): tasks marked themselves, and all tasks of a marked image.

    Reads task_id, image_name, task_bad, image_bad.
    """
    own = df.where("task_bad").select("task_id", F.lit("task").alias("why"))
    images = df.where("image_bad").select("image_name").distinct()
    of_image = df.join(images, "image_name", "left_semi").select("task_id", F.lit("image").alias("why"))
    return own.union(of_image).groupBy("task_id").agg(F.min("why").alias("why"))
