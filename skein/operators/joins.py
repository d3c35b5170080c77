"""Joins with a rule for what is missing or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_by_row(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Rows with the same id, columns of ``left`` winning over ``right``'s of the same name."""
    return left.join(right.drop(*(set(left.columns) & set(right.columns) - {row_id})), row_id)


def labelled(df: DataFrame, labels: DataFrame, key: str, label: str, default: str | None) -> DataFrame:
    """``df`` with the label of its key and its source; a missing label is ``default``, or an error if that is None."""
    found = df.join(labels.select(key, F.col(label).alias("_label")).dropDuplicates([key]), key, "left")
    absent = F.raise_error(F.concat(F.lit(f"no {label} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))) if default is None else F.lit(default)
    return found.withColumn(label, F.when(F.col("_label").isNull(), absent).otherwise(F.col("_label"))).withColumn(f"{label}_source", F.when(F.col("_label").isNull(), "default").otherwise("label")).drop("_label")


def ordered_records(tasks: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """The records of the tasks, with the task's place; a repeated record is an error when the result is read."""
    once = records.groupBy(key).agg(F.first(F.struct(*[c for c in records.columns if c != key])).alias("r"), F.count("*").alias("n"))
    checked = once.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated record of "), F.col(key).cast("string")))).otherwise(F.col("n")))
    return tasks.select(key, order).join(checked.where("n = 1"), key).select(key, order, "r.*")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, in one aggregate."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(*keys, "r.*")


def hashed_sample(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """The rows of ``most`` distinct keys, chosen by a seeded hash: the same on every run."""
    keys = df.select(key).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key).limit(most)
    return df.join(F.broadcast(keys), key, "left_semi")
