"""The task pool: filtering with one reason per task, first of its kind, joins to side tables, splits, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool_reasons(df: DataFrame, bad_tasks: DataFrame, bad_images: DataFrame, error: Column, identity: Column) -> DataFrame:
    """``df`` with ``reason``: error, bad_task, bad_image or duplicate, null for a task of the pool.

    The first reason in this order counts; duplicates are looked for among the
    tasks that passed so far, the lowest row_index of an identity staying.
    """
    marked = df.withColumn("_error", error).withColumn("_identity", identity)
    marked = marked.join(bad_tasks.select("task_id").distinct().withColumn("_bad_task", F.lit(True)), "task_id", "left")
    marked = marked.join(bad_images.select("image_name").distinct().withColumn("_bad_image", F.lit(True)), "image_name", "left")
    early = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_bad_task"), "bad_task").when(F.col("_bad_image"), "bad_image")
    marked = marked.withColumn("_early", early)
    first = Window.partitionBy("_identity", F.col("_early").isNull()).orderBy("row_index")
    reason = F.coalesce("_early", F.when(F.row_number().over(first) > 1, "duplicate"))
    return marked.withColumn("reason", reason).drop("_error", "_identity", "_bad_task", "_bad_image", "_early")


def longest_prefix(df: DataFrame, column: str, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """``df`` with band and rule: the exact name, else the longest prefix (ties by text), else ``default``.

    The rules are a short list known when the plan is made, so they become one
    CASE expression and no join.
    """
    name = F.col(column)
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    exact = reduce(lambda c, r: c.when(name == r[0], F.struct(F.lit(r[1]).alias("band"), F.lit("exact").alias("rule"))), rules, F.when(F.lit(False), F.struct(F.lit("").alias("band"), F.lit("").alias("rule"))))
    best = reduce(lambda c, r: c.when(name.startswith(r[0]), F.struct(F.lit(r[1]).alias("band"), F.lit("prefix").alias("rule"))), ordered, exact)
    chosen = best.otherwise(F.struct(F.lit(default).alias("band"), F.lit("default").alias("rule")))
    return df.withColumn("_rule", chosen).select(*df.columns, "_rule.band", "_rule.rule")


def eval_size(n: int, fraction: float, least: int, fixed: int | None = None) -> int:
    """How many of n rows are held out: a fixed number, or a fraction with a minimum, always leaving one."""
    if fixed is not None:
        if n < fixed + 1:
            raise ValueError(f"{n} rows can't hold out {fixed}")
        return fixed
    return 0 if fraction <= 0 or n <= 1 else min(max(int(n * fraction), least), n - 1)


def hash_ranked(df: DataFrame, token: Column, buckets: int = 4096) -> DataFrame:
    """``df`` with ``hash_rank`` from 1 in the order of (sha256(token), row_index), without one task seeing all rows.

    Rows fall into buckets by the digest's leading digits, which keep the
    order; ranks are counted per bucket and shifted by the earlier buckets'
    sizes, of which there are at most ``buckets``.
    """
    hashed = df.withColumn("_sha", F.sha2(token, 256)).withColumn("_bucket", F.conv(F.substring("_sha", 1, 3), 16, 10).cast("int") % buckets)
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_bucket").orderBy("_sha", "row_index")
    return hashed.withColumn("_own", F.row_number().over(own)).join(F.broadcast(shift), "_bucket").withColumn("hash_rank", F.col("_own") + F.col("_shift")).drop("_sha", "_bucket", "_own", "_shift")


def split_held_out(df: DataFrame, token: Column, fraction: float, least: int = 1, fixed: int | None = None) -> DataFrame:
    """``df`` with ``split``: the rows of the lowest hash ranks are eval, the others train."""
    k = eval_size(df.count(), fraction, least, fixed)
    return hash_ranked(df, token).withColumn("split", F.when(F.col("hash_rank") <= k, "eval").otherwise("train"))


def wraparound_batch(df: DataFrame, step: int, batch: int) -> DataFrame:
    """Rows (start + k) mod n of the numbered rows (place from 0), k < batch, start = step * batch mod n."""
    n = df.count()
    if not n:
        return df.withColumn("slot", F.lit(0).cast("long")).limit(0)
    slots = df.sparkSession.range(batch).select(F.col("id").alias("slot"), ((F.col("id") + step * batch) % n).alias("place"))
    return df.join(F.broadcast(slots), "place")


def upsample_to_multiple(df: DataFrame, batch: int) -> DataFrame:
    """``df`` (place from 0) with its first rows appended until the count is a multiple of ``batch``; ``added`` marks them."""
    n = df.count()
    need = -n % batch if n else 0
    extra = df.sparkSession.range(need).select((F.col("id") % max(n, 1)).alias("place"))
    return df.withColumn("added", F.lit(False)).unionByName(df.join(F.broadcast(extra), "place").withColumn("added", F.lit(True)))


def effective_batch(rows: int, requested: int, divisor: int) -> int | None:
    """The largest multiple of ``divisor`` up to min(max(requested, divisor), rows), None if there is none."""
    most = min(max(requested, divisor), rows)
    return most // divisor * divisor or None


def length_buckets(df: DataFrame, length: str, global_batch: int, ranks: int, factor: int = 8) -> DataFrame:
    """``df`` (numbered by ``sorted_place`` from 0 in the order of length) with bucket, batch and rank."""
    place = F.col("sorted_place")
    return df.withColumns({"bucket": F.floor(place / (factor * global_batch)), "batch": F.floor(place / global_batch), "rank": place % ranks})


def recent_turns(df: DataFrame, keys: list[str], order: str, text: str, frames: int = 3) -> DataFrame:
    """``df`` with ``recent``: the texts of up to ``frames`` earlier turns that aren't blank, joined by empty lines."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(-frames, -1)
    filled = F.filter(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(by), lambda x: F.btrim(x) != "")
    return df.withColumn("recent", F.array_join(filled, "\n\n"))


def turn_numbers(df: DataFrame, keys: list[str], order: str, is_reply: Column) -> DataFrame:
    """``df`` with ``turn``: how many replies came up to here."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("turn", F.sum(is_reply.cast("long")).over(by))


def islands(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Maximal runs of rows with ``flag``: keys, first, behind (one past the last), length."""
    by = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("_place", F.row_number().over(by) - 1).where(flag)
    marked = numbered.withColumn("_run", F.col("_place") - F.row_number().over(by))
    return marked.groupBy(*keys, "_run").agg(F.min("_place").cast("long").alias("first"), (F.max("_place") + 1).cast("long").alias("behind"), F.count("*").alias("length")).drop("_run")


def retention(df: DataFrame, order: str, keep: int, protected: Column) -> DataFrame:
    """Rows to drop: all but the last ``keep`` in order, and never a protected one."""
    last = df.orderBy(F.desc(order)).limit(keep).select(order)
    return df.join(last, order, "left_anti").where(~protected)


def row_slice(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """The rows at positions start to stop (not included) of the order, each partition giving its own first ``stop`` at most."""
    return df.orderBy(*order).limit(max(stop, 0)).orderBy(*order).offset(max(start, 0))


def pad_arrays(df: DataFrame, arrays: dict[str, object], by: str) -> DataFrame:
    """Each array column right-padded with its pad value to the longest of its ``by`` group."""
    first = next(iter(arrays))
    most = F.max(F.size(first)).over(Window.partitionBy(by))
    padded = df.withColumn("_most", most)
    for c, pad in arrays.items():
        padded = padded.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(pad), F.greatest(F.col("_most") - F.size(c), F.lit(0)))))
    return padded.drop("_most")


def covers(done: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: keys missing from ``done``, keys beyond ``expected``, and whether both are the same set."""
    a, b = done.select(key).distinct().withColumn("d", F.lit(1)), expected.select(key).distinct().withColumn("e", F.lit(1))
    both = a.join(b, key, "full_outer").agg(F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return both.withColumn("same", (F.col("missing") == 0) & (F.col("unexpected") == 0))
