"""Running totals over a total order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut


def running_total(df: DataFrame, order: list[str | Column], value: str, out: str, by: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the earlier rows, per ``by`` if given.

    Rows are range-partitioned by ``order`` (with ``by`` first, so a large
    group spans many partitions) and written once; each partition sums its own
    rows, and only one number per partition and group is gathered to shift
    them. ``order`` has to be total for a repeatable result.
    """
    keys = [F.col(by), *order] if by else list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    rows = cut(ranged)
    group = ["_part", by] if by else ["_part"]
    totals = rows.groupBy(*group).agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part") if not by else Window.partitionBy(by).orderBy("_part")
    shift = totals.withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return inner.join(shift, group).withColumn(out, F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")


def exact_quantile(df: DataFrame, value: str, q: float, by: str | None = None) -> DataFrame:
    """(``by``, threshold, most, n): the interpolated quantile of the values that aren't null, no task holding a whole group.

    The two rows at the quantile are found by their rank in a range-partitioned order.
    """
    group = [by] if by else []
    rows = df.select(*group, F.col(value).cast("double").alias("_value"), F.lit(1).alias("_one")).where("_value IS NOT NULL")
    ranked = running_total(rows, [F.col("_value")], "_one", "_rank", by)
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"), F.max("_value").alias("most"))
    both = ranked.join(counts, by) if by else ranked.select("*", *(F.lit(x).alias(c) for c, x in counts.first().asDict().items()))
    both = both.withColumn("_at", (F.col("n") - 1) * F.lit(q))
    at = lambda f: F.max(F.when(F.col("_rank") == f("_at"), F.col("_value")))
    ends = both.groupBy(*group, "n", "most", "_at").agg(at(F.floor).alias("_low"), at(F.ceil).alias("_high"))
    return ends.select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("threshold"), "most", "n")
