"""Incremental runs as Structured Streaming queries over arriving files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import shared_folder


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of ``path`` as a stream, with the schema they have now."""
    # as a pattern, since a stream's plain path has to be a folder and a table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _drained(writer, spark: SparkSession, checkpoint: str | None) -> None:
    where = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer.option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def first_per_key(stream: DataFrame, keys: list[str], out: str, checkpoint: str | None = None) -> DataFrame:
    """The first row of each key, appended once whatever arrives later; run again, it only adds what is new.

    The keys seen are those of the table itself, so no state grows with the stream.
    """
    return resumed_append(stream, keys, out, checkpoint)


def running_counts(stream: DataFrame, time: str, late: str, window: str, keys: list[str], out: str, checkpoint: str | None = None) -> DataFrame:
    """Rows per event-time window and key; windows are written once ``late`` has passed, later rows are dropped."""
    spark = stream.sparkSession
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    flat = counts.select(F.col("w.start").alias("start"), *keys, "n")
    _drained(flat.writeStream.format("parquet").outputMode("append").option("path", out), spark, checkpoint)
    return spark.read.schema(flat.schema).parquet(out)


def window_counts(stream: DataFrame, time: str, window: str, keys: list[str], out: str, checkpoint: str | None = None) -> DataFrame:
    """All rows per event-time window and key, however late (start null: without time); run again, it only adds what is new."""
    spark = stream.sparkSession
    flat = "start timestamp, " + "".join(f"`{k}` {stream.schema[k].dataType.simpleString()}, " for k in keys) + "n long"

    def count(batch: DataFrame, number: int) -> None:
        timed = batch.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
        untimed = batch.where(F.col(time).isNull()).groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit(None).cast("timestamp").alias("start"), *keys, "n")
        # a batch that is repeated after a failure replaces its own counts
        timed.unionByName(untimed).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    spark.createDataFrame([], flat).write.mode("overwrite").parquet(f"{out}/batch-none")
    _drained(stream.writeStream.foreachBatch(count), spark, checkpoint)
    return spark.read.schema(flat).parquet(f"{out}/batch-*").groupBy("start", *keys).agg(F.sum("n").alias("n"))


#: Folders of an appended table by hash of the key; a batch reads the keys of those it falls into.
BUCKETS = 64


def resumed_append(stream: DataFrame, key: str | list[str], out: str, checkpoint: str | None = None) -> DataFrame:
    """Rows whose key isn't in ``out`` yet are appended batch by batch; a repeated batch adds nothing.

    ``out`` is laid out by hash of the key. Each batch is anti-joined with the
    keys (no other column) in the folders it falls into, so a run that broke off
    resumes where it was. A null key is a key like others.
    """
    spark, keys = stream.sparkSession, [key] if isinstance(key, str) else key
    schema = T.StructType([*stream.schema.fields, T.StructField("_bucket", T.IntegerType())])

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        done = batch.sparkSession.read.schema(schema).parquet(out).where(F.col("_bucket").isin(touched)).select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        fresh.join(done, same, "left_anti").write.mode("append").partitionBy("_bucket").parquet(out)

    spark.createDataFrame([], schema).write.mode("append").partitionBy("_bucket").parquet(out)
    _drained(stream.writeStream.foreachBatch(append), spark, checkpoint)
    return spark.read.schema(schema).parquet(out).drop("_bucket")
