"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, name: str = "skein") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session's setting.

    A folder given to ``SparkContext.setCheckpointDir`` counts as well. Where
    neither is set, a session in one process (tests, a laptop) gets a local
    folder once; a cluster has to name one that its executors share.
    """
    context = spark.sparkContext
    where = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    The written table replaces the lineage, so a lost executor never sends a
    job back to the start, and what is read twice is computed once. ``drop_cuts``
    deletes the tables; those that are left when the process ends go then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_drop_all)
    _TABLES.setdefault(id(spark.sparkContext), []).append(path)
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut`` with aggregates of ``df`` taken while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
    return out, seen.get


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            drop_cuts(spark)
        except Exception:  # the JVM may have gone first
            pass


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables ``cut`` wrote, once no result needs them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _TABLES.pop(id(spark.sparkContext), []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


_TABLES: dict[int, list[str]] = {}


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` for work in Python: dealt by ``key`` to all cores where its files make fewer tasks than there are cores.

    A file of one row group is one task however large it is. Input of enough
    parts, and what a shuffle has dealt already, stays where it is.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
