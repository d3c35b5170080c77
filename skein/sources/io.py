"""Sources and sinks: rows from JSON, JSON lines and Parquet, checked on the way in, and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.commits import write_json

TOKEN_CACHE_COLUMNS = ("task_id", "attempt_index", "original_length", "sequence_length", "loss_token_count", "cache_schema_version", "cache_fingerprint")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or a ValueError that lists the missing columns; checked on the plan, without reading."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a .parquet table, a .json list or JSON lines; what isn't an object is left out, and ``malformed`` counts it."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema is not None else reader
    return reader.json(path, multiLine=path.endswith(".json"))


def malformed(spark: SparkSession, path: str) -> int:
    """How many lines of a JSON-lines file hold no object, blank ones aside."""
    line = F.btrim("value")
    return spark.read.text(path).where((line != "") & (~line.startswith("{") | F.get_json_object("value", "$").isNull())).count()


def read_bad_tasks(spark: SparkSession, path: str, documents: str = "whole") -> tuple[DataFrame, DataFrame]:
    """(task_id), (image_name) of a JSON document (or one per line) of records whose status is bad or isn't given."""
    schema = "records array<struct<task_id:string,image_name:string,status:string>>, bad_task_ids array<string>, bad_image_names array<string>"
    doc = spark.read.schema(schema).json(path, multiLine=documents == "whole")
    record = doc.select(F.explode("records").alias("r")).where("coalesce(trim(r.status), '') IN ('', 'bad')")
    named = lambda f, c, e: record.select(F.col(f"r.{f}").alias(c)).union(doc.select(F.explode(e))).where(f"coalesce(trim({c}), '') <> ''").distinct()
    return named("task_id", "task_id", "bad_task_ids"), named("image_name", "image_name", "bad_image_names")


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, band) of a probe cache in any of its layouts: two record lists, JSON lines, two maps.

    A task named twice or without band is an error when the result is read.
    """
    schema = "records array<struct<task_id:string,band:string>>, task_band_records array<struct<task_id:string,band:string>>, task_band_by_task_id map<string,string>, task_bands map<string,struct<band:string>>, task_id string, band string"
    doc = spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))
    parts = [doc.select(F.explode(c).alias("r")).select("r.task_id", "r.band") for c in ("records", "task_band_records")]
    parts.append(doc.select(F.explode("task_band_by_task_id").alias("task_id", "band")))
    parts.append(doc.select(F.explode("task_bands").alias("task_id", "s")).select("task_id", "s.band"))
    parts.append(doc.where("task_id IS NOT NULL").select("task_id", "band"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    per = rows.groupBy("task_id").agg(F.first("band").alias("band"), F.count("*").alias("n"))
    bad = (F.col("n") > 1) | (F.coalesce(F.trim("band"), F.lit("")) == "")
    return per.select("task_id", F.when(bad, F.raise_error(F.concat(F.lit("repeated task or empty band: "), "task_id"))).otherwise(F.col("band")).alias("band"))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line with its keys sorted."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Lines added to a log that is only ever appended to."""
    write_jsonl(df, path, "append")


def replayed(spark: SparkSession, rows: list[dict], schema: str, defaults: dict) -> DataFrame:
    """A list in memory as a source; a key that a row lacks takes its default, one that is there and null stays null."""
    return spark.createDataFrame([defaults | row for row in rows], schema)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    """Snappy Parquet; an empty frame is an error, as nothing could be trained on it."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def read_token_cache(spark: SparkSession, paths: list[str], version: int, fingerprint: str | None = None, least: int = 1) -> DataFrame:
    """The rows of one or more cache files, all of one version (and fingerprint), at least ``least``."""
    df = require_columns(spark.read.parquet(*paths), list(TOKEN_CACHE_COLUMNS))
    other = ~F.col("cache_schema_version").eqNullSafe(version)
    if fingerprint is not None:
        other = other | ~F.col("cache_fingerprint").eqNullSafe(fingerprint)
    n, stale = df.agg(F.count("*"), F.count_if(other)).first()
    if stale or n < least:
        raise ValueError(f"{stale} rows of another version, {n} rows in all")
    return df


def write_manifest(spark: SparkSession, path: str, payload: dict) -> None:
    """A small JSON document, whole or not at all, on any file system that Hadoop knows."""
    write_json(spark, path, payload)


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file below ``folder`` whose name fits ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    row = files.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row.path
