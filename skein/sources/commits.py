"""Steps that count only once committed, and files named after what they depend on.

Files are read and written through Hadoop's file system, so a shared folder of any kind will do.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

COMMIT = "latest_committed.json"
_CACHED: dict[str, DataFrame] = {}


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read_json(spark: SparkSession, path: str) -> dict:
    """The object in a small file; an empty one where there is no file."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return {}
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write beside, then rename, so a reader sees the old file or the new one and never half of it."""
    fs, where = _fs(spark, path)
    half = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".half")
    stream = fs.create(half, True)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(half, where):
        raise OSError(f"can't rename to {path}")


@dataclass(frozen=True)
class Steps:
    """The steps of a stage under ``folder``: each a table in its own folder, valid once the commit file names it or a later one."""

    spark: SparkSession
    folder: str
    stage: str

    def path(self, step: int) -> str:
        return f"{self.folder}/step={step:06d}"

    def last(self) -> int | None:
        """The last committed step, None before the first; another stage's commits or lost tables are refused."""
        commit = read_json(self.spark, f"{self.folder}/{COMMIT}")
        if not commit:
            return None
        if commit.get("stage") != self.stage:
            raise ValueError(f"committed by stage {commit.get('stage')!r}, not {self.stage!r}")
        if lost := [p for p in commit.get("paths", []) if not exists(self.spark, p)]:
            raise ValueError(f"committed but missing: {', '.join(lost)}")
        return int(commit["step"])

    def write(self, step: int, df: DataFrame) -> None:
        """Write a step and commit it. What an earlier try left of it goes first; committed steps aren't written again."""
        last = self.last()
        if last is not None and step <= last:
            return
        if step != (0 if last is None else last + 1):
            raise ValueError(f"step {step} after {last}")
        remove(self.spark, self.path(step))
        df.write.parquet(self.path(step))
        write_json(self.spark, f"{self.folder}/{COMMIT}", {"stage": self.stage, "step": step, "paths": [self.path(step)]})

    def drop_dirty(self, upto: int) -> list[int]:
        """Delete the steps up to ``upto`` that were written but never committed; which they were."""
        last = self.last()
        dirty = [s for s in range(-1 if last is None else last, upto + 1) if s > (-1 if last is None else last) and exists(self.spark, self.path(s))]
        for s in dirty:
            remove(self.spark, self.path(s))
        return dirty

    def read(self) -> DataFrame | None:
        """All committed steps, with ``step``; None before the first commit."""
        last = self.last()
        if last is None:
            return None
        return self.spark.read.option("basePath", self.folder).parquet(*(self.path(s) for s in range(last + 1)))


def cache_path(folder: str, kind: str, settings: dict, shown: str = "") -> str:
    """A file name that says what it caches and changes with any setting: 16 hex digits of the digest of the compact sorted JSON."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    name = re.sub(r"[^A-Za-z0-9.-]+", "_", shown).strip("_")
    return f"{folder}/{kind}{'-' + name if name else ''}-{digest}"


def file_token(spark: SparkSession, path: str) -> str:
    """Changes when the file does: its time of change and size, ``absent`` where there is none."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return "absent"
    status = fs.getFileStatus(where)
    return f"{status.getModificationTime()}:{status.getLen()}"


def cached_result(settings: dict, files: list[str], spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` gives, once per settings and state of the files it reads."""
    key = json.dumps([id(spark), settings, [[f, file_token(spark, f)] for f in files]], sort_keys=True)
    if key not in _CACHED:
        _CACHED[key] = build().cache()
    return _CACHED[key]


def write_token_cache(df: DataFrame, path: str, version: int, fingerprint: str) -> None:
    """Token records with the schema version and fingerprint they were made under; no record is an error."""
    if df.isEmpty():
        raise ValueError("no token records to write")
    from pyspark.sql import functions as F

    df.withColumns({"cache_schema_version": F.lit(version), "cache_fingerprint": F.lit(fingerprint)}).write.mode("overwrite").parquet(path)


def append_progress(done: DataFrame, key: str, folder: str, expected: int) -> dict:
    """Add the records whose key isn't there yet, then write the header that says how far the run is; a repeated call adds nothing."""
    spark, table, schema = done.sparkSession, f"{folder}/records", done.schema
    spark.createDataFrame([], schema).write.mode("append").parquet(table)
    held = spark.read.schema(schema).parquet(table)
    done.dropDuplicates([key]).join(held.select(key), key, "left_anti").write.mode("append").parquet(table)
    n = spark.read.schema(schema).parquet(table).count()
    header = {"done": n, "expected": expected, "status": "complete" if n >= expected else "partial"}
    write_json(spark, f"{folder}/progress.json", header)
    return header
