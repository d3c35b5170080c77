"""Clusters of near-equal short texts by verified MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.splits import contract
from skein.session import cut

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 6
#: Parts of a bucket.
SALTS = 16
_PRIME = (1 << 31) - 1


def shingles(text: str) -> np.ndarray:
    """Numbers of the runs of five words; a shorter text is one shingle."""
    import xxhash

    own = text.split()
    runs = {" ".join(own[i : i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1))}
    return np.array(sorted(xxhash.xxh32_intdigest(r) for r in runs), np.int64)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, _PRIME, (BANDS * ROWS, 1)), rng.integers(0, _PRIME, (BANDS * ROWS, 1))


def _banded(texts: DataFrame) -> DataFrame:
    """(digest, shingles, bands) of (digest, shape)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        for batch in batches:
            sets, bands = [], []
            for shape in batch.column(1).to_pylist():
                own = shingles(shape)
                least = ((a * (own % _PRIME) + b) % _PRIME).min(axis=1).reshape(BANDS, ROWS)
                sets.append(own)
                bands.append([f"{k}:" + ".".join(map(str, r)) for k, r in enumerate(least)])
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.string()))], ["digest", "shingles", "bands"])

    return texts.select("digest", "shape").mapInArrow(run, "digest long, shingles array<long>, bands array<string>")


def clusters(texts: DataFrame) -> DataFrame:
    """(digest, cluster) of every text of (digest, shape); digests are unique.

    In each band's bucket a text is compared with the bucket's smallest member
    and with its neighbour in the order of the next band's hashes, so a bucket
    of k texts gives fewer than 2 k comparisons; a bucket is ordered in SALTS
    parts, those of equal hashes together, so a large one isn't one task. Members of a bucket that are then
    still in different clusters are all compared, so no verified link of two
    texts with a common bucket is lost. Clusters are the components of the
    verified links; a text without any is a cluster of its own.
    """
    banded = cut(_banded(texts))
    sets = banded.select("digest", "shingles")
    following = F.concat(F.slice("bands", 2, BANDS), F.slice("bands", 1, 1))
    spread = banded.select("digest", F.explode(F.arrays_zip(F.col("bands").alias("band"), following.alias("key"))).alias("b")).select("digest", "b.band", "b.key")
    heads = spread.groupBy("band").agg(F.min("digest").alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
    spread = cut(spread.join(heads, "band"))
    part = Window.partitionBy("band", F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy("key", "digest")
    near = spread.select("digest", F.lag("digest").over(part).alias("before"), "head")
    pairs = near.select("digest", F.explode(F.array("before", "head")).alias("other_digest")).where("other_digest <> digest").select(F.least("digest", "other_digest").alias("a"), F.greatest("digest", "other_digest").alias("b")).distinct()
    own = texts.select("digest", F.col("digest").cast("string").alias("vertex"))
    first = cut(own.join(contract(_links(pairs, sets)), "vertex", "left").select("digest", F.coalesce("label", "vertex").alias("cluster")))
    mixed = spread.select("digest", "band").join(first, "digest")
    mixed = mixed.join(mixed.groupBy("band").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most")).where("least <> most").select("band"), "band")
    sized = mixed.join(sets.select("digest", F.size("shingles").alias("size")), "digest")
    # nothing of less than SIMILARITY the size can be as similar
    close = F.expr(f"a.cluster < b.cluster AND least(a.size, b.size) >= {SIMILARITY} * greatest(a.size, b.size)")
    across = sized.alias("a").join(sized.alias("b"), (F.col("a.band") == F.col("b.band")) & close)
    missed = _links(across.select(F.col("a.digest").alias("a"), F.col("b.digest").alias("b")).distinct(), sets)
    named = first.select(F.col("digest").cast("string").alias("digest"), "cluster")
    between = missed.join(named.toDF("src", "x"), "src").join(named.toDF("dst", "y"), "dst").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    return first.withColumnRenamed("cluster", "vertex").join(contract(between), "vertex", "left").select("digest", F.coalesce("label", "vertex").alias("cluster"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) of those pairs (a, b) that are similar."""
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
