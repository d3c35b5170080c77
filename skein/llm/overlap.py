"""Records of evaluation splits that also stand, exactly or almost, in training.

Statements are canonicalised (case, punctuation, markup, entities, list marks
and spacing go) and hashed; evaluation hashes are joined with training hashes.
Whole-statement hashes find equal ones only, so the different ones that remain
are joined by the hashes of a few of their words as well: two word sequences
within the tolerance share so many words that they must share one of the
rarest, if each gives its share of rarest words by one global order. Every
candidate is then verified by edit distance over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.leaks import words
from skein.llm.splits import partition_name, repository, repository_of_task
from skein.session import cut, spread

#: Edits per word of the longer statement: between one in eight (a pair) and one in five (none).
TOLERANCE = 0.16
#: Counters of the word sketch that orders words by rarity; 2 ** 18 of them at any size of input.
SKETCH = 1 << 18


def _canonical(df: DataFrame) -> DataFrame:
    """(id, part, digest, n, sketch, sign): ``sign`` has one character for each word, ``sketch`` its counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digest, count, bucket, sign = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = words(text)
                hashes = [xxhash.xxh64_intdigest(w) for w in own]
                digest.append(xxhash.xxh3_128_hexdigest(b" ".join(own)))
                count.append(len(own))
                bucket.append([h % SKETCH for h in hashes])
                sign.append("".join(chr(0x3400 + (h >> 20) % 0x6C00) for h in hashes))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digest, pa.string()), pa.array(count, pa.int32()), pa.array(bucket, pa.list_(pa.int32())), pa.array(sign, pa.string())], ["task_row_id", "part", "digest", "n", "sketch", "sign"])

    rows = df.select("task_row_id", partition_name(F.col("task_partition")).alias("part"), "problem_statement")
    rows = rows.where("part IS NOT NULL AND problem_statement IS NOT NULL")
    return spread(rows, "task_row_id").mapInArrow(run, "task_row_id long, part string, digest string, n int, sketch array<int>, sign string").where("n > 0")


def _rarity(texts: DataFrame) -> np.ndarray:
    """How often words fall on each counter of the sketch, summed over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SKETCH, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held += np.bincount(flat, minlength=SKETCH)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(held[at])], ["at", "n"])

    out = np.zeros(SKETCH, np.int64)
    got = texts.select("sketch").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _rarest(texts: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(digest, n, in_train, in_held, key, place): the word occurrences of which close texts share one, with their place in the order.

    Words are ordered by rarity, then number; the k-th occurrence of a word is
    an occurrence of its own. Of n words the first floor(TOLERANCE * n) + 1 are
    given: texts of n and m words within the tolerance share at least
    max(n, m) - floor(TOLERANCE * max(n, m)) occurrences, and then the first
    shared one is among the given of both.
    """
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            digest, number, train, held, key, place = [], [], [], [], [], []
            for d, n, t, e, sketch, sign in zip(*(batch.column(i).to_pylist() for i in range(6))):
                seen: dict[tuple[int, str], int] = {}
                occurrences = []
                for at, mark in zip(sketch, sign):
                    k = seen[at, mark] = seen.get((at, mark), 0) + 1
                    occurrences.append((order[at], at, mark, k))
                occurrences.sort()
                own = occurrences[: int(TOLERANCE * n) + 1]
                key += [f"{at}.{mark}.{k}" for _, at, mark, k in own]
                place += range(len(own))
                digest += [d] * len(own)
                number += [n] * len(own)
                train += [t] * len(own)
                held += [e] * len(own)
            yield pa.record_batch([pa.array(digest, pa.string()), pa.array(number, pa.int32()), pa.array(train, pa.bool_()), pa.array(held, pa.bool_()), pa.array(key, pa.string()), pa.array(place, pa.int32())], ["digest", "n", "in_train", "in_held", "key", "place"])

    return texts.select("digest", "n", "in_train", "in_held", "sketch", "sign").mapInArrow(run, "digest string, n int, in_train boolean, in_held boolean, key string, place int")


def _candidates(keys: DataFrame) -> DataFrame:
    """(train_digest, held_digest, most) of the different texts that share a key and may be close.

    Lengths are part of the key: texts within the tolerance lie in the same or
    in neighbouring classes of a geometric scale. A key that many texts share
    (those of one template) is thereby split by length, and further by the skew
    join. What meets is kept only if this can be the pair's first shared key:
    then all they share comes after it in both, and that must be enough.
    """
    scale = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(1 - TOLERANCE))).cast("int")
    a = keys.where("in_train").select(F.col("digest").alias("train_digest"), F.col("n").alias("n_train"), "key", F.col("place").alias("i"), scale.alias("scale"))
    b = keys.where("in_held").select(F.col("digest").alias("held_digest"), F.col("n").alias("n_held"), "key", F.col("place").alias("j"), F.explode(F.array(scale - 1, scale, scale + 1)).alias("scale"))
    longest = F.greatest("n_train", "n_held")
    most = F.floor(longest * TOLERANCE).cast("int")
    enough = F.least(F.col("n_train") - F.col("i"), F.col("n_held") - F.col("j")) >= longest - most
    near = a.join(b, ["key", "scale"]).where((F.col("train_digest") != F.col("held_digest")) & (F.abs(F.col("n_train") - F.col("n_held")) <= most) & enough)
    return near.select("train_digest", "held_digest", most.alias("most")).distinct()


def close_texts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by text, and pairs of texts (train_digest, held_digest, edits), equal ones with 0 edits."""
    canonical = cut(_canonical(df))
    rows = canonical.select("task_row_id", "part", "digest")
    train = F.col("part") == "train"
    texts = cut(canonical.groupBy("digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("sign").alias("sign"), F.bool_or(train).alias("in_train"), F.bool_or(~train).alias("in_held")))
    keys = cut(_rarest(texts, _rarity(texts)))
    candidates = _candidates(keys)
    signs = texts.select("digest", "sign")
    both = candidates.join(signs.select(F.col("digest").alias("train_digest"), F.col("sign").alias("x")), "train_digest").join(signs.select(F.col("digest").alias("held_digest"), F.col("sign").alias("y")), "held_digest")
    edits = F.expr("levenshtein(x, y, most)").cast("int")
    verified = both.select("train_digest", "held_digest", edits.alias("edits")).where("edits >= 0")
    equal = texts.where("in_train AND in_held").select(F.col("digest").alias("train_digest"), F.col("digest").alias("held_digest"), F.lit(0).alias("edits"))
    return rows, equal.unionByName(verified)


def overlaps(df: DataFrame) -> DataFrame:
    """One row per training row and evaluation row with the same or almost the same statement.

    Columns: train_row_id, held_row_id, split (eval or test), edits. Blank
    statements and rows without partition make no pair; an empty table gives an
    empty result; further columns are ignored.
    """
    rows, pairs = close_texts(df)
    pairs = cut(pairs)
    train = rows.where("part = 'train'").select(F.col("task_row_id").alias("train_row_id"), F.col("digest").alias("train_digest"))
    held = rows.where("part <> 'train'").select(F.col("task_row_id").alias("held_row_id"), F.col("part").alias("split"), F.col("digest").alias("held_digest"))
    return pairs.join(train, "train_digest").join(held, "held_digest").select("train_row_id", "held_row_id", "split", "edits")


def overlap_report(df: DataFrame) -> DataFrame:
    """Per split and repository the evaluation rows, those that overlap, and those that do so exactly."""
    found = overlaps(df).groupBy("held_row_id").agg(F.min("edits").alias("edits"))
    part = partition_name(F.col("task_partition"))
    repo = F.coalesce(repository(F.col("repo_slug")), repository_of_task(F.col("task_id")))
    held = df.select(F.col("task_row_id").alias("held_row_id"), part.alias("split"), repo.alias("repository")).where("split <> 'train'")
    return held.join(found, "held_row_id", "left").groupBy("split", "repository").agg(F.count("*").alias("held_rows"), F.count("edits").alias("overlapping"), F.count_if(F.col("edits") == 0).alias("exact"))
