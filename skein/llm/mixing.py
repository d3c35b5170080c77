"""Sources mixed to target weights, interleaved by Pfair scheduling.

A source may give at most (its tokens) x max_repeats, so the largest mixture
that has the target shares follows from sums per source. Each source's records
are laid end to end in a hashed order, once per repetition, up to its quota, and
cut into as many blocks as its share of the slots. A block has a release time
and a deadline from its source's weight; earliest deadline first among the
released then gives every source its share at every moment, within one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.running import running_total
from skein.session import cut, spread

#: Tokens in a scheduled block. The schedule has a small row per block and is made on the driver, so a corpus of many terabytes takes larger blocks.
BLOCK_TOKENS = 16_384


def encoder(path: str):
    """The byte-level BPE whose ranks the file at ``path`` lists; once per process."""
    import base64

    import tiktoken

    held = vars(tiktoken).setdefault("_skein_encodings", {})  # outlives this task's copy of the code
    if path not in held:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        held[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def token_counts(df: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) of every row with a text; source in lower case without blanks around."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "source": frame.source, "tokens": [len(encode(t)) for t in frame.text]})

    source = F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = df.where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", source.alias("source"), "text")
    return spread(rows, "doc_id").mapInPandas(count, "doc_id long, source string, tokens long")


def schedule(weights: dict[str, float], slots: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of all blocks by earliest deadline first among the released ones.

    Block b of a source of weight w is released at floor(b / w) and due at
    ceil((b + 1) / w); with weights that sum to 1 no block is late. A source
    has the blocks that begin within ``slots``, the last one perhaps in part,
    so a few slots more than that may be given.
    """
    def window(source: str, block: int) -> tuple[int, int]:
        w = weights[source]
        return int(block / w + 1e-9), int(-(-(block + 1) // w) if w == 1 else -((-(block + 1) / w + 1e-9) // 1))

    blocks = {s: blocks_of(w, slots) for s, w in weights.items()}
    waiting = [(0, source, 0) for source in sorted(weights) if blocks[source] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, float, str, int]] = []
    out: list[tuple[str, int, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and (waiting[0][0] <= slot or not ready):
            _, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (window(source, block)[1], -weights[source], source, block))
        _, _, source, block = heapq.heappop(ready)
        out.append((source, block, slot))
        slot += 1
        if block + 1 < blocks[source]:
            heapq.heappush(waiting, (window(source, block + 1)[0], source, block + 1))
    return out


def blocks_of(weight: float, slots: int) -> int:
    """How many blocks of a source begin within the slots."""
    return max(1, -int(-weight * slots // 1)) if weight > 0 and slots > 0 else 0


def quotas(counts: DataFrame, targets: DataFrame) -> list[tuple[str, float, int, int, float]]:
    """(source, share, tokens, records, quota) of each target; one small row per source.

    A target without any token gets no quota and its share goes to the others
    in proportion, so that the rest keeps its proportions.
    """
    got = {r.source: r for r in counts.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).join(targets.select("source"), "source", "left_semi").collect()}
    wanted = [(r.source, r.target_share, max(0, r.max_repeats or 0)) for r in targets.collect() if (r.target_share or 0) > 0]
    live = [(s, share, repeats) for s, share, repeats in wanted if s in got and repeats > 0]
    whole = sum(share for _, share, _ in live) or 1.0
    size = min((got[s].tokens * repeats * whole / share for s, share, repeats in live), default=0.0)
    return [(s, share / whole, got[s].tokens, got[s].n, size * share / whole) for s, share, _ in live]


def mix(df: DataFrame, targets: DataFrame, vocabulary: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every use of a record in the mixture: doc_id, source, use (from 0), tokens, block, slot.

    Records are used in the order of ``slot``, then ``block_start``. A record is
    used in a repetition if its middle lies within its source's quota, so the
    shares are met within one record. Texts without tokens, sources without a
    target and null texts or sources aren't used; an empty table gives an empty
    result. A block has ``block_tokens`` tokens at any size of input, and every
    block has its slot.
    """
    counts = cut(token_counts(df, vocabulary).where("tokens > 0"))
    shares = quotas(counts, targets)
    spark = counts.sparkSession
    schema = "source string, block long, slot long"
    if not shares:
        return spark.createDataFrame([], "doc_id long, source string, use int, tokens long, block long, block_start double, slot long")
    slots = max(1, round(sum(q for *_, q in shares) / block_tokens))
    order = schedule({s: share for s, share, *_ in shares}, slots)
    slot_of = spark.createDataFrame(pd.DataFrame(order, columns=["source", "block", "slot"]), schema)
    quota = spark.createDataFrame([(s, share, int(t), float(q), blocks_of(share, slots)) for s, share, t, _, q in shares], "source string, share double, source_tokens long, quota double, blocks long")
    used = counts.join(F.broadcast(quota), "source")
    laid = running_total(used.withColumn("spot", F.xxhash64("doc_id")), [F.col("spot"), F.col("doc_id")], "tokens", "before", by="source")
    middle = F.col("before") + F.col("tokens") / 2
    uses = F.greatest(F.ceil((F.col("quota") - middle) / F.col("source_tokens")), F.lit(0)).cast("int")
    repeated = laid.where(uses > 0).withColumn("use", F.explode(F.sequence(F.lit(0), uses - 1)))
    start = F.col("before") + F.col("use").cast("double") * F.col("source_tokens")
    block = F.least(F.floor(start / F.col("quota") * F.col("share") * slots), F.col("blocks") - 1).cast("long")
    placed = repeated.withColumn("block_start", start).withColumn("block", block)
    return placed.join(slot_of, ["source", "block"]).select("doc_id", "source", "use", "tokens", "block", "block_start", "slot")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source the tokens and share reached and the most uses of a record."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), (F.max("use") + 1).alias("most_uses"))
    per = cut(per)
    total = per.agg(F.sum("tokens")).first()[0] or 1
    both = targets.join(per, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = F.coalesce(F.col("tokens") / total, F.lit(0.0))
    return both.select("source", "target_share", "max_repeats", zero("tokens").alias("tokens"), zero("records").alias("records"), zero("most_uses").alias("most_uses"), share.alias("actual_share"))
