"""Fixed-capacity containers filled with items of varying length.

Items are dealt by a hash of their id into groups of bounded size, and each
group is packed on its own by best-two-fit: a container takes the longest item
and then, greedily, the longest that still fits; what then remains open is
closed further by swapping the container's smallest item for the two unpacked
items that fill the widened gap best.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

GROUP_ITEMS = 20_000


class _Stock:
    """Unpacked items by length, with the longest length that fits a gap."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.items: dict[int, list[int]] = {}
        for i in np.argsort(lengths, kind="stable")[::-1]:
            self.items.setdefault(int(lengths[i]), []).append(int(i))
        self.have = np.zeros(capacity + 1, bool)
        self.have[list(self.items)] = True
        self.left = len(lengths)

    def take(self, length: int) -> int:
        rows = self.items[length]
        item = rows.pop()
        if not rows:
            self.have[length] = False
        self.left -= 1
        return item

    def give(self, length: int, item: int) -> None:
        self.items[length].append(item)
        self.have[length] = True
        self.left += 1

    def longest(self, gap: int) -> int:
        """The longest stocked length up to ``gap``, 0 if none."""
        found = np.flatnonzero(self.have[: gap + 1][::-1])[:1] if gap < 256 else None
        if found is not None:
            return gap - int(found[0]) if len(found) else 0
        at = self.have[gap::-1].argmax()
        return gap - int(at) if self.have[gap - at] else 0

    def best_two(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two stocked lengths with the largest sum in (above, gap]."""
        small = np.flatnonzero(self.have[: gap // 2 + 1])
        if not len(small):
            return None
        below = np.maximum.accumulate(np.where(self.have[: gap + 1], np.arange(gap + 1), 0))
        mates = below[gap - small]
        twins = mates == small
        if twins.any():
            single = np.array([len(self.items[int(x)]) < 2 for x in small[twins]])
            bad = np.flatnonzero(twins)[single]
            mates[bad] = np.where(small[bad] > 0, below[np.maximum(small[bad] - 1, 0)], 0)
        sums = np.where(mates > 0, small + mates, 0)
        best = int(sums.argmax())
        return (int(small[best]), int(mates[best])) if sums[best] > above else None


def best_two_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of every item; all lengths are in 1..capacity."""
    stock, out, number = _Stock(lengths, capacity), np.full(len(lengths), -1, np.int64), 0
    while stock.left:
        content, gap = [], capacity
        while gap and (length := stock.longest(gap)):
            content.append((length, stock.take(length)))
            gap -= length
        if gap and len(content) > 1 and stock.left > 1:
            small, item = content[-1]
            if two := stock.best_two(gap + small, small):
                content.pop()
                content += [(x, stock.take(x)) for x in two]
                stock.give(small, item)
        for _, item in content:
            out[item] = number
        number += 1
    return out


def usable_attempts(df: DataFrame) -> DataFrame:
    """One row per attempt with a positive original_length: the newest schema, then the latest row.

    Rows without task_id or attempt_index can't be told to repeat and stand
    for themselves.
    """
    known = F.col("task_id").isNotNull() & F.col("attempt_index").isNotNull()
    own = F.when(~known, F.col("cache_row_id"))
    by = Window.partitionBy("task_id", "attempt_index", own).orderBy(F.col("cache_schema_version").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("cache_row_id").desc())
    rows = df.where("original_length > 0").withColumn("_rank", F.row_number().over(by))
    return rows.where("_rank = 1").select("cache_row_id", F.col("original_length").cast("long").alias("length"))


def pack(items: DataFrame, configs: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Items (cache_row_id, length) in the containers of every config.

    Output: config_name, batch_index, container_index, cache_row_id, piece,
    start, length. An item longer than the capacity becomes full pieces and a
    rest, and only such items are split. Containers are numbered without gaps
    and batches hold train_batch_size of them, the last one possibly fewer.
    Items need a unique id and a positive length; none gives an empty result.
    ``configs`` is one row per loop configuration.
    """
    loops = [(r.config_name, int(r.capacity_tokens), int(r.train_batch_size)) for r in configs.collect() if r.capacity_tokens and r.train_batch_size]
    rows = cut(items)
    groups = max(1, -(-rows.count() // group_items))
    schema = "config_name string, grp int, bin int, bins int, cache_row_id long, piece int, start long, length long"

    def fill(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cache_row_id")
        ids, lengths = frame.cache_row_id.to_numpy(), frame.length.to_numpy()
        parts = []
        for name, capacity, _ in loops:
            full = (lengths - 1) // capacity
            rest = lengths - full * capacity
            packed = best_two_fit(rest, capacity)
            bins = int(packed.max()) + 1 if len(packed) else 0
            whole_id, whole_piece = np.repeat(ids, full), np.concatenate([np.arange(k) for k in full[full > 0]] or [np.arange(0)])
            part = pd.DataFrame(
                {
                    "bin": np.concatenate([packed, bins + np.arange(len(whole_id))]),
                    "cache_row_id": np.concatenate([ids, whole_id]),
                    "piece": np.concatenate([full, whole_piece]),
                    "start": np.concatenate([full * capacity, whole_piece * capacity]),
                    "length": np.concatenate([rest, np.full(len(whole_id), capacity)]),
                }
            )
            parts.append(part.assign(config_name=name, grp=int(key[0]), bins=bins + len(whole_id)))
        return pd.concat(parts)[["config_name", "grp", "bin", "bins", "cache_row_id", "piece", "start", "length"]]

    if not loops:
        return rows.sparkSession.createDataFrame([], "config_name string, batch_index long, container_index long, cache_row_id long, piece int, start long, length long")
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("cache_row_id"), F.lit(groups)).cast("int"))
    packed = cut(dealt.repartition(groups, "grp").groupBy("grp").applyInPandas(fill, schema))
    counts = packed.groupBy("config_name", "grp").agg(F.max("bins").alias("bins"))
    earlier = Window.partitionBy("config_name").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("config_name", "grp", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("shift"))
    size = F.create_map(*[F.lit(x) for name, _, batch in loops for x in (name, batch)])
    index = F.col("bin") + F.col("shift")
    numbered = packed.join(shift, ["config_name", "grp"]).withColumn("container_index", index)
    batch = F.floor(F.col("container_index") / size[F.col("config_name")]).alias("batch_index")
    return numbered.select("config_name", batch, "container_index", "cache_row_id", "piece", "start", "length")


def fill_report(packed: DataFrame, configs: DataFrame) -> DataFrame:
    """Per config the containers, the batches, the tokens and the share of room that stays empty."""
    per = packed.groupBy("config_name").agg(
        (F.max("container_index") + 1).alias("containers"),
        (F.max("batch_index") + 1).alias("batches"),
        F.sum("length").alias("tokens"),
        F.count_if(F.col("piece") > 0).alias("later_pieces"),
    )
    room = F.col("containers") * F.col("capacity_tokens")
    return per.join(configs, "config_name").select("config_name", "containers", "batches", "tokens", "later_pieces", (1 - F.col("tokens") / room).alias("empty_share"))
