"""Packing: every item whole and once, nothing over capacity, little room left."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_containers_hold_every_item_once(lengths):
    lengths = np.array(lengths, np.int64)
    bins = P.best_two_fit(lengths, 50)
    assert (bins >= 0).all()
    load = np.bincount(bins, weights=lengths) if len(bins) else np.array([])
    assert (load <= 50).all()
    # no worse than twice the room that the items need
    assert len(load) <= max(1, 2 * -(-lengths.sum() // 50)) if len(load) else True


def test_two_items_replace_the_smallest():
    # greedy alone puts 6+2 into a container of 10; 6 with 1+3 leaves nothing
    bins = P.best_two_fit(np.array([6, 3, 2, 1]), 10)
    assert bins[0] == bins[1] == bins[3]


def test_pack_splits_only_what_is_too_long(spark):
    items = spark.createDataFrame([(i, x) for i, x in enumerate([5, 25, 10, 10, 3, 7, 1])], "cache_row_id long, length long")
    configs = spark.createDataFrame([("c", 10, 2), ("big", 100, 8)], "config_name string, capacity_tokens int, train_batch_size int")
    rows = P.pack(items, configs).collect()
    for name, capacity in (("c", 10), ("big", 100)):
        mine = [r for r in rows if r.config_name == name]
        load = {}
        for r in mine:
            load[r.container_index] = load.get(r.container_index, 0) + r.length
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        for i, x in enumerate([5, 25, 10, 10, 3, 7, 1]):
            own = sorted((r.piece, r.start, r.length) for r in mine if r.cache_row_id == i)
            assert sum(p[2] for p in own) == x and len(own) == -(-x // capacity)
    assert {(r.container_index // 2) for r in rows if r.config_name == "c"} == {r.batch_index for r in rows if r.config_name == "c"}
    assert P.pack(items.limit(0), configs).count() == 0
    assert P.pack(items, configs.limit(0)).count() == 0


def test_usable_attempts(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "a", 0, 5, 1, t), (2, "a", 0, 6, 0, t), (3, "a", 1, 0, 1, t), (4, "a", 2, None, 1, t), (5, None, 0, 7, 1, None), (6, None, 0, 7, None, t), (7, "a", 1, -3, 1, t)]
    df = spark.createDataFrame(rows, "cache_row_id long, task_id string, attempt_index int, original_length int, cache_schema_version int, created_at timestamp")
    assert sorted(tuple(r) for r in P.usable_attempts(df).collect()) == [(1, 5), (5, 7), (6, 7)]
