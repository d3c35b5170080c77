"""The schedule's deviation, the shares, the caps and the counts."""

import random
from collections import Counter

import pytest

from skein.llm import mixing as M

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("seed", range(4))
def test_schedule_deviates_by_less_than_a_block(seed):
    random.seed(seed)
    raw = [random.random() ** 3 + 0.001 for _ in range(random.randint(1, 9))]
    weights = {f"s{i}": x / sum(raw) for i, x in enumerate(raw)}
    done = Counter()
    for n, (source, block, slot) in enumerate(M.schedule(weights, 2000), 1):
        assert block == done[source] and slot == n - 1
        done[source] += 1
        if n > 2000:  # the last blocks, begun within the slots
            continue
        assert all(abs(done[s] - w * n) < 1 + 1e-6 for s, w in weights.items())


def test_mixture_meets_shares_and_caps(spark):
    random.seed(1)
    rows = [(i, "word " * random.randint(5, 60), random.choice(["Big", " big", "BIG "])) for i in range(300)]
    rows += [(1000 + i, "other words " * 20, "small") for i in range(20)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (2003, "y", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed = M.mix(df, targets, VOCABULARY, block_tokens=100)
    got = mixed.collect()
    uses = Counter(r.doc_id for r in got)
    assert max(uses.values()) <= 3 and all(n == 1 for d, n in uses.items() if d < 1000)
    assert not {2000, 2001, 2002, 2003} & set(uses)
    share = {r.source: r.actual_share for r in M.share_report(mixed, targets).collect()}
    assert abs(share["small"] - 0.4) < 0.02 and share["absent"] == 0
    assert M.mix(df.limit(0), targets, VOCABULARY).count() == 0
    blocks = {(r.source, r.block): r.slot for r in got}
    assert sorted(blocks.values()) == sorted(set(blocks.values()))  # a slot holds one block
    size = Counter()
    for r in got:
        size[r.source, r.block] += r.tokens
    assert max(size.values()) < 100 + 100  # and a block its tokens, up to the record that ends it
