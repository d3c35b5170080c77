"""Array and message functions against plain Python, joins with missing and repeated keys."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import arrays as A
from skein.functions import messages as M
from skein.operators import joins as J


def test_masks_against_loops(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(0, 1) for _ in range(rng.randint(0, 9))], [rng.randint(0, 1) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, m array<int>, a array<int>")
    got = {r.i: r for r in df.select("i", A.mask_violations(F.col("m"), F.col("a")).alias("v"), A.runs_of_ones(F.col("m")).alias("r"), A.valid_length(F.col("m"), 4).alias("n"), A.reward_at_last(F.col("m"), F.lit(2.0), 5).alias("w"), A.clip_response(F.col("m"), F.col("a"), 6, True).alias("c")).collect()}
    for i, m, a in rows:
        assert got[i].v == [k for k, x in enumerate(m) if x and not (k < len(a) and a[k])]
        runs, k = [], 0
        while k < len(m):
            if m[k]:
                j = k
                while j < len(m) and m[j]:
                    j += 1
                runs.append((k, j))
                k = j
            k += 1
        assert [tuple(r) for r in got[i].r] == runs
        assert got[i].n == sum(m[-4:])
        last = max([k for k, x in enumerate(m) if x], default=-1)
        at = 4 if last < 0 else min(last, 4)
        assert got[i].w == [2.0 if k == at else 0.0 for k in range(5)]
        room = max(6 - len(m), 0)
        assert got[i].c.tokens == m + a[:room] and got[i].c.mask == [0] * len(m) + [1] * len(a[:room]) and got[i].c.clipped == (len(a) > room)


def test_labels(spark):
    df = spark.sql("SELECT array(named_struct('start', 0, 'stop', 2), named_struct('start', 2, 'stop', 5), named_struct('start', 5, 'stop', 5), named_struct('start', 7, 'stop', 9)) AS o, array(named_struct('start', 0, 'stop', 4, 'label', 'think'), named_struct('start', 4, 'stop', 6, 'label', 'tool_call')) AS s")
    labels = A.label_of_offsets(F.col("o"), F.col("s"))
    assert df.select(labels).first()[0] == ["think", "tool_call", "other", "other"]
    assert df.select(A.action_mask(labels)).first()[0] == [1, 1, 0, 0]


def test_verdicts_and_lookup(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cases = [(arr("a", "b"), arr("a", "b"), arr(), True), (arr("a"), arr("a"), arr("a"), False), (arr("a", "b"), arr("a"), arr(), False), (arr(), arr("x"), arr(), True), (arr(), arr(), arr("x"), False), (arr("a"), arr(), arr(), None)]
    assert [spark.range(1).select(A.group_verdict(e, p, f)).first()[0] for e, p, f, _ in cases] == [want for *_, want in cases]
    m = F.create_map(F.lit("Key"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert spark.range(1).select(A.lookup(m, "key"), A.lookup(m, "b"), A.lookup(m, "c")).first()[:] == ("1", "2", None)


def test_messages(spark):
    df = spark.sql("SELECT array(named_struct('role', 'system', 'content', ' s '), named_struct('role', 'tool', 'content', 't'), named_struct('role', 'x', 'content', 'no'), named_struct('role', 'user', 'content', ' '), named_struct('role', 'assistant', 'content', 'a'), named_struct('role', 'assistant', 'content', 'b')) AS m")
    kept = M.known_roles(F.col("m"))
    assert [tuple(x) for x in df.select(kept).first()[0]] == [("system", "s"), ("user", "t"), ("assistant", "a"), ("assistant", "b")]
    assert [tuple(x) for x in df.select(M.prompt_of(kept)).first()[0]] == [("system", "s"), ("user", "t")]
    assert df.select(M.turn_block(F.lit(2), F.lit("hi"), F.array(F.lit("x"), F.lit("y")))).first()[0] == "[TURN_2]\n[ASSISTANT]\nhi\n[TOOL_RESPONSE_1]\nx\n[TOOL_RESPONSE_2]\ny"
    assert df.select(M.sections(("A", F.lit(" ")), ("B", F.lit(" x ")))).first()[0] == "## B\nx"
    assert df.select(M.known_paths(F.array(F.lit("a"), F.lit("b"), F.lit("a")), 2)).first()[0] == ["a", "b"]
    assert df.select(M.tagged_block(F.lit("1<x>2</x>3"), "<x>", "</x>"), M.tagged_block(F.lit("<x>2"), "<x>", "</x>")).first()[:] == ("2", None)


def test_compaction_and_payload(spark):
    df = spark.createDataFrame([("a " * 10, "b " * 10, None)], "x string, y string, z string")
    got = df.select(M.compacted([("x", F.col("x"), 0), ("y", F.col("y"), 4), ("z", F.col("z"), 0)], 8).alias("c")).first().c
    assert got.text.split() == ["b"] * 8 and got.truncated
    assert df.select(M.compacted([("x", F.col("x"), 0)], 10).alias("c")).first().c.truncated is False
    one = spark.createDataFrame([('{"stdout": "a b c d e", "metadata": {}, "exit_code": 1}',), ("plain",), (None,)], "t string")
    assert [r[0].split("\n")[1] for r in one.select(M.response_payload(F.col("t"), 1, 1)).collect()] == ['{"exit_code": 1, "stdout": "a <...truncated...> e"}', '{"stdout": "plain"}', "{}"]


def test_joins(spark):
    left = spark.createDataFrame([(1, "l"), (2, "l")], "id int, c string")
    right = spark.createDataFrame([(1, "r", 5), (3, "r", 6)], "id int, c string, d int")
    assert [tuple(r) for r in J.merge_by_row(left, right, "id").select("id", "c", "d").collect()] == [(1, "l", 5)]
    labels = spark.createDataFrame([(1, "easy"), (1, "easy")], "id int, band string")
    assert {(r.id, r.band, r.band_source) for r in J.labelled(left, labels, "id", "band", "none").collect()} == {(1, "easy", "label"), (2, "none", "default")}
    with pytest.raises(Exception, match="no band for 2"):
        J.labelled(left, labels, "id", "band", None).collect()
    with pytest.raises(Exception, match="repeated record of 1"):
        J.ordered_records(left, labels, "id", "c").collect()
    assert J.last_per_key(right.withColumn("k", F.lit(1)), ["k"], "id").first().d == 6
    sample = J.hashed_sample(spark.range(100), "id", 3, 7)
    assert sample.count() == 7 and sample.exceptAll(J.hashed_sample(spark.range(100), "id", 3, 7)).count() == 0
