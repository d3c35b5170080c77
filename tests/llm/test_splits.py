"""Groups against union-find, spellings one by one, and the assignment's shares."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm import splits as S

SCHEMA = "task_row_id long, task_id string, repo_slug string, author string, task_partition string, label string"


def groups_by_union_find(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, t, r, a, *_ in rows:
        for k in (("t", t), ("r", r), ("a", a)):
            if k[1]:
                parent[root(k)] = root(("row", i))
    low = {}
    for i, *_ in rows:
        low[root(("row", i))] = min(i, low.get(root(("row", i)), i))
    return {i: low[root(("row", i))] for i, *_ in rows}


def test_groups_match_union_find(spark):
    random.seed(3)
    pick = lambda kind, n: random.choice([None, f"{kind}{random.randint(0, n)}"])
    rows = [(i, pick("job-", 60), (o := pick("own", 40)) and o + "/lib", pick("who", 50), random.choice(["train", "TEST ", None]), "x") for i in range(120)]
    rows += [(200 + i, None, "hot/repo", f"h{i}", "train", "x") for i in range(60)]
    got = {r.task_row_id: r.group_row_id for r in S.related_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == groups_by_union_find(rows)


def test_conflicts_and_empty(spark):
    rows = [
        (1, "a__b.1f__fam_x__99", None, None, "train", ""), (2, None, "https://git.example/A/B.git", None, " VAL ", ""),
        (3, None, "x/y", "Zed <zed@mail.example>", "test", ""), (4, None, None, "@ZED", "all", ""), (5, None, None, "unknown", "train", ""), (6, None, None, "unknown", "test", ""), (7, None, None, None, None, ""),
    ]
    got = {(r.task_row_id, r.group_row_id) for r in S.split_conflicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1)}
    assert S.split_conflicts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["o/n", "O/N ", "https://git.example/o/n", "https://git.example/o/n.git", "git@git.example:o/n.git", "o/n/"])
def test_repository_spellings(spark, text):
    assert spark.range(1).select(S.repository(F.lit(text))).first()[0] == "o/n"


@pytest.mark.parametrize("text,handle", [("Zed <zed@mail.example>", "zed"), ("zed@mail.example", "zed"), ("@Zed", "zed"), (" ZED\t", "zed"), ("n/a", None), ("", None)])
def test_author_spellings(spark, text, handle):
    assert spark.range(1).select(S.author_handle(F.lit(text))).first()[0] == handle


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(i, f"job-{i}", None, f"w{i // 3}", None, "") for i in range(600)]
    targets = spark.createDataFrame([("train", 0.8), ("eval", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = S.assign_splits(spark.createDataFrame(rows, SCHEMA), targets).collect()
    assert len(got) == 600
    per = {}
    for r in got:
        per.setdefault(r.group_row_id, set()).add(r.split_name)
    assert all(len(v) == 1 for v in per.values())
    share = {s: sum(r.split_name == s for r in got) / 600 for s in ("train", "eval", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["eval"] - 0.1) < 0.01


def test_a_hub_is_split(spark):
    """Half of all rows share one repository: the joins on it are split, and the labels are right."""
    small = {"skewJoin.skewedPartitionThresholdInBytes": "10k", "skewJoin.skewedPartitionFactor": "2", "advisoryPartitionSizeInBytes": "5k", "autoBroadcastJoinThreshold": "-1"}
    held = {f"spark.sql.adaptive.{k}": v for k, v in small.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        # several map tasks, by which a partition is split
        leaves = spark.range(0, 40_000, 1, 8).selectExpr("concat('leaf', id) AS src", "CASE WHEN id % 2 = 0 THEN 'hub' ELSE concat('own', id) END AS dst")
        mates = spark.sql("SELECT 'hub' AS vertex, 'x' AS parent UNION ALL SELECT concat('own', id), 'y' FROM range(40000)")
        joined = spark.sql("SELECT src, coalesce(parent, dst) AS dst FROM {e} LEFT JOIN {m} ON vertex = dst", e=leaves, m=mates)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        labels = {r.vertex: r.label for r in S.contract(leaves).collect()}
        assert len({labels[f"leaf{i}"] for i in range(0, 40_000, 2)}) == 1 and len(set(labels.values())) == 20_001
    finally:
        for k in held:
            spark.conf.unset(k)
