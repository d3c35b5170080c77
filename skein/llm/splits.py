"""Splits that keep related records together.

Rows are related if they share a task, a repository or an author, directly or
through other rows. Components come from random-mate contraction: each round
every vertex draws a coin, tails hang themselves onto a heads neighbour, edges
are rewritten onto the survivors, and the rounds end when no edge is left; the
recorded parents are then unwound from the last round to the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.running import running_total
from skein.session import cut, cut_counted

#: Stand-ins that name nobody.
PLACEHOLDERS = ("", "-", "--", "?", ".", "n/a", "na", "n.a.", "nil", "none", "null", "unknown", "tbd", "todo", "missing", "undefined", "anonymous")
#: Spellings of the partitions.
PARTITIONS = {"train": ("train", "training"), "eval": ("eval", "val", "validation", "heldout", "held_out"), "test": ("test",)}

EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
TASK_ID = r"^([^/\s]+?)__([^/\s]+)\.([0-9a-zA-Z]+)__(.+)__([^_]+)$"


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, EDGES, ""))


def _named(name: Column) -> Column:
    """``name``, or null for a stand-in."""
    return F.when(~name.isin(*PLACEHOLDERS), name)


def repository(slug: Column) -> Column:
    """``owner/name`` in lower case of a slug, URL or ssh address."""
    bare = F.regexp_replace(F.regexp_replace(_plain(slug), r"[?#].*$", ""), r"/+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.git$", ""), r"^[a-z+]+://", "")
    return _named(F.when(bare.rlike(r"[/:]"), F.regexp_extract(bare, r"([^/:]+)/([^/:]+)$", 0)).otherwise(bare))


def repository_of_task(task_id: Column) -> Column:
    """``owner/name`` of a task id that isn't opaque."""
    bare = _plain(task_id)
    return F.when(bare.rlike(TASK_ID), F.concat(F.regexp_extract(bare, TASK_ID, 1), F.lit("/"), F.regexp_extract(bare, TASK_ID, 2)))


def author_handle(author: Column) -> Column:
    """The handle that a name, a handle or a mail address stands for."""
    bare = _plain(author)
    mail = F.regexp_extract(bare, r"([^\s<>@]+)@[^\s<>@]+", 1)
    return _named(F.when(mail != "", mail).otherwise(F.regexp_replace(bare, r"^@", "")))


def partition_name(partition: Column) -> Column:
    """train, eval, test, or null."""
    bare = F.regexp_replace(F.lower(partition), r"[\s\p{Z}]+", "")
    return reduce(lambda c, kv: c.when(bare.isin(*kv[1]), kv[0]), PARTITIONS.items(), F.when(F.lit(False), ""))


def task_keys(df: DataFrame) -> DataFrame:
    """Per row the vertices it joins: at most one task, two repositories, one author."""
    task = _named(_plain(F.col("task_id")))
    keys = [
        F.concat(F.lit("t:"), task),
        F.concat(F.lit("r:"), repository(F.col("repo_slug"))),
        F.concat(F.lit("r:"), repository_of_task(F.col("task_id"))),
        F.concat(F.lit("a:"), author_handle(F.col("author"))),
    ]
    return df.select("task_row_id", partition_name(F.col("task_partition")).alias("part"), F.array_distinct(F.array_compact(F.array(*keys))).alias("keys"))


#: Rounds whose labels are unwound in one job.
UNWOUND = 3
#: One round: tails hang themselves onto a heads neighbour, and edges are rewritten onto the survivors.
_ROUND = """WITH
mates AS (SELECT src AS vertex, min(dst) AS parent FROM {now}
  WHERE bit_get(xxhash64(src, :seed), 0) = 0 AND bit_get(xxhash64(dst, :seed), 0) = 1 GROUP BY src),
moved AS (SELECT DISTINCT coalesce(a.parent, src) AS src, coalesce(b.parent, dst) AS dst FROM {now}
  LEFT JOIN mates a ON a.vertex = src LEFT JOIN mates b ON b.vertex = dst WHERE coalesce(a.parent, src) <> coalesce(b.parent, dst))
SELECT true AS hung, vertex, parent FROM mates UNION ALL SELECT false, src, dst FROM moved"""
#: The labels of later rounds carried on to what hung onto them in this one.
_UNWIND = """SELECT vertex, label FROM {labels} UNION ALL
SELECT m.vertex, coalesce(l.label, m.parent) AS label FROM {hung} m LEFT JOIN {labels} l ON l.vertex = m.parent WHERE m.hung"""


def contract(edges: DataFrame, seed: int = 17) -> DataFrame:
    """(vertex, label) of every vertex of ``edges`` (src, dst): equal labels, same component.

    Each round contracts at least a quarter of the vertices on average, so the
    rounds are logarithmic and their tables shrink geometrically. A round is
    one job, which writes its parents and the edges that remain. A vertex with
    very many neighbours is merged before each shuffle (one parent per leaf,
    distinct edges); where it is the key of a join, each of its edges meets the
    one row that names its parent, so the skew join splits them at will.
    """
    sql = edges.sparkSession.sql
    both = sql("SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e}) WHERE src <> dst", e=edges)
    now, count = cut_counted(both, left=F.count(F.lit(1)))
    empty = now.select(F.col("src").alias("vertex"), F.col("dst").alias("label"))
    hung: list[DataFrame] = []
    while count["left"]:
        # a string seed is no part of the generated code, which all rounds then share
        written, count = cut_counted(sql(_ROUND, args={"seed": str(seed + len(hung))}, now=now), left=F.count_if(~F.col("hung")))
        hung.append(written)
        now = written.where("NOT hung").select(F.col("vertex").alias("src"), F.col("parent").alias("dst"))
    labels = empty.where("false")
    for i, written in enumerate(reversed(hung), 1):
        labels = sql(_UNWIND, hung=written, labels=labels)
        if i % UNWOUND == 0:
            labels = cut(labels)
    labels = cut(labels)
    return sql("SELECT vertex, label FROM {l} UNION ALL SELECT DISTINCT label, label FROM {l}", l=labels)


def related_groups(df: DataFrame) -> DataFrame:
    """(task_row_id, part, group_row_id): the group is named by its smallest task_row_id.

    Rows with no task, repository or author are groups of their own. Null and
    stand-in keys join nothing, repeated rows share their keys, an empty table
    gives an empty result, further columns are ignored.
    """
    rows = cut(task_keys(df))
    chain = rows.where(F.size("keys") > 1).select(F.explode(F.transform(F.slice("keys", 2, 4), lambda k: F.struct(F.col("keys")[0].alias("src"), k.alias("dst")))).alias("e"))
    labels = contract(chain.select("e.src", "e.dst").distinct())
    first = rows.select("task_row_id", "part", F.when(F.size("keys") > 0, F.col("keys")[0]).alias("vertex"))
    own = F.concat(F.lit("row:"), F.col("task_row_id").cast("string"))
    labelled = first.join(labels, "vertex", "left").select("task_row_id", "part", F.coalesce("label", "vertex", own).alias("label"))
    names = labelled.groupBy("label").agg(F.min("task_row_id").alias("group_row_id"))
    return labelled.join(names, "label").select("task_row_id", "part", "group_row_id")


def split_conflicts(df: DataFrame) -> DataFrame:
    """Rows of the groups that hold two or more different partitions now."""
    groups = related_groups(df)
    torn = groups.groupBy("group_row_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("group_row_id")
    return groups.join(torn, "group_row_id").select("task_row_id", "group_row_id")


def assign_splits(df: DataFrame, targets: DataFrame) -> DataFrame:
    """(task_row_id, group_row_id, split_name) with whole groups per split.

    Groups are laid end to end by falling weight (rows), and each goes to the
    split in whose share of the line its middle lies, largest share first. Ties
    in weight are ordered by a hash of the group.
    """
    groups = cut(related_groups(df))
    weights = groups.groupBy("group_row_id").agg(F.count("*").alias("weight"))
    laid = running_total(weights.withColumn("spot", F.xxhash64("group_row_id")), [F.desc("weight"), "spot", "group_row_id"], "weight", "before")
    shares = sorted(((r.target_share, r.split_name) for r in targets.where("target_share > 0").collect()), reverse=True)
    whole, upto, name = sum(s for s, _ in shares) or 1.0, 0.0, F.when(F.lit(False), "")
    middle = (F.col("before") + F.col("weight") / 2) / max(groups.count(), 1)
    for share, split in shares[:-1]:
        upto += share / whole
        name = name.when(middle < upto, split)
    name = name.otherwise(shares[-1][1] if shares else None)
    chosen = laid.select("group_row_id", name.alias("split_name"))
    return groups.join(chosen, "group_row_id").select("task_row_id", "group_row_id", "split_name")
