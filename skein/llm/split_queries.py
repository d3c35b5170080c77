"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import splits as S
from skein.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_conflicts(table(spark, sf_dir, "task_rows"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.related_groups(table(spark, sf_dir, "task_rows")).select("task_row_id", "group_row_id")


def p4_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assign_splits(table(spark, sf_dir, "task_rows"), table(spark, sf_dir, "split_targets"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the assignment reaches."""
    got = p4_assigned(spark, sf_dir).groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_distinct("group_row_id").alias("n_groups"))
    targets = table(spark, sf_dir, "split_targets").join(got, "split_name", "left").fillna(0, ["n_rows", "n_groups"])
    total = table(spark, sf_dir, "task_rows").count()
    return targets.select("split_name", "target_share", "n_rows", "n_groups", (F.col("n_rows") / max(total, 1)).alias("actual_share"))


QUERIES = {f.__name__: f for f in (p4_found, p4_groups, p4_assigned, p4_shares)}

_NONE = ", ".join(f"'{p}'" for p in S.PLACEHOLDERS)


def _plain(column: str) -> str:
    return f"lower(regexp_replace({column}, '{S.EDGES}', '', 'g'))"


_PART = " ".join("WHEN bare IN (" + ", ".join(f"'{n}'" for n in names) + f") THEN '{part}'" for part, names in S.PARTITIONS.items())
_GROUPS = f"""
plain AS (SELECT task_row_id, {_plain("task_id")} AS t, {_plain("author")} AS a,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace({_plain("repo_slug")}, '[?#].*$', ''), '/+$', ''), '\\.git$', ''), '^[a-z+]+://', '') AS r,
  regexp_replace(lower(task_partition), '[\\s\\p{{Z}}]+', '', 'g') AS bare FROM task_rows),
named AS (SELECT task_row_id, CASE {_PART} END AS part, t,
  CASE WHEN regexp_matches(r, '[/:]') THEN regexp_extract(r, '([^/:]+)/([^/:]+)$', 0) ELSE r END AS r,
  CASE WHEN regexp_matches(t, '{S.TASK_ID}') THEN regexp_extract(t, '{S.TASK_ID}', 1) || '/' || regexp_extract(t, '{S.TASK_ID}', 2) END AS tr,
  CASE WHEN regexp_matches(a, '[^\\s<>@]+@[^\\s<>@]+') THEN regexp_extract(a, '([^\\s<>@]+)@[^\\s<>@]+', 1) ELSE regexp_replace(a, '^@', '') END AS a FROM plain),
keys AS (SELECT task_row_id, 't:' || t AS k FROM named WHERE t NOT IN ({_NONE}) UNION SELECT task_row_id, 'r:' || r FROM named WHERE r NOT IN ({_NONE})
  UNION SELECT task_row_id, 'r:' || tr FROM named WHERE tr IS NOT NULL UNION SELECT task_row_id, 'a:' || a FROM named WHERE a NOT IN ({_NONE})),
reach(k, b) AS (SELECT k, min(task_row_id) FROM keys GROUP BY k UNION
  SELECT y.k, r.b FROM reach r JOIN keys x ON x.k = r.k JOIN keys y ON y.task_row_id = x.task_row_id AND y.k <> x.k),
low AS (SELECT k, min(b) AS b FROM reach GROUP BY k),
groups AS (SELECT n.task_row_id, any_value(n.part) AS part, coalesce(min(low.b), n.task_row_id) AS group_row_id
  FROM named n LEFT JOIN keys USING (task_row_id) LEFT JOIN low USING (k) GROUP BY n.task_row_id)
"""
ORACLE = {
    "p4_groups": f"WITH RECURSIVE {_GROUPS} SELECT task_row_id, group_row_id FROM groups",
    "p4_found": f"""WITH RECURSIVE {_GROUPS} SELECT task_row_id, group_row_id FROM groups
WHERE group_row_id IN (SELECT group_row_id FROM groups GROUP BY 1 HAVING count(DISTINCT part) > 1)""",
}
