"""Queries over the nested records of ``raw_turns``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.nested import FREE_TEXT, nested_nodes, node_table
from skein.session import table

COLUMNS = ["action_envelope", "tool_output"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_nodes(table(spark, sf_dir, "raw_turns"), COLUMNS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("record_id", "column_name", "node_path")


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


def p5_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(_nodes(spark, sf_dir), "edits", {"path": "path"})


def p5_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(_nodes(spark, sf_dir), "hunks", {"start": "start", "old": "old", "new": "new"})


def p5_test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(_nodes(spark, sf_dir), "results", {"name": "name", "status": "status"})


QUERIES = {f.__name__: f for f in (p5_found, p5_nodes, p5_edits, p5_hunks, p5_test_results)}
ORACLE: dict[str, str] = {}

# The same by SQL: a walk over all values for the kinds that keys hold, then a walk that reads every value as its key's kind.
_FREE = ", ".join(f"'{k}'" for k in sorted(FREE_TEXT))
_CHILDREN = """unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'key': k, 'i': NULL::BIGINT, 'x': json_extract(v, '$."' || k || '"')})
    WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {'key': NULL::VARCHAR, 'i': i, 'x': json_extract(v, '$[' || i || ']')}) END, max_depth := 1) AS c"""
_HELD = "CASE WHEN json_type(x) = 'VARCHAR' AND left(ltrim(x ->> '$'), 1) IN ('[', '{') AND json_valid(x ->> '$') THEN CAST(x ->> '$' AS JSON) END"
_NODES_SQL = f"""WITH RECURSIVE base AS (SELECT record_id, 'action_envelope' AS col, action_envelope AS t FROM raw_turns UNION SELECT record_id, 'tool_output', tool_output FROM raw_turns),
root AS (SELECT record_id, col, CAST(t AS JSON) AS v FROM base WHERE json_valid(t)),
walk(key, bit, v) AS (SELECT NULL::VARCHAR, 0, v FROM root UNION
  SELECT key, CASE WHEN json_type(x) = 'ARRAY' THEN 1 WHEN json_type(x) = 'OBJECT' THEN 2 ELSE 0 END, CASE WHEN json_type(x) IN ('ARRAY', 'OBJECT') THEN x ELSE {_HELD} END
  FROM (SELECT c.key AS key, c.x AS x FROM (SELECT {_CHILDREN} FROM walk WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
  WHERE json_type(x) IN ('ARRAY', 'OBJECT') OR (key IS NOT NULL AND key NOT IN ({_FREE}) AND json_type(x) = 'VARCHAR')),
kinds AS (SELECT map_from_entries(list((key, bits))) AS km FROM (SELECT key, bit_or(bit) AS bits FROM walk WHERE key IS NOT NULL AND key NOT IN ({_FREE}) GROUP BY key HAVING bit_or(bit) > 0)),
nodes(record_id, col, path, parent, tbl, i, key, element, v) AS (SELECT record_id, col, '', NULL::VARCHAR, '', NULL::BIGINT, NULL::VARCHAR, false, v FROM root UNION ALL
  SELECT record_id, col, path, parent, tbl, i, key, element, CASE WHEN NOT element AND json_type(y) = 'OBJECT' AND known & 1 = 1 THEN json_array(y) ELSE y END FROM (
    SELECT *, CASE WHEN json_type(x) <> 'VARCHAR' OR held IS NULL THEN x WHEN element THEN CASE WHEN known & 1 = 1 AND json_type(held) = 'OBJECT' THEN held ELSE x END
      WHEN known = 0 OR (json_type(held) = 'ARRAY' AND known & 1 = 0) THEN x ELSE held END AS y FROM (
      SELECT record_id, col, CASE WHEN c.key IS NULL THEN path || '[' || c.i || ']' WHEN path = '' THEN c.key ELSE path || '.' || c.key END AS path, CASE WHEN was_node THEN path ELSE parent END AS parent, coalesce(c.key, tbl) AS tbl, c.i AS i, c.key AS key, c.key IS NULL AS element, c.x AS x,
        coalesce(km[coalesce(c.key, up)], 0) AS known, {_HELD.replace("x ->>", "c.x ->>").replace("json_type(x)", "json_type(c.x)")} AS held
      FROM (SELECT record_id, col, path, parent, tbl, element AND json_type(v) = 'OBJECT' AS was_node, key AS up, km, {_CHILDREN} FROM nodes, kinds WHERE json_type(v) IN ('OBJECT', 'ARRAY'))))
  WHERE json_type(y) IN ('OBJECT', 'ARRAY')),
found AS (SELECT DISTINCT record_id, col AS column_name, path AS node_path, parent AS parent_path, tbl AS table_name, i::INT AS position, v FROM nodes WHERE element AND json_type(v) = 'OBJECT')"""


def _table_sql(name: str, *fields: str) -> str:
    picked = "".join(f", v ->> '{f}' AS {f}" for f in fields)
    return f"{_NODES_SQL} SELECT record_id, column_name, node_path, parent_path, position{picked} FROM found WHERE table_name = '{name}'"


ORACLE |= {
    "p5_found": f"{_NODES_SQL} SELECT record_id, column_name, node_path FROM found",
    "p5_edits": _table_sql("edits", "path"),
    "p5_hunks": _table_sql("hunks", "start", "old", "new"),
    "p5_test_results": _table_sql("results", "name", "status"),
}
