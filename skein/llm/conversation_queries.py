"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import conversations as C
from skein.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.broken_conversations(table(spark, sf_dir, "turn_messages"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.rebuild_conversations(table(spark, sf_dir, "turn_messages"))
    texts = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(": "), m.text)), "\n")
    return rows.select("task_id", "attempt_index", F.size("messages").cast("bigint").alias("n_messages"), F.md5(texts).alias("transcript_md5"))


def p1_clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clock_offsets(C.reply_constraints(C.distinct_messages(C.tidy_messages(table(spark, sf_dir, "turn_messages")))))


QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p1_clock_offsets)}


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_ROLE = " ".join(f"WHEN lower(regexp_replace(speaker, '{C.EDGES}', '', 'g')) IN ({_in(names)}) THEN '{role}'" for role, names in C.SPEAKERS.items())
_TIDY = f"""
named AS (SELECT *, CASE {_ROLE} WHEN assistant_response IS NOT NULL THEN 'assistant' WHEN tool_output IS NOT NULL THEN 'tool' ELSE 'user' END AS role
  FROM turn_messages WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL),
picked AS (SELECT *, CASE role WHEN 'assistant' THEN assistant_response WHEN 'tool' THEN tool_output ELSE prompt END AS raw FROM named),
tidy AS (SELECT task_id, attempt_index, turn_index, role,
  CASE WHEN length(regexp_replace(raw, '{C.EMPTY}', '', 'g')) > 0 THEN regexp_replace(raw, '{C.EDGES}', '', 'g') END AS text FROM picked),
turns AS (SELECT task_id, attempt_index, turn_index, count(*) FILTER (role <> 'system') AS spoken,
  count(DISTINCT role || ':' || text) FILTER (role IN ('user', 'tool')) AS incoming,
  count(DISTINCT text) FILTER (role = 'assistant') AS replies FROM tidy GROUP BY ALL),
judged AS (SELECT task_id, attempt_index, count(*) FILTER (spoken > 0) AS n, max(turn_index) FILTER (spoken > 0) AS last,
  count(*) FILTER (spoken > 0 AND (incoming <> 1 OR replies <> 1 OR turn_index IS NULL OR turn_index < 0)) AS open_ends FROM turns GROUP BY ALL)
"""
ORACLE = {
    "p1_found": f"WITH {_TIDY} SELECT task_id, attempt_index FROM judged WHERE NOT coalesce(n > 0 AND last = n - 1 AND open_ends = 0, false)",
    "p1_conversations": f"""WITH {_TIDY},
once AS (SELECT DISTINCT task_id, attempt_index, turn_index, role, text, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 2 ELSE 1 END AS rank
  FROM tidy JOIN judged USING (task_id, attempt_index) WHERE text IS NOT NULL AND n > 0 AND last = n - 1 AND open_ends = 0)
SELECT task_id, attempt_index, count(*) AS n_messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn_index, rank)) AS transcript_md5
FROM once GROUP BY task_id, attempt_index""",
    "p1_clock_offsets": f"""WITH {_TIDY.replace("SELECT task_id, attempt_index, turn_index, role,", "SELECT task_id, attempt_index, turn_index, role, epoch_us(collected_at) AS us,", 1)},
timed AS (SELECT task_id, attempt_index, turn_index, bool_or(role <> 'system') AS spoken, min(role) FILTER (text IS NOT NULL AND role IN ('user', 'tool')) AS sender,
  min(us) FILTER (text IS NOT NULL AND role IN ('user', 'tool')) AS asked, min(us) FILTER (text IS NOT NULL AND role = 'assistant') AS replied FROM tidy GROUP BY ALL HAVING spoken),
slack AS (SELECT *, replied - asked AS rs, asked - lag(replied) OVER (PARTITION BY task_id, attempt_index ORDER BY turn_index NULLS FIRST) AS sl FROM timed),
per AS (SELECT task_id, attempt_index, sender, count(rs)::DOUBLE AS r, count(sl)::DOUBLE AS a, coalesce(sum(rs), 0)::DOUBLE AS rr, coalesce(sum(sl), 0)::DOUBLE AS aa, min(rs) AS upper, max(-sl) AS lower
  FROM slack WHERE sender IS NOT NULL GROUP BY ALL),
gaps AS (SELECT task_id, attempt_index, sum(CASE WHEN r + a > 0 THEN rr + aa - (r - a) * (rr - aa) / (r + a) END) / nullif(sum(CASE WHEN r + a > 0 THEN 4 * r * a / (r + a) END), 0) AS g FROM per GROUP BY ALL)
SELECT task_id, attempt_index, sender, (r + a)::BIGINT AS edges, coalesce(CASE WHEN r + a > 0 THEN round((rr - aa - (r - a) * g) / (r + a)) END, 0)::BIGINT AS offset_us, round(g)::BIGINT AS gap_us,
  coalesce(lower <= upper, true) AS feasible FROM per JOIN gaps USING (task_id, attempt_index)""",
}
