"""Queries over arrays, messages and rule-bound joins, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import arrays as A
from skein.functions import coerce as C
from skein.functions import messages as M
from skein.operators import joins as J
from skein.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Per customer, in order of orders: a mask of the urgent ones and one of the finished ones.
def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    entry = F.struct("o_orderkey", (F.substring("o_orderpriority", 1, 1) <= "2").cast("int").alias("m"), (F.col("o_orderstatus") != "P").cast("int").alias("a"))
    rows = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return rows.select("o_custkey", F.transform("x", lambda e: e["m"]).alias("m"), F.transform("x", lambda e: e["a"]).alias("a"))


_MASKS = """masks AS (SELECT o_custkey, list(CAST(substr(o_orderpriority, 1, 1) <= '2' AS INT) ORDER BY o_orderkey) AS m, list(CAST(o_orderstatus <> 'P' AS INT) ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)"""


@query(f"WITH {_MASKS} SELECT o_custkey, array_to_string(list_filter(list_transform(m, lambda x, i: CASE WHEN x > 0 AND a[i] <= 0 THEN i - 1 END), lambda i: i IS NOT NULL), ',') AS broken, list_sum(list_transform(m[-8:], lambda x: x::BIGINT))::BIGINT AS valid FROM masks")
def fl07_mask_violations(spark, sf_dir):
    m = _masks(spark, sf_dir)
    return m.select("o_custkey", F.array_join(A.mask_violations(F.col("m"), F.col("a")).cast("array<string>"), ",").alias("broken"), A.valid_length(F.col("m"), 8).cast("bigint").alias("valid"))


@query(f"""WITH {_MASKS}, p AS (SELECT o_custkey, unnest(m) AS x, generate_subscripts(m, 1) - 1 AS i FROM masks), r AS (SELECT o_custkey, i, i - row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS g FROM p WHERE x > 0)
SELECT o_custkey, min(i) AS first, max(i) + 1 AS behind FROM r GROUP BY o_custkey, g""")
def pj25_runs(spark, sf_dir):
    runs = _masks(spark, sf_dir).select("o_custkey", F.explode(A.runs_of_ones(F.col("m"))).alias("r"))
    return runs.select("o_custkey", F.col("r.first").cast("bigint").alias("first"), F.col("r.behind").cast("bigint").alias("behind"))


@query(f"""WITH {_MASKS}, l AS (SELECT o_custkey, coalesce(list_max(list_transform(m, lambda x, i: CASE WHEN x > 0 THEN i - 1 ELSE -1 END)), -1) AS last FROM masks)
SELECT o_custkey, CASE WHEN last < 0 THEN 11 ELSE least(last, 11) END AS at FROM l""")
def pj37_reward_position(spark, sf_dir):
    r = A.reward_at_last(F.col("m"), F.lit(1.0), 12)
    return _masks(spark, sf_dir).select("o_custkey", (F.array_position(r, 1.0) - 1).alias("at"))


@query(f"""WITH {_MASKS} SELECT o_custkey, array_to_string(list_concat(m, a[1:greatest(16 - len(m), 0)])[1:greatest(16, len(m))], ',') AS tokens, len(a) > greatest(16 - len(m), 0) AS clipped FROM masks""")
def pj20_clipped_response(spark, sf_dir):
    m = _masks(spark, sf_dir).withColumn("c", A.clip_response(F.col("m"), F.col("a"), 16, True))
    return m.select("o_custkey", F.array_join(F.col("c.tokens").cast("array<string>"), ",").alias("tokens"), "c.clipped")


_LISTS = """lists AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS w, list_distinct(list(o_orderstatus) FILTER (o_totalprice > 200000)) AS p, list_distinct(list(o_orderstatus) FILTER (o_totalprice < 20000)) AS f FROM orders GROUP BY 1)"""


@query(f"""WITH {_LISTS} SELECT o_custkey, CAST(CASE WHEN coalesce(len(p), 0) = 0 AND coalesce(len(f), 0) = 0 THEN NULL WHEN list_has_any(w, coalesce(f, [])) THEN false ELSE list_has_all(coalesce(p, []), w) END AS VARCHAR) AS verdict,
  array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(coalesce(p, []), x))), ',') AS missing FROM lists""")
def jn10_group_verdict(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_set("o_orderstatus")).alias("w"), F.collect_set(F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus"))).alias("p"), F.collect_set(F.when(F.col("o_totalprice") < 20000, F.col("o_orderstatus"))).alias("f")
    )
    return o.select("o_custkey", A.group_verdict(F.col("w"), F.col("p"), F.col("f")).cast("string").alias("verdict"), F.array_join(A.missing_selectors(F.col("w"), F.col("p")), ",").alias("missing"))


_MESSAGES = """SELECT task_id, attempt_index, list(CASE WHEN tool_output IS NOT NULL THEN 'user' WHEN assistant_response IS NOT NULL THEN 'assistant' ELSE 'user' END ORDER BY message_id) AS roles,
  list(trim(coalesce(assistant_response, tool_output, prompt, ''), e' \\t\\n\\r\\x0b\\f') ORDER BY message_id) AS texts FROM turn_messages WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL GROUP BY ALL"""


def _messages(spark, sf_dir):
    m = table(spark, sf_dir, "turn_messages").where("task_id IS NOT NULL AND attempt_index IS NOT NULL")
    role = F.when(F.col("tool_output").isNotNull(), "tool").when(F.col("assistant_response").isNotNull(), "assistant").otherwise("user")
    entry = F.struct("message_id", role.alias("role"), F.coalesce("assistant_response", "tool_output", "prompt", F.lit("")).alias("content"))
    return m.groupBy("task_id", "attempt_index").agg(M.known_roles(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")))).alias("messages"))


@query(f"""WITH g AS ({_MESSAGES}), k AS (SELECT task_id, attempt_index, list_filter(list_zip(roles, texts), lambda z: z[2] <> '') AS z FROM g),
l AS (SELECT *, coalesce(list_max(list_transform(z, lambda x, i: CASE WHEN x[1] <> 'assistant' THEN i ELSE 0 END)), 0) AS last FROM k)
SELECT task_id, attempt_index, len(z) AS n_messages, last AS n_prompt, md5(array_to_string(list_transform(z, lambda x: x[1] || ':' || x[2]), chr(10))) AS digest FROM l""")
def pj13_chat_records(spark, sf_dir):
    g = _messages(spark, sf_dir)
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return g.select("task_id", "attempt_index", F.size("messages").cast("bigint").alias("n_messages"), F.size(M.prompt_of(F.col("messages"))).cast("bigint").alias("n_prompt"), F.md5(text).alias("digest"))


@query("""SELECT rollout_row_id, concat_ws(chr(10), '[TURN_' || coalesce(turn_index, 0) || ']', '[ASSISTANT]' || chr(10) || assistant_response, '[TOOL_RESPONSE_1]' || chr(10) || json_extract_string(tool_output, '$.stdout')) AS block
FROM rollout_rows WHERE assistant_response IS NOT NULL AND json_extract_string(tool_output, '$.stdout') IS NOT NULL""")
def pj21_turn_blocks(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows").withColumn("out", F.get_json_object("tool_output", "$.stdout")).where("assistant_response IS NOT NULL AND out IS NOT NULL")
    return r.select("rollout_row_id", M.turn_block(F.coalesce("turn_index", F.lit(0)), F.col("assistant_response"), F.array("out")).alias("block"))


_T = "trim({}, e' \\t\\n\\r\\x0b\\f')"


@query(f"""SELECT rollout_row_id, concat_ws(chr(10) || chr(10), CASE WHEN coalesce({_T.format('prompt')}, '') <> '' THEN '## Task' || chr(10) || {_T.format('prompt')} END,
  CASE WHEN coalesce({_T.format("json_extract_string(tool_output, '$.stderr')")}, '') <> '' THEN '## Errors' || chr(10) || {_T.format("json_extract_string(tool_output, '$.stderr')")} END) AS prompt FROM rollout_rows""")
def pj22_prompt_sections(spark, sf_dir):
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", M.sections(("Task", F.col("prompt")), ("Errors", F.get_json_object("tool_output", "$.stderr"))).alias("prompt"))


@query("""WITH t AS (SELECT rollout_row_id, coalesce(json_extract_string(tool_output, '$.stderr'), '') AS e, coalesce(assistant_response, '') AS a, coalesce(prompt, '') AS p FROM rollout_rows),
w AS (SELECT *, list_filter(regexp_split_to_array(e, '\\s+'), lambda x: x <> '') AS we, list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '') AS wa, list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '') AS wp FROM t),
n AS (SELECT *, greatest(len(we) + len(wa) + len(wp) - 60, 0) AS over0 FROM w), c0 AS (SELECT *, least(over0, len(we)) AS ce FROM n), c1 AS (SELECT *, least(over0 - ce, greatest(len(wa) - 16, 0)) AS ca FROM c0), c2 AS (SELECT *, least(over0 - ce - ca, greatest(len(wp) - 24, 0)) AS cp FROM c1)
SELECT rollout_row_id, CASE WHEN over0 > 0 THEN array_to_string(list_concat(list_concat(we[:len(we) - ce], wa[:len(wa) - ca]), wp[:len(wp) - cp])[:60], ' ')
  ELSE concat_ws(chr(10) || chr(10), CASE WHEN len(we) > 0 THEN e END, CASE WHEN len(wa) > 0 THEN a END, CASE WHEN len(wp) > 0 THEN p END) END AS text, over0 > 0 AS truncated FROM c2""")
def pj23_compacted_prompts(spark, sf_dir):
    parts = [("errors", F.get_json_object("tool_output", "$.stderr"), 0), ("answer", F.col("assistant_response"), 16), ("task", F.col("prompt"), 24)]
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", M.compacted(parts, 60).alias("c")).select("rollout_row_id", "c.*")


@query()
def pj36_response_payload(spark, sf_dir):
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", M.response_payload(F.col("tool_output"), 8, 8).alias("payload"))


@query("""WITH p AS (SELECT task_id, attempt_index, flatten(list(list_reverse(regexp_extract_all(tool_output, '[\\w/]+\\.py')) ORDER BY message_id DESC)) AS paths FROM turn_messages
  WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL AND regexp_matches(tool_output, '[\\w/]+\\.py') GROUP BY ALL), u AS (SELECT task_id, attempt_index, unnest(paths) AS path, generate_subscripts(paths, 1) AS i FROM p),
f AS (SELECT task_id, attempt_index, path, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task_id, attempt_index ORDER BY i) AS k FROM f)
SELECT task_id, attempt_index, string_agg(path, ',' ORDER BY k) AS paths FROM r WHERE k <= 10 GROUP BY ALL""")
def pj28_known_paths(spark, sf_dir):
    m = table(spark, sf_dir, "turn_messages").where("task_id IS NOT NULL AND attempt_index IS NOT NULL").select("task_id", "attempt_index", "message_id", F.posexplode(F.regexp_extract_all("tool_output", F.lit(r"[\w/]+\.py"), F.lit(0))).alias("at", "path"))
    # only the last place of each path counts, so a path comes once from any number of messages
    m = m.groupBy("task_id", "attempt_index", "path").agg(F.max(F.struct("message_id", "at")).alias("last"))
    g = m.groupBy("task_id", "attempt_index").agg(F.sort_array(F.collect_list(F.struct("last", "path"))).alias("x"))
    return g.select("task_id", "attempt_index", F.array_join(M.known_paths(F.transform("x", lambda e: e["path"])), ",").alias("paths"))


@query("""SELECT rollout_row_id, CASE WHEN contains(tool_output, '"stdout": "') AND contains(substr(tool_output, instr(tool_output, '"stdout": "') + 11), '", "stderr"') THEN string_split(substr(tool_output, instr(tool_output, '"stdout": "') + 11), '", "stderr"')[1] END AS block FROM rollout_rows""")
def pj40_tagged_block(spark, sf_dir):
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", M.tagged_block(F.col("tool_output"), '"stdout": "', '", "stderr"').alias("block"))


@query("""SELECT t.task_row_id, coalesce(b.band, 'unbanded') AS band, CASE WHEN b.band IS NULL THEN 'default' ELSE 'label' END AS band_source FROM task_rows t
LEFT JOIN (SELECT task_id, min(difficulty_band) AS band FROM rollout_rows WHERE difficulty_band IS NOT NULL AND task_id IS NOT NULL GROUP BY 1) b USING (task_id)""")
def jn04_label_join(spark, sf_dir):
    bands = table(spark, sf_dir, "rollout_rows").where("difficulty_band IS NOT NULL AND task_id IS NOT NULL").groupBy("task_id").agg(F.min("difficulty_band").alias("band"))
    return J.labelled(table(spark, sf_dir, "task_rows").select("task_row_id", "task_id"), bands, "task_id", "band", "unbanded").select("task_row_id", "band", "band_source")


@query("""SELECT t.task_id, t.place, count(*) AS n FROM (SELECT task_id, min(task_row_id) AS place FROM task_rows WHERE task_id IS NOT NULL GROUP BY 1) t JOIN rollout_rows r ON r.task_id = t.task_id GROUP BY ALL""")
def jn08_ordered_records(spark, sf_dir):
    tasks = table(spark, sf_dir, "task_rows").where("task_id IS NOT NULL").groupBy("task_id").agg(F.min("task_row_id").alias("place"))
    records = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL").groupBy("task_id").agg(F.count("*").alias("n"))
    return J.ordered_records(tasks, records, "task_id", "place")


@query("""SELECT r.rollout_row_id, r.stage, r.exit_code, k.original_length, k.cache_schema_version FROM rollout_rows r JOIN token_cache k ON k.cache_row_id = r.rollout_row_id""")
def jn01_merge_by_row(spark, sf_dir):
    """Rollouts and token records by row number; both have task_id, and the rollout's wins."""
    r = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", "task_id", "stage", "exit_code")
    k = table(spark, sf_dir, "token_cache").select(F.col("cache_row_id").alias("rollout_row_id"), "task_id", "original_length", "cache_schema_version")
    return J.merge_by_row(r, k, "rollout_row_id").drop("task_id")


@query("""WITH k AS (SELECT DISTINCT user_id FROM events ORDER BY sha256('7|' || user_id), user_id LIMIT 20) SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM k)""")
def sl14_hashed_sample(spark, sf_dir):
    return J.hashed_sample(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", 7, 20)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sf08_json_lookup(spark, sf_dir):
    entries = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", C.coerce_int(A.lookup(entries, "K"), F.lit(None).cast("bigint")).alias("k"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'easy' WHEN p_retailprice > 1500 THEN 'hard' ELSE 'mid' END AS band FROM part WHERE p_brand IN ('Brand#13') OR p_brand LIKE 'Brand#2%' OR p_name LIKE '%a%'""")
def sf35_allowed(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(A.metric_allowed(F.col("p_brand"), ["Brand#13"], ["Brand#2"], []) | A.metric_allowed(F.col("p_name"), [], [], ["a"]))
    return p.select("p_partkey", F.when(F.col("p_size") < 10, "easy").when(F.col("p_retailprice") > 1500, "hard").otherwise("mid").alias("band"))


@query("""SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def jn00_star_join(spark, sf_dir):
    asia = table(spark, sf_dir, "region").where("r_name = 'ASIA'").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(asia), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    l = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("l_suppkey")
    return l.agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count("*").alias("n"), (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("price"))
