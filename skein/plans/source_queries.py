"""Round trips through every source and sink, and coercions, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import coerce as C
from skein.functions import toolcalls as TC
from skein.functions import tokens as K
from skein.operators import gates as G
from skein.operators import pool as P
from skein.session import cut, shared_folder, table
from skein.sources import commits, io

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, ending: str = "") -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}{ending}"


@query("SELECT task_row_id, task_id, problem_statement FROM task_rows")
def sc03_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written as JSON lines and read again."""
    where, rows = _place(spark), table(spark, sf_dir, "task_rows").select("task_row_id", "task_id", "problem_statement")
    io.write_jsonl(rows, where)
    return io.read_rows(spark, where, rows.schema)


@query("SELECT n, n_rows FROM (SELECT count(*) AS n_rows FROM task_rows), (SELECT 2 AS n)")
def sc07_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken lines are left out and counted."""
    where, rows = _place(spark), table(spark, sf_dir, "task_rows").select("task_row_id")
    broken = spark.createDataFrame([("{broken",), ("[1]",)], "value string")
    rows.select(F.to_json(F.struct("task_row_id")).alias("value")).union(broken).write.text(where)
    read = io.read_rows(spark, where, "task_row_id long").where("task_row_id IS NOT NULL")
    return spark.createDataFrame([(io.malformed(spark, where), read.count())], "n int, n_rows long")


@query("SELECT DISTINCT task_id AS name, 'task' AS kind FROM rollout_rows WHERE exit_code = 2 AND trim(task_id) <> '' UNION SELECT DISTINCT image_name, 'image' FROM rollout_rows WHERE exit_code = 2 AND trim(image_name) <> ''")
def sc04_bad_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _place(spark, ".json")
    r = table(spark, sf_dir, "rollout_rows")
    status = F.when(F.col("exit_code") == 2, "bad").otherwise("ok")
    # one document per task and image: a document of all records would be one row
    doc = r.groupBy("task_id", "image_name").agg(F.collect_set(F.struct("task_id", "image_name", status.alias("status"))).alias("records"))
    doc.select("records").write.json(where)
    tasks, images = io.read_bad_tasks(spark, where, documents="lines")
    return tasks.select(F.col("task_id").alias("name"), F.lit("task").alias("kind")).union(images.select("image_name", F.lit("image")))


@query("SELECT task_id, min(difficulty_band) AS band FROM rollout_rows WHERE task_id IS NOT NULL AND difficulty_band IS NOT NULL GROUP BY 1")
def sc05_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _place(spark, ".jsonl")
    bands = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL AND difficulty_band IS NOT NULL").groupBy("task_id").agg(F.min("difficulty_band").alias("band"))
    io.write_jsonl(bands, where)
    return io.read_bands(spark, where)


@query("SELECT rollout_row_id, stage, exit_code FROM rollout_rows")
def sc08_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _place(spark, ".parquet")
    io.write_parquet(table(spark, sf_dir, "rollout_rows").select("rollout_row_id", "stage", "exit_code"), where)
    return io.read_rows(spark, where)


@query("""SELECT message_id, 'assistant' AS role, assistant_response AS content FROM turn_messages WHERE assistant_response IS NOT NULL""")
def sc09_chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records with nested messages, written as Parquet and read again."""
    where = _place(spark, ".parquet")
    m = table(spark, sf_dir, "turn_messages").where("assistant_response IS NOT NULL")
    io.write_parquet(m.select("message_id", F.array(F.struct(F.lit("assistant").alias("role"), F.col("assistant_response").alias("content"))).alias("messages")), where)
    return io.read_rows(spark, where).select("message_id", F.inline("messages"))


@query("SELECT cache_row_id, original_length, 9 AS cache_schema_version, 'f9' AS cache_fingerprint FROM token_cache WHERE original_length > 0")
def sc10_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records stamped with version and fingerprint, written and read under that version only."""
    where = _place(spark, ".parquet")
    commits.write_token_cache(table(spark, sf_dir, "token_cache").where("original_length > 0"), where, 9, "f9")
    return io.read_token_cache(spark, [where], 9, "f9").select("cache_row_id", F.col("original_length"), "cache_schema_version", "cache_fingerprint")


@query("SELECT 'rollout_rows' AS name, count(*)::BIGINT AS n FROM rollout_rows")
def sc13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _place(spark, ".json")
    io.write_manifest(spark, where, {"name": "rollout_rows", "n": table(spark, sf_dir, "rollout_rows").count()})
    return spark.read.schema("name string, n long").json(where)


@query("SELECT step::INT AS step, n FROM (SELECT unnest([0, 1, 2]) AS step), (SELECT count(*) AS n FROM token_cache)")
def in02_committed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three committed steps and a dirty fourth, which is dropped and doesn't count."""
    steps = commits.Steps(spark, _place(spark), "format_rft")
    k = table(spark, sf_dir, "token_cache").select("cache_row_id")
    for i in range(3):
        steps.write(i, k)
    k.write.parquet(steps.path(3))
    steps.drop_dirty(3)
    return steps.read().groupBy(F.col("step").cast("int").alias("step")).agg(F.count("*").alias("n"))


@query("""SELECT rollout_row_id, CASE WHEN turn_index IS NULL THEN -1 WHEN turn_index >= 0 THEN turn_index END::BIGINT AS step, turn_index < 0 AS broken FROM rollout_rows""")
def sf04_step_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = C.step_index(F.col("turn_index").cast("string"), F.lit(-1).cast("bigint"))
    r = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", "turn_index", step.alias("s"))
    return r.select("rollout_row_id", F.col("s.value").alias("step"), F.when(F.col("turn_index").isNotNull(), F.col("s.error").isNotNull()).alias("broken"))


@query("""SELECT rollout_row_id, CASE rollout_row_id % 4 WHEN 0 THEN exit_code WHEN 1 THEN CASE WHEN resolved THEN 1 WHEN NOT resolved THEN 0 END WHEN 2 THEN exit_code END::BIGINT AS code FROM rollout_rows""")
def sf05_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes as whole numbers, truth values, fractions without rest, and words."""
    kind = F.col("rollout_row_id") % 4
    raw = F.when(kind == 0, F.col("exit_code").cast("string")).when(kind == 1, F.col("resolved").cast("string")).when(kind == 2, F.concat(F.col("exit_code").cast("string"), F.lit(".0"))).otherwise(F.lit("failed"))
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", C.exit_code(raw).alias("code"))


@query("""SELECT task_row_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(fail_to_pass, '^\\["|"\\]$', '', 'g'), '", "'), lambda x: trim(x, e' \\t\\n\\r')), lambda x: x <> ''))), '|') AS targets
FROM task_rows WHERE starts_with(fail_to_pass, '["') AND ends_with(fail_to_pass, '"]')""")
def sf07_target_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_rows").where(F.col("fail_to_pass").startswith('["') & F.col("fail_to_pass").endswith('"]'))
    return t.select("task_row_id", F.array_join(F.array_sort(C.target_set(F.col("fail_to_pass"))), "|").alias("targets"))


@query("""WITH t AS (SELECT message_id, lower(trim(speaker, e' \\t\\n\\r\\x0b\\f')) AS w, CASE message_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'insert' END AS c FROM turn_messages)
SELECT message_id, NULL::VARCHAR AS canonical, CASE message_id % 5 WHEN 0 THEN 'bash' WHEN 1 THEN CASE c WHEN 'view' THEN 'read' WHEN 'insert' THEN 'apply_patch' END WHEN 2 THEN 'submit' END AS outside FROM t""")
def sf09_tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers are no tools; outside tools by name and command."""
    m = table(spark, sf_dir, "turn_messages")
    k = F.col("message_id") % 5
    name = F.when(k == 0, " BASH ").when(k == 1, "str_replace_editor").when(k == 2, "Answer").otherwise("other")
    command = F.when(F.col("message_id") % 3 == 0, "view").when(F.col("message_id") % 3 == 1, "insert")
    return m.select("message_id", F.when(C.canonical_tool(F.col("speaker")) != "submit", C.canonical_tool(F.col("speaker"))).alias("canonical"), C.external_tool(name, command).alias("outside"))


@query("""WITH x AS (SELECT task_id, string_agg(DISTINCT trim(author, e' \\t\\n\\r\\x0b\\f'), ',' ORDER BY trim(author, e' \\t\\n\\r\\x0b\\f')) AS authors FROM task_rows WHERE task_id IS NOT NULL AND trim(author, e' \\t\\n\\r\\x0b\\f') <> '' GROUP BY 1) SELECT task_id, authors FROM x""")
def sf24_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_rows").where("task_id IS NOT NULL").groupBy("task_id").agg(F.collect_list("author").alias("a"))
    return t.select("task_id", F.array_join(F.array_sort(C.unique_in_order(F.col("a"))), ",").alias("authors")).where("authors <> ''")


@query("""SELECT sha256('{"files":{},"settings":{"least":1,"name":"x"}}') AS digest""")
def sf29_settings_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(K.fingerprint({"name": "x", "least": 1}),)], "digest string")


@query("""SELECT rollout_row_id, latency_ms AS latency, coalesce(stage, '') AS stage FROM rollout_rows WHERE latency_ms IS NOT NULL""")
def sf34_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of text as numbers where all of them are, else as text."""
    r = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", F.col("latency_ms").cast("string").alias("latency"), "stage")
    return G.typed_column(G.typed_column(r, "latency"), "stage").where(~F.isnan("latency"))


@query("""SELECT message_id, assistant_response AS payload, NULL::VARCHAR AS error FROM turn_messages WHERE assistant_response = trim(assistant_response, e' \\t\\n\\r\\x0b\\f') AND assistant_response <> '' AND message_id % 3 = 0
UNION ALL SELECT message_id, NULL, CASE message_id % 3 WHEN 1 THEN 'turn isn''t closed' ELSE 'text after the turn' END FROM turn_messages WHERE assistant_response = trim(assistant_response, e' \\t\\n\\r\\x0b\\f') AND assistant_response <> '' AND message_id % 3 <> 0""")
def pj01_chat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers framed as chat turns: whole, unclosed, and with text behind."""
    said = F.col("assistant_response")
    m = table(spark, sf_dir, "turn_messages").where((said == C.strip(said)) & (said != ""))
    k = F.col("message_id") % 3
    framed = F.concat(F.lit("<|im_start|>assistant\n"), said, F.when(k == 0, "<|im_end|>").when(k == 1, "").otherwise("<|im_end|> more"))
    return m.select("message_id", TC.chatml_payload(framed).alias("x")).select("message_id", "x.*")


@query("""SELECT p_partkey, 'read' AS tool, p_name AS path FROM part WHERE trim(p_name) <> ''""")
def pj06_rendered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls rendered as XML and parsed again."""
    path = F.concat(F.lit("<tool_call><tool>read</tool><args><path><![CDATA["), F.col("p_name"), F.lit("]]></path></args></tool_call>"))
    p = table(spark, sf_dir, "part").where("trim(p_name) <> ''").select("p_partkey", TC.turn_column(path, 1, "xml").alias("t"))
    return p.select("p_partkey", F.col("t.tools")[0].alias("tool"), F.get_json_object(F.col("t.calls")[0], "$.args.path").alias("path"))


@query("""WITH n AS (SELECT task_family, count(*) AS n FROM task_rows GROUP BY 1) SELECT task_family, n, CASE WHEN n < 8 THEN NULL ELSE least(greatest(60, 8), n) // 8 * 8 END::INT AS batch FROM n""")
def fl11_effective_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch size that each family's rows allow; a family list is small, its sizes come to the driver."""
    sizes = table(spark, sf_dir, "task_rows").groupBy("task_family").agg(F.count("*").alias("n")).collect()
    return spark.createDataFrame([(r.task_family, r.n, P.effective_batch(r.n, 60, 8)) for r in sizes], "task_family string, n long, batch int")


@query("""SELECT task_row_id FROM task_rows WHERE task_row_id NOT IN (SELECT task_row_id FROM task_rows ORDER BY task_row_id DESC LIMIT 100) AND NOT coalesce(lower(trim(task_partition)) = 'test', false)""")
def wn06_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the last hundred tasks may go, those of the test partition never."""
    t = table(spark, sf_dir, "task_rows").select("task_row_id", "task_partition")
    return P.retention(t, "task_row_id", 100, F.coalesce(F.lower(F.trim("task_partition")) == "test", F.lit(False))).select("task_row_id")


@query("SELECT count(DISTINCT task_id) AS n FROM task_rows WHERE task_id IS NOT NULL")
def in03_same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored set of keys is checked against the table before it is used."""
    now = table(spark, sf_dir, "task_rows").where("task_id IS NOT NULL").select("task_id").distinct()
    stored = cut(now)
    G.same_key_set(stored, now, "task_id")
    return stored.agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('t1', 'pytest', 'easy'), ('t2', NULL, 'easy'), ('t3', 'pytest', 'hard')) AS t(task_id, kind, band)")
def sc02_replayed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list in memory with defaults for keys that are absent."""
    return io.replayed(spark, [{"task_id": "t1"}, {"task_id": "t2", "kind": None}, {"task_id": "t3", "band": "hard"}], "task_id string, kind string, band string", {"kind": "pytest", "band": "easy"})


@query("SELECT event_type, 2 * count(*) AS n, 2 * count(value) AS n_values FROM events GROUP BY 1")
def sc12_appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric log appended to twice."""
    where, e = _place(spark), table(spark, sf_dir, "events").select("event_type", "value")
    for _ in range(2):
        io.append_jsonl(e, where)
    return io.read_rows(spark, where, e.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


@query("SELECT count(DISTINCT task_id) AS done, count(DISTINCT task_id) + 1 AS expected, 'partial' AS status FROM task_rows WHERE task_id IS NOT NULL")
def sc14_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records added in two overlapping runs, with the header of the second."""
    where, t = _place(spark), table(spark, sf_dir, "task_rows").where("task_id IS NOT NULL").select("task_id")
    expected = t.distinct().count() + 1
    commits.append_progress(t.where(F.length("task_id") % 2 == 0), "task_id", where, expected)
    header = commits.append_progress(t, "task_id", where, expected)
    return spark.createDataFrame([(header["done"], header["expected"], header["status"])], "done long, expected long, status string")
