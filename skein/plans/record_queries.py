"""Queries over trajectories, task rows, batches and steps, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import messages as M
from skein.functions import toolcalls as TC
from skein.operators import gates as G
from skein.operators import records as R
from skein.plans.core_queries import _TASKS as TASKS
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


_BLANK = "e' \\t\\n\\r\\x0b\\f'"


# Sound turns of this data hold JSON calls, whose words SQL can count as rendered: their JSON parts are separated by ", " and ": ".
@query("""WITH t AS (SELECT message_id, coalesce(assistant_response, '') AS t FROM turn_messages)
SELECT message_id, contains(t, '<tool_call>') AS has_call, len(regexp_extract_all(t, '(?s)<tool_call>(.*?)</tool_call>', 1)) > 0 AND NOT contains(regexp_replace(t, '(?s)<tool_call>.*?</tool_call>', '', 'g'), '<tool_call>') AS closed FROM t""")
def pj02_closed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parser finds every opened call of a turn closed."""
    m = table(spark, sf_dir, "turn_messages").select("message_id", TC.turn_column(F.col("assistant_response"), 99).alias("p"), F.coalesce("assistant_response", F.lit("")).contains("<tool_call>").alias("has_call"))
    unclosed = F.coalesce(F.col("p.error").contains("isn't closed") | (F.col("p.error") == "no tool call"), F.lit(False))
    return m.select("message_id", "has_call", (F.col("has_call") & ~unclosed).alias("closed"))


_TOOLS = ", ".join(f"'{t}'" for t in (*TC.TOOLS, *TC.RENAMED))
# A call as rendered has a blank after each ":" and "," between its parts and those within its texts.
_RENDERED = """replace(replace(replace(regexp_replace(regexp_replace(body, '"\\s*:\\s*', '": ', 'g'), '([\\]}"\\d])\\s*,\\s*"', '\\1, "', 'g'), '{ ', '{'), ' }', '}'), '\\n', chr(92) || 'n')"""


@query(f"""WITH m AS (SELECT message_id, coalesce(assistant_response, '') AS t FROM turn_messages), b AS (SELECT message_id, unnest(regexp_extract_all(t, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS body FROM m),
c AS (SELECT message_id, count(*) AS n, bool_and(json_valid(body) AND lower(trim(coalesce(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.tool') END, ''))) IN ({_TOOLS})) AS json, sum(len(regexp_split_to_array({_RENDERED}, '\\s+'))) AS words, bool_or(contains(body, '"submit"')) AS submits FROM b GROUP BY 1)
SELECT m.message_id, coalesce(n, 0)::INT AS n_calls, words::INT AS action_tokens FROM m JOIN c USING (message_id) WHERE json AND n BETWEEN 1 AND 4 AND NOT (submits AND n > 1) AND NOT contains(t, '<think>')
  AND len(string_split(t, '<tool_call>')) - 1 = n""")
def pj08_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound turns without thoughts: their calls and trained words, of the whole preprocessing."""
    r = R.preprocess(table(spark, sf_dir, "turn_messages").select("message_id", "prompt", "assistant_response", "tool_output"), 4)
    sound = r.where(F.col("parse_error").isNull() & ~F.coalesce("assistant_response", F.lit("")).contains("<think>"))
    return sound.select("message_id", F.size("tool_calls").alias("n_calls"), "action_tokens")


@query()
def pj08_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.preprocess(table(spark, sf_dir, "turn_messages").select("message_id", "prompt", "assistant_response", "tool_output"), 4)
    return r.select("message_id", "tool_calls", "token_labels", *(f"action_mask_{s}" for s in R.STAGES), "parse_error", "validation_errors", "format_valid", "feedback.self_contained")


_TYPED = f"""WITH {TASKS}, t AS (SELECT task_row_id, trim(image_name, {_BLANK}) AS image_name, coalesce(trim(problem_statement, {_BLANK}), '') = '' AS blank, problem_statement, f, p FROM tasks),
e AS (SELECT *, CASE WHEN coalesce(image_name, '') = '' THEN 'no image' WHEN len(f) = 0 THEN 'no fail_to_pass' WHEN len(p) = 0 THEN 'no pass_to_pass' WHEN len(f) > len(list_distinct(f)) THEN 'repeated fail_to_pass'
  WHEN len(p) > len(list_distinct(p)) THEN 'repeated pass_to_pass' WHEN list_has_any(f, p) THEN 'overlap' END AS error FROM t)"""


@query(f"{_TYPED} SELECT task_row_id, image_name, CASE WHEN blank THEN 'targets' ELSE 'statement' END AS prompt_source, len(f)::INT AS n_fail, len(p)::INT AS n_pass, error FROM e")
def pj15_task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.task_rows(table(spark, sf_dir, "task_rows"), "pytest")
    return t.select("task_row_id", "image_name", "prompt_source", F.size("fail_to_pass").alias("n_fail"), F.size("pass_to_pass").alias("n_pass"), "error")


@query(f"""SELECT coalesce(trim(image_name, {_BLANK}), '') = '' AS no_image, coalesce(trim(problem_statement, {_BLANK}), '') = '' AS blank_statement, count(*) AS n FROM task_rows GROUP BY ALL""")
def pj15_task_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.task_rows(table(spark, sf_dir, "task_rows"), "pytest")
    return t.groupBy(F.coalesce(F.col("error") == "no image", F.lit(False)).alias("no_image"), (F.col("prompt_source") == "targets").alias("blank_statement")).agg(F.count("*").alias("n"))


@query(f"{_TYPED} SELECT task_row_id, 'user' AS role, trim(problem_statement, {_BLANK}) AS content, image_name, array_to_string(f, ',') AS fail_to_pass FROM e WHERE error IS NULL AND NOT blank AND length(trim(problem_statement, {_BLANK})) < 600")
def pj14_nested_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the statements that stand in the table; those made of targets are pj15's."""
    t = R.task_rows(table(spark, sf_dir, "task_rows"), "pytest").where("prompt_source = 'statement'")
    got = R.nested_task_rows(t, "task_row_id", 600)
    return got.select("task_row_id", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ground_truth.image_name", F.array_join("ground_truth.fail_to_pass", ",").alias("fail_to_pass"))


@query(f"SELECT task_row_id FROM task_rows WHERE lower(trim(task_partition, {_BLANK})) IN ('eval', 'val', 'validation', 'heldout', 'held_out', 'test')")
def sl05_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.partition_rows(table(spark, sf_dir, "task_rows"), "task_partition", " Validation ").select("task_row_id")


@query("SELECT task_row_id, task_id FROM task_rows ORDER BY task_row_id LIMIT 50")
def sl13_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_rows(table(spark, sf_dir, "task_rows"), "task_row_id", 50).select("task_row_id", "task_id")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as columnar batches, one per task: parallel arrays in order of the rows."""
    r = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL")
    rows = r.groupBy("task_id", "step_index").agg(F.sort_array(F.collect_list(F.struct("rollout_row_id", "exit_code", "assistant_response"))).alias("x"))
    return rows.select("task_id", "step_index", *(F.col(f"x.{c}").alias(c) for c in ("rollout_row_id", "exit_code", "assistant_response")))


@query("SELECT task_id, step_index, (row_number() OVER (PARTITION BY task_id, step_index ORDER BY rollout_row_id) - 1)::INT AS row, rollout_row_id, exit_code FROM rollout_rows WHERE task_id IS NOT NULL")
def pj16_flattened_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flatten_batch(_batches(spark, sf_dir), ["rollout_row_id", "exit_code"], ["task_id", "step_index"])


@query(f"""SELECT task_id, step_index, coalesce(arg_max(assistant_response, rollout_row_id) FILTER (trim(coalesce(assistant_response, ''), {_BLANK}) <> ''), 'none') AS final_turn FROM rollout_rows WHERE task_id IS NOT NULL GROUP BY ALL""")
def pj16_final_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("task_id", "step_index", R.final_turn(F.col("assistant_response"), F.lit("none")).alias("final_turn"))


@query("SELECT task_id, step_index, (row_number() OVER (PARTITION BY task_id, step_index ORDER BY rollout_row_id) - 1)::INT AS place, rollout_row_id, exit_code FROM rollout_rows WHERE task_id IS NOT NULL")
def st01_flattened_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL").groupBy("task_id", "step_index").agg(F.sort_array(F.collect_list(F.struct("rollout_row_id", "exit_code"))).alias("steps"))
    return R.flatten_steps(steps, ["task_id"], "step_index", "steps")


_TASK = "zeneleya__local-column.8fc32a27__lm_modify__e8272"


@query(f"SELECT rollout_row_id FROM rollout_rows WHERE trim(coalesce(task_id, ''), {_BLANK}) IN ('{_TASK}', '')")
def fl10_rows_of_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rows_for_task(table(spark, sf_dir, "rollout_rows"), _TASK, _TASK).select("rollout_row_id")


@query("""WITH m AS (SELECT task_id, attempt_index, turn_index, CASE WHEN assistant_response IS NOT NULL THEN 'assistant' WHEN tool_output IS NOT NULL THEN 'tool' ELSE 'user' END AS role, coalesce(assistant_response, tool_output, prompt, '') AS t
  FROM turn_messages WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL),
w AS (SELECT *, len(regexp_split_to_array(trim(t, e' \\t\\n\\r\\x0b\\f'), '\\s+')) AS words FROM m)
SELECT task_id, attempt_index, count(*) FILTER (role = 'assistant') AS n_turns, coalesce(sum(words) FILTER (role = 'assistant'), 0)::BIGINT AS n_words, count(*) FILTER (role = 'tool') AS n_blocks, coalesce(bool_or(words > 60) FILTER (role = 'assistant'), false) AS capped FROM w GROUP BY ALL""")
def pj41_attempt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "turn_messages").where("task_id IS NOT NULL AND attempt_index IS NOT NULL")
    role = F.when(F.col("assistant_response").isNotNull(), "assistant").when(F.col("tool_output").isNotNull(), "tool").otherwise("user")
    text = F.coalesce("assistant_response", "tool_output", "prompt", F.lit(""))
    got = R.attempt_records(m.select("task_id", "attempt_index", "turn_index", role.alias("role"), text.alias("text")), ["task_id", "attempt_index"], F.lit(60))
    total = F.aggregate("turn_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return got.select("task_id", "attempt_index", F.size("assistant_turns").cast("bigint").alias("n_turns"), total.alias("n_words"), F.size("tool_blocks").cast("bigint").alias("n_blocks"), "capped")


@query("""SELECT avg(coalesce(CASE WHEN loss_token_count IS NOT NULL THEN greatest(loss_token_count % 17, 0) END, CASE WHEN sequence_length IS NOT NULL THEN greatest(sequence_length % 13, 0) END, original_length)) AS mean_length FROM token_cache""")
def ag08_generation_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over masks and labels as long as the recorded counts tell, each with what it doesn't count."""
    k = table(spark, sf_dir, "token_cache")
    n_mask, n_label = F.greatest(F.col("loss_token_count") % 17, F.lit(0)), F.greatest(F.col("sequence_length") % 13, F.lit(0))
    mask = F.when(F.col("loss_token_count").isNotNull(), F.concat(F.array_repeat(F.lit(0), 3), F.array_repeat(F.lit(1), n_mask)))
    labels = F.when(F.col("sequence_length").isNotNull(), F.concat(F.array_repeat(F.lit(-100), 2), F.array_repeat(F.lit(7), n_label)))
    return k.agg(F.avg(R.generation_length(mask, labels, F.col("original_length"))).alias("mean_length"))


@query("""WITH x AS (SELECT cache_row_id, greatest(coalesce(sequence_length, 0) % 9, 0) AS w, greatest(coalesce(loss_token_count, 0) % 9, 0) AS m FROM token_cache) SELECT cache_row_id, least(m, greatest(w - 1, 0))::INT AS active, w::INT AS width FROM x""")
def pj38_turn_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "token_cache")
    w, m = F.greatest(F.coalesce("sequence_length", F.lit(0)) % 9, F.lit(0)), F.greatest(F.coalesce("loss_token_count", F.lit(0)) % 9, F.lit(0))
    # the response's last token isn't trained
    response = F.slice(F.concat(F.array_repeat(F.lit(1), F.greatest(w - 1, F.lit(0))), F.array(F.lit(0))), F.lit(1), w)
    masks = R.turn_masks(F.array(F.array_repeat(F.lit(1), m)), response)
    got = k.select("cache_row_id", masks[0].alias("mask"))
    return got.select("cache_row_id", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("active"), F.size("mask").alias("width"))


@query("""WITH s AS (SELECT user_id, unnest(['train', 'val']) AS series, event_id AS step, value FROM events WHERE event_type <> 'error'), l AS (SELECT user_id, series, step, round(value * CASE series WHEN 'train' THEN 1 ELSE 2 END, 3) AS loss FROM s)
SELECT user_id, series, count(*) AS n, arg_min(loss, step) AS first, arg_max(loss, step) AS last, min(loss) AS least, min(step) FILTER (loss = least_loss) AS least_step, arg_max(loss, step) - arg_min(loss, step) AS delta
FROM (SELECT *, min(loss) OVER (PARTITION BY user_id, series) AS least_loss FROM l) GROUP BY ALL""")
def sf37_loss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses read back from log lines made of the events."""
    e = table(spark, sf_dir, "events")
    number = lambda k: F.round(F.col("value") * k, 3).cast("decimal(18,3)").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("worker lost: "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("[run] step:"), F.col("event_id").cast("string"), F.lit(" - train/loss:"), number(1), F.lit(" - val/loss:"), number(2)))
    return R.loss_series(e.select("user_id", line.alias("line")), "line", ["user_id"])


@query("""WITH m AS (SELECT message_id, prompt, assistant_response, tool_output FROM turn_messages)
SELECT message_id, CASE WHEN trim(coalesce(assistant_response, ''), e' \\t\\n\\r') <> '' THEN assistant_response WHEN trim(coalesce(tool_output, '') || coalesce(prompt, ''), e' \\t\\n\\r') <> '' THEN trim(coalesce(tool_output, '') || coalesce(prompt, ''), e' \\t\\n\\r') END AS content FROM m""")
def pj18_completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion payloads made of the messages: a content string, or parts where there is none."""
    m = table(spark, sf_dir, "turn_messages")
    part = lambda c: F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part("tool_output"), part("prompt")).alias("content")).alias("message"))).alias("choices")))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct("assistant_response").withField("content", F.col("assistant_response")).dropFields("assistant_response").alias("message"))).alias("choices")))
    blank = F.coalesce(F.regexp_replace("assistant_response", r"^[ \t\n\r]+", ""), F.lit("")) == ""
    return m.select("message_id", M.completion_text(F.when(blank, parts).otherwise(whole)).alias("content"))


@query("""WITH m AS (SELECT message_id, trim(coalesce(prompt, ''), e' \\t\\n\\r\\x0b\\f') AS u, trim(coalesce(assistant_response, ''), e' \\t\\n\\r\\x0b\\f') AS a FROM turn_messages)
SELECT message_id, concat_ws('|', 'system:Follow the contract.', CASE WHEN u <> '' THEN 'user:' || u END, CASE WHEN a <> '' THEN 'assistant:' || a END, CASE WHEN a <> '' OR u = '' THEN 'user:Go on.' END) AS text FROM m""")
def pj19_loop_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "turn_messages")
    raw = F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")) for role, c in (("user", "prompt"), ("assistant", "assistant_response"))))
    got = M.loop_messages(raw, "Follow the contract.", "Go on.")
    return m.select("message_id", F.array_join(F.transform(got, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("text"))


@query("""SELECT rollout_row_id, concat_ws(chr(10), 'Verifier feedback:', CASE WHEN verifier_status = 'missing' THEN 'No verifier tests were configured for this task.' WHEN verifier_status = 'invalid' THEN 'The final verifier did not complete cleanly, so the attempt is not verified as passing all required tests.'
    WHEN resolved THEN 'All required verifier tests passed.' WHEN NOT resolved THEN 'Not all required verifier tests passed.' END,
  CASE WHEN contains(assistant_response, '<tool_call>') THEN CASE WHEN contains(assistant_response, '</tool_call>') THEN 'The student made a valid final submit call.' ELSE 'The student made a final submit call, but its format was invalid.' END
    WHEN assistant_response IS NOT NULL THEN 'The student did not make a final submit call.' END,
  CASE WHEN verifier_status = 'invalid' THEN 'Verifier error: invalid run' END) AS text FROM rollout_rows WHERE verifier_status IN ('missing', 'invalid') OR resolved IS NOT NULL OR assistant_response IS NOT NULL
UNION ALL SELECT rollout_row_id, '' FROM rollout_rows WHERE NOT (coalesce(verifier_status IN ('missing', 'invalid'), false) OR resolved IS NOT NULL OR assistant_response IS NOT NULL)""")
def pj26_verifier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows")
    status, said = F.col("verifier_status"), F.col("assistant_response")
    text = G.verifier_text(status == "missing", F.when(status == "invalid", "invalid run"), F.col("resolved"), said.contains("<tool_call>"), said.contains("</tool_call>"), F.lit(None).cast("string"), "Verifier feedback:")
    return r.select("rollout_row_id", text.alias("text"))


@query(f"""WITH t AS (SELECT task_row_id, coalesce(task_id, '') || chr(0) || coalesce(task_family, '') || chr(0) || coalesce(image_name, '') || chr(0) || coalesce(problem_statement, '') || chr(0) || chr(1) || chr(2) AS x FROM task_rows)
SELECT count(*) AS n, sha256(string_agg(x, '' ORDER BY task_row_id)) AS digest FROM t""")
def sf30_pool_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return G.pool_fingerprint(table(spark, sf_dir, "task_rows").withColumns({"f": none, "p": none}), "task_row_id", ["task_id", "task_family", "image_name", "problem_statement"], ["f", "p"])


_SPOKEN = """SELECT message_id, task_id, attempt_index, turn_index, CASE WHEN assistant_response IS NOT NULL THEN 'assistant' WHEN tool_output IS NOT NULL THEN 'tool' ELSE 'user' END AS role, coalesce(assistant_response, tool_output, prompt) AS t
  FROM turn_messages WHERE task_id IS NOT NULL AND attempt_index IS NOT NULL"""


@query(f"""WITH m AS ({_SPOKEN}), w AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY task_id, attempt_index ORDER BY turn_index NULLS FIRST, message_id ROWS UNBOUNDED PRECEDING) - 1 AS turn FROM m)
SELECT task_id, attempt_index, turn::BIGINT AS turn, md5(max(t) FILTER (role = 'assistant')) AS said_md5, md5(coalesce(string_agg(t, '|' ORDER BY turn_index NULLS FIRST, message_id) FILTER (role = 'tool'), '')) AS blocks_md5 FROM w WHERE turn >= 0 GROUP BY task_id, attempt_index, turn""")
def pj30_turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "turn_messages").where("task_id IS NOT NULL AND attempt_index IS NOT NULL")
    role = F.when(F.col("assistant_response").isNotNull(), "assistant").when(F.col("tool_output").isNotNull(), "tool").otherwise("user")
    rows = m.select("task_id", "attempt_index", F.struct("turn_index", "message_id").alias("place"), role.alias("role"), F.coalesce("assistant_response", "tool_output", "prompt").alias("t"))
    got = R.turn_blocks(rows, ["task_id", "attempt_index"], "place", "role", "t")
    return got.select("task_id", "attempt_index", "turn", F.md5("assistant").alias("said_md5"), F.md5(F.array_join("blocks", "|")).alias("blocks_md5"))


@query(f"""SELECT rollout_row_id, coalesce(trim(json_extract_string(tool_output, '$.stdout'), {_BLANK}) <> '', false) OR coalesce(trim(json_extract_string(tool_output, '$.stderr'), {_BLANK}) <> '', false)
  OR coalesce(json_extract_string(tool_output, '$.exit_code') <> '0', false) OR coalesce(contains(assistant_response, '<tool_call>'), false) AS signal FROM rollout_rows""")
def pj27_feedback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.regexp_extract_all("assistant_response", F.lit("<tool_call>"), F.lit(0))
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", R.feedback_signal(F.col("tool_output"), blocks).alias("signal"))


@query("""SELECT 'task_id' AS kind, task_id AS value, min(rollout_row_id) AS first FROM rollout_rows WHERE task_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'image_name', image_name, min(rollout_row_id) FROM rollout_rows WHERE image_name IS NOT NULL GROUP BY 2
UNION ALL SELECT 'pair', task_id || '|' || image_name, min(rollout_row_id) FROM rollout_rows WHERE task_id IS NOT NULL AND image_name IS NOT NULL GROUP BY 2""")
def ag05_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows").withColumn("pair", F.concat("task_id", F.lit("|"), "image_name"))
    return R.first_seen(r, ["task_id", "image_name", "pair"], "rollout_row_id")


_HIST = lambda c: f"(SELECT step_index, string_agg(v || ':' || n, ',' ORDER BY v) AS h FROM (SELECT step_index, coalesce({c}, 'none') AS v, count(*) AS n FROM rollout_rows GROUP BY ALL) GROUP BY 1)"


@query(f"""WITH p AS (SELECT step_index, count(*) AS n, count(*) FILTER (resolved) AS selected, count(*) FILTER (stage = 'turn_sdpo') AS held_out, count(*) FILTER (stage = 'turn_sdpo' AND resolved) AS held_out_selected,
  avg(len(regexp_split_to_array(trim(assistant_response, {_BLANK}), '\\s+'))) AS mean_words FROM rollout_rows GROUP BY 1)
SELECT p.*, f.h AS task_family_counts, b.h AS difficulty_band_counts FROM p JOIN {_HIST("task_family")} f ON f.step_index IS NOT DISTINCT FROM p.step_index JOIN {_HIST("difficulty_band")} b ON b.step_index IS NOT DISTINCT FROM p.step_index""")
def ag07_step_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.step_report(table(spark, sf_dir, "rollout_rows"), "step_index", F.col("resolved"), F.col("stage") == "turn_sdpo", "assistant_response", ["task_family", "difficulty_band"])


@query("""SELECT rollout_row_id, CASE WHEN tool_output IS NOT NULL THEN json_extract_string(tool_output, '$.exit_code') ELSE exit_code::VARCHAR END AS exit_code, stage, CASE WHEN tool_output IS NOT NULL THEN 4 ELSE 2 END AS n_keys FROM rollout_rows""")
def jn11_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded fields, overridden by those of the tool's output."""
    merged = R.merged_map(F.create_map(F.lit("exit_code"), F.col("exit_code").cast("string"), F.lit("stage"), F.col("stage")), F.from_json("tool_output", "map<string,string>"))
    got = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", merged.alias("m"))
    return got.select("rollout_row_id", F.col("m")["exit_code"].alias("exit_code"), F.col("m")["stage"].alias("stage"), F.size("m").alias("n_keys"))


@query("""SELECT task_id, attempt_index, bool_and(coalesce(exit_code = 0, false)) AND coalesce(bool_or(contains(assistant_response, '<tool_call>')), false) AS resolved FROM rollout_rows WHERE task_id IS NOT NULL GROUP BY ALL""")
def ux04_resolved_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL")
    # collect_list leaves nulls out, so they travel as -1
    per = r.groupBy("task_id", "attempt_index").agg(F.collect_list(F.coalesce("exit_code", F.lit(-1))).alias("codes"), F.bool_or(F.col("assistant_response").contains("<tool_call>")).alias("terminal"))
    return per.select("task_id", "attempt_index", R.attempt_resolved(F.col("terminal"), F.col("codes")).alias("resolved"))


@query(f"""SELECT message_id, concat_ws(chr(10), nullif(trim(prompt, {_BLANK}), ''), nullif(trim(assistant_response, {_BLANK}), ''), 'end') AS text FROM turn_messages""")
def sf33_content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lists of text parts and a scalar, read as text."""
    part = lambda c: F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("text")))
    content = F.concat(F.lit("["), part("prompt"), F.lit(","), part("assistant_response"), F.lit(',"end"]'))
    return table(spark, sf_dir, "turn_messages").select("message_id", M.content_text(content).alias("text"))


@query(f"""SELECT rollout_row_id, 'system:Rules.|user:' || coalesce(prompt, '') || '|' || CASE WHEN json_valid(tool_output) THEN 'user:Tool response:' || chr(10) || tool_output ELSE 'tool:<tool_response>' || coalesce(tool_output, '') || '</tool_response>' END AS text FROM rollout_rows""")
def pj17_generation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("<tool_response>"), F.coalesce("tool_output", F.lit("")), F.lit("</tool_response>"))
    got = M.generation_messages(F.lit("Rules."), F.coalesce("prompt", F.lit("")), F.array(F.struct(F.lit("tool").alias("role"), block.alias("content"))))
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", F.array_join(F.transform(got, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("text"))


@query("""SELECT * FROM (VALUES ('bash', 'command', 'str', true, NULL), ('bash', 'cwd', 'str', false, NULL), ('bash', 'timeout_sec', 'int', false, NULL), ('read', 'path', 'str', true, NULL), ('read', 'start_line', 'int', false, NULL), ('read', 'end_line', 'int', false, NULL),
  ('submit', 'final_response', 'str', true, NULL), ('submit', 'changed_paths', 'list', false, 'item')) AS t(tool, name, kind, required, item)""")
def pj07_xml_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(tool, *arg) for tool in ("bash", "read", "submit") for arg in TC.xml_schema(tool)], "tool string, name string, kind string, required boolean, item string")
