"""Queries of the core operators over the supplied tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import coerce as C
from skein.functions import text as X
from skein.functions import toolcalls as TC
from skein.operators import pool as P
from skein.operators import records as R
from skein.operators import selection as S
from skein.operators.running import exact_quantile
from skein.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Rollouts as the selection reads them, from the recorded columns.
def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rollout_rows")
    text = F.coalesce("assistant_response", F.lit(""))
    return r.select(
        "rollout_row_id", "task_id", "attempt_index", "turn_index", "step_index", "resolved", "exit_code", "task_family", "difficulty_band", "stage", "latency_ms", "verifier_status", "image_name",
        F.col("container_id").isNotNull().alias("container_ok"), (F.coalesce("verifier_status", F.lit("")) == "invalid").alias("infra_invalid"), F.lit(None).cast("string").alias("invalid_reason"),
        text.contains("</tool_call>").alias("has_submit"), (F.coalesce(F.length("assistant_response"), F.lit(0)) > 40).alias("format_ok"), F.get_json_object("tool_output", "$.stderr").alias("executor_error"), F.length(text).alias("n_tokens"),
    )


_ATTEMPTS = """
attempts AS (SELECT rollout_row_id, task_id, attempt_index, turn_index, step_index, resolved, exit_code, task_family, difficulty_band, stage, latency_ms, verifier_status, image_name,
  container_id IS NOT NULL AS container_ok, coalesce(verifier_status, '') = 'invalid' AS infra_invalid, contains(coalesce(assistant_response, ''), '</tool_call>') AS has_submit,
  coalesce(length(assistant_response), 0) > 40 AS format_ok, json_extract_string(tool_output, '$.stderr') AS executor_error, length(coalesce(assistant_response, '')) AS n_tokens FROM rollout_rows),
judged AS (SELECT *, nullif(concat_ws(',', CASE WHEN NOT container_ok THEN 'container_init_failed' END, CASE WHEN infra_invalid THEN 'infra_invalid' END, CASE WHEN NOT has_submit THEN 'non_terminal' END,
  CASE WHEN NOT format_ok THEN 'format_invalid' END, CASE WHEN NOT coalesce(resolved, false) THEN 'unresolved' END, CASE WHEN coalesce(exit_code, 0) <> 0 THEN 'nonzero_exit_code' END,
  CASE WHEN trim(coalesce(executor_error, '')) <> '' THEN 'executor_error' END), '') AS reasons FROM attempts),
lenient AS (SELECT *, nullif(concat_ws(',', CASE WHEN NOT container_ok THEN 'container_init_failed' END, CASE WHEN infra_invalid THEN 'infra_invalid' END, CASE WHEN NOT format_ok THEN 'format_invalid' END), '') AS why0 FROM attempts),
cutoff AS (SELECT *, CASE WHEN why0 IS NULL AND n_tokens > 400 THEN 'over_length' ELSE why0 END AS why FROM lenient)
"""
_STRICT = S.Policy(terminal=True, format_valid=True, resolved=True, zero_exit=True, errors=("executor_error",))


def _lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.partition_by_length(S.select_rows(_attempts(spark, sf_dir), S.STAGE_POLICIES["format_rft"]), "n_tokens", 400)


@query(f"WITH {_ATTEMPTS} SELECT rollout_row_id, reasons IS NULL AS selected, CASE WHEN reasons IS NULL THEN 'accept' ELSE 'reject' END AS label, reasons FROM judged")
def fl01_selection(spark, sf_dir):
    return S.select_rows(_attempts(spark, sf_dir), _STRICT).select("rollout_row_id", "selected", "label", "reasons")


@query(f"WITH {_ATTEMPTS} SELECT rollout_row_id, why IS NULL AS selected, why AS reasons FROM cutoff")
def fl03_length_partition(spark, sf_dir):
    return _lenient(spark, sf_dir).select("rollout_row_id", "selected", "reasons")


@query("SELECT coalesce(nullif(trim(task_family), ''), 'unknown') AS name, count(*) AS n FROM rollout_rows GROUP BY 1")
def ag02_count_by_field(spark, sf_dir):
    return S.count_by(table(spark, sf_dir, "rollout_rows"), "task_family", "unknown")


@query(f"WITH {_ATTEMPTS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM judged WHERE reasons IS NOT NULL) GROUP BY 1")
def ag03_reason_counts(spark, sf_dir):
    return S.reason_counts(S.select_rows(_attempts(spark, sf_dir), _STRICT))


@query(f"""WITH {_ATTEMPTS}, per AS (SELECT task_id, count(*) AS rollouts, count(*) FILTER (coalesce(resolved, false)) AS n_resolved, count(*) FILTER (why IS NULL) AS n_selected,
  count(*) FILTER (why = 'over_length') AS n_over_length, count(*) FILTER (infra_invalid) AS n_invalid FROM cutoff GROUP BY 1)
SELECT *, CASE WHEN n_selected = 0 THEN 'near_impossible' WHEN n_selected >= greatest(1, ceil(rollouts * 0.75)) THEN 'easy' ELSE 'learnable' END AS band FROM per""")
def ag04_band_records(spark, sf_dir):
    return S.band_records(_lenient(spark, sf_dir))


@query("""SELECT count(DISTINCT task_id) AS tasks, count(DISTINCT image_name) AS images, count(DISTINCT (task_id, attempt_index)) FILTER (task_id IS NOT NULL AND attempt_index IS NOT NULL) AS attempts,
  CAST(sum(coalesce(step_index, 0) + 1) AS BIGINT) AS steps, count(*) AS n_rows FROM rollout_rows""")
def ag05_artifact_summary(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows")
    return r.agg(F.count_distinct("task_id").alias("tasks"), F.count_distinct("image_name").alias("images"), F.count_distinct("task_id", "attempt_index").alias("attempts"), F.sum((F.coalesce("step_index", F.lit(0)) + 1).cast("bigint")).alias("steps"), F.count("*").alias("n_rows"))


@query(f"""WITH {_ATTEMPTS}, x AS (SELECT why IS NULL AS selected, coalesce(task_family, 'unknown') AS family, coalesce(difficulty_band, 'unbanded') AS band FROM cutoff)
SELECT selected, 'family' AS kind, family AS name, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT selected, 'band', band, count(*) FROM x GROUP BY ALL""")
def ag06_manifest(spark, sf_dir):
    return S.manifest_counts(_lenient(spark, sf_dir))


@query(f"WITH {_ATTEMPTS} SELECT avg(CAST(has_submit AS DOUBLE)) AS has_submit, avg(CAST(format_ok AS DOUBLE)) AS format_ok, avg(CAST(coalesce(resolved, false) AS DOUBLE)) AS resolved FROM attempts")
def ag01_format_rates(spark, sf_dir):
    return S.format_rates(_attempts(spark, sf_dir), ["has_submit", "format_ok", "resolved"])


_PAIRS = """pairs AS (SELECT task_id, attempt_index, coalesce(s.r, 0.0) AS student, coalesce(t.r, 0.0) AS teacher, coalesce(t.r, 0.0) - coalesce(s.r, 0.0) AS delta, t.r IS NULL AS teacher_missing
  FROM (SELECT task_id, attempt_index, arg_min(CAST(coalesce(resolved, false) AS DOUBLE), rollout_row_id) AS r FROM rollout_rows WHERE stage = 'format_rft' AND task_id IS NOT NULL AND attempt_index IS NOT NULL GROUP BY ALL) s
  FULL JOIN (SELECT task_id, attempt_index, arg_min(CAST(coalesce(resolved, false) AS DOUBLE), rollout_row_id) AS r FROM rollout_rows WHERE stage = 'turn_sdpo' AND task_id IS NOT NULL AND attempt_index IS NOT NULL GROUP BY ALL) t USING (task_id, attempt_index))"""


def _pairs(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL AND attempt_index IS NOT NULL")
    r = r.select("task_id", "attempt_index", "stage", F.col("rollout_row_id").alias("row_index"), F.coalesce("resolved", F.lit(False)).cast("double").alias("reward"))
    return S.pair_rewards(r.where("stage = 'format_rft'"), r.where("stage = 'turn_sdpo'"), ["task_id", "attempt_index"], "reward")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def jn06_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"""WITH {_PAIRS} SELECT count(*) AS n, avg(student) AS student_mean, avg(teacher) AS teacher_mean, avg(delta) AS delta_mean, count(*) FILTER (delta > 0) AS improved,
  count(*) FILTER (delta < 0) AS worsened, count(*) FILTER (delta = 0) AS tied FROM pairs""")
def ag09_pair_summary(spark, sf_dir):
    return S.pair_summary(_pairs(spark, sf_dir))


@query("""WITH s AS (SELECT CAST(sum(sequence_length) AS BIGINT) AS total, CAST(sum(original_length) AS BIGINT) AS useful, CAST(sum(loss_token_count) AS BIGINT) AS loss FROM token_cache)
SELECT total, useful, loss, CAST(useful AS DOUBLE) / total AS useful_ratio, CAST(loss AS DOUBLE) / useful AS loss_ratio FROM s""")
def ag11_token_profile(spark, sf_dir):
    return S.token_profile(table(spark, sf_dir, "token_cache"), "sequence_length", "original_length", "loss_token_count")


@query("SELECT user_id % 16 AS grp, quantile_cont(value, 0.8) AS threshold, max(value) AS most, count(value) AS n FROM events GROUP BY 1")
def ag12_quantiles(spark, sf_dir):
    return exact_quantile(table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 16), "value", 0.8, "grp")


@query("""WITH v AS (SELECT value / 25 AS v FROM events), q AS (SELECT quantile_cont(v, 0.8) AS threshold FROM v)
SELECT avg(v) AS mean, max(v) AS most, count(*) FILTER (v < 1) AS below_1, count(*) FILTER (v >= 1 AND v < 2) AS from_1, count(*) FILTER (v >= 2 AND v < 4) AS from_2, count(*) FILTER (v >= 4) AS from_4,
  avg(CAST(v > threshold AS DOUBLE)) AS high_share, min(threshold) AS threshold FROM v, q WHERE v IS NOT NULL""")
def ag13_entropy_histogram(spark, sf_dir):
    return S.entropy_histogram(table(spark, sf_dir, "events").select((F.col("value") / 25).alias("v")), "v")


@query("""SELECT task_family, sum(latency_ms * (step_index + 1)) FILTER (latency_ms IS NOT NULL) / sum(step_index + 1) FILTER (latency_ms IS NOT NULL) AS mean,
  CAST(sum(step_index + 1) FILTER (latency_ms IS NOT NULL) AS BIGINT) AS weight, max(latency_ms) AS most FROM rollout_rows GROUP BY 1""")
def ag14_weighted_means(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows").withColumn("w", F.col("step_index") + 1)
    return S.weighted_means(r, "task_family", "latency_ms", "w")


@query("""WITH f AS (SELECT task_id, image_name, coalesce(exit_code, 0) = 2 AND coalesce(verifier_status, '') = 'invalid' AS task_bad, coalesce(latency_ms, 0) > 2000 AND coalesce(verifier_status, '') = 'invalid' AS image_bad FROM rollout_rows WHERE task_id IS NOT NULL)
SELECT task_id, min(why) AS why FROM (SELECT task_id, 'task' AS why FROM f WHERE task_bad UNION ALL SELECT task_id, 'image' FROM f WHERE image_name IN (SELECT image_name FROM f WHERE image_bad)) GROUP BY 1""")
def ag15_bad_rollup(spark, sf_dir):
    invalid = F.coalesce("verifier_status", F.lit("")) == "invalid"
    r = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL")
    return S.bad_rollup(r.withColumns({"task_bad": (F.coalesce("exit_code", F.lit(0)) == 2) & invalid, "image_bad": (F.coalesce("latency_ms", F.lit(0)) > 2000) & invalid}))


@query("SELECT task_family, count(DISTINCT image_name) AS images FROM rollout_rows GROUP BY 1")
def ag18_distinct_images(spark, sf_dir):
    return table(spark, sf_dir, "rollout_rows").groupBy("task_family").agg(F.count_distinct("image_name").alias("images"))


_TARGETS = {c: f"""list_filter(list_transform(CASE WHEN trim({c}, e' \\t\\n\\r') LIKE '[%]' THEN json_extract_string(trim({c}, e' \\t\\n\\r'), '$[*]') WHEN contains({c}, ',') THEN string_split(trim({c}, e' \\t\\n\\r'), ',') WHEN {c} IS NULL THEN [] ELSE string_split(trim({c}, e' \\t\\n\\r'), chr(10)) END,
  lambda x: trim(x, e' \\t\\n\\r')), lambda x: x IS NOT NULL AND x <> '')""" for c in ("fail_to_pass", "pass_to_pass")}
_TASKS = f"""tasks AS (SELECT *, {_TARGETS["fail_to_pass"]} AS f, {_TARGETS["pass_to_pass"]} AS p FROM task_rows)"""


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "task_rows").withColumns({"f": C.target_list(F.col("fail_to_pass")), "p": C.target_list(F.col("pass_to_pass"))})


@query(f"WITH {_TASKS} SELECT task_row_id, array_to_string(f, '|') AS fail, array_to_string(p, '|') AS passing, len(f) AS n_fail, len(p) AS n_pass FROM tasks")
def sf06_targets(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_row_id", F.array_join("f", "|").alias("fail"), F.array_join("p", "|").alias("passing"), F.size("f").cast("bigint").alias("n_fail"), F.size("p").cast("bigint").alias("n_pass"))


@query(f"""WITH {_TASKS} SELECT task_row_id, CASE WHEN len(f) = 0 THEN 'no fail_to_pass' WHEN len(p) = 0 THEN 'no pass_to_pass' WHEN len(f) > len(list_distinct(f)) THEN 'repeated fail_to_pass'
  WHEN len(p) > len(list_distinct(p)) THEN 'repeated pass_to_pass' WHEN list_has_any(f, p) THEN 'overlap' END AS error, len(list_intersect(f, p)) AS n_common FROM tasks""")
def sf22_target_errors(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_row_id", X.target_error(F.col("f"), F.col("p")).alias("error"), F.size(F.array_intersect("f", "p")).cast("bigint").alias("n_common"))


_IDENTITY = """sha256(concat_ws(chr(1), coalesce(trim(lower(regexp_replace(problem_statement, '[ \\t\\n\\r]+', ' ', 'g')), ' '), ''), array_to_string(list_sort(f), chr(2)), array_to_string(list_sort(p), chr(2)), 'pytest'))"""


@query(f"WITH {_TASKS} SELECT task_row_id, {_IDENTITY} AS identity FROM tasks")
def sf21_identity(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_row_id", X.identity_key(F.col("problem_statement"), F.col("f"), F.col("p"), "pytest").alias("identity"))


@query(f"""WITH {_TASKS} SELECT task_row_id, coalesce(nullif(trim(problem_statement, e' \\t\\n\\r'), ''), 'pytest task: must pass ' || array_to_string(f[1:4], ', ') || CASE WHEN len(f) > 4 THEN ' (+' || (len(f) - 4) || ' more)' ELSE '' END
  || '; must keep ' || array_to_string(p[1:4], ', ') || CASE WHEN len(p) > 4 THEN ' (+' || (len(p) - 4) || ' more)' ELSE '' END) AS statement FROM tasks""")
def sf20_statement(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_row_id", X.statement_or_fallback(F.col("problem_statement"), F.col("f"), F.col("p"), "pytest task").alias("statement"))


@query(f"""WITH {_TASKS} SELECT task_row_id, CASE WHEN len(f) = 0 THEN '^$' ELSE '^(?:' || array_to_string(list_transform(f, lambda x: regexp_replace(x, '([.^$*+?()\\[\\]{{}}|\\\\-])', '\\\\\\1', 'g')), '|') || ')$' END AS pattern FROM tasks""")
def sf23_go_test_regex(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_row_id", X.go_test_regex(F.col("f")).alias("pattern"))


@query("""SELECT task_row_id, coalesce(nullif(trim(task_family), ''), CASE WHEN contains(string_split(task_id, '.')[-1], '__') THEN nullif(string_split(string_split(task_id, '.')[-1], '__')[2], '') END, 'unknown') AS family,
  coalesce(nullif(trim(task_id), ''), 'tasks:' || task_row_id) AS resolved_id, coalesce(nullif(regexp_replace(regexp_replace(image_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'image') AS slug FROM task_rows""")
def sf26_task_names(spark, sf_dir):
    t = table(spark, sf_dir, "task_rows")
    return t.select("task_row_id", C.family_of_task(F.col("task_id"), F.col("task_family")).alias("family"), C.resolved_task_id(F.col("task_id"), F.lit(None).cast("string"), "tasks", F.col("task_row_id")).alias("resolved_id"), C.file_slug(F.col("image_name"), "image").alias("slug"))


@query("""SELECT rollout_row_id, CASE lower(trim(CAST(exit_code AS VARCHAR))) WHEN '1' THEN true WHEN '0' THEN false ELSE coalesce(resolved, false) END AS flag,
  CAST(CASE WHEN lower(trim(verifier_status)) IN ('1','true','t','yes','y','on','pass','passed','success','resolved') THEN true WHEN lower(trim(verifier_status)) IN ('0','false','f','no','n','off','fail','failed','error','unresolved') THEN false END AS VARCHAR) AS verdict,
  coalesce(CASE WHEN regexp_matches(trim(CAST(latency_ms AS VARCHAR)), '^[+-]?\\d{1,18}(\\.0*)?$') THEN CAST(latency_ms AS BIGINT) END, -1) AS whole, coalesce(task_id, '?') || '#attempt-' || coalesce(attempt_index, -1) AS group_id FROM rollout_rows""")
def sf01_coercions(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows")
    return r.select("rollout_row_id", C.coerce_bool(F.col("exit_code"), F.coalesce("resolved", F.lit(False))).alias("flag"), C.optional_verdict(F.col("verifier_status")).cast("string").alias("verdict"), C.coerce_int(F.col("latency_ms"), F.lit(-1).cast("bigint")).alias("whole"), C.group_id(F.coalesce("task_id", F.lit("?")), F.coalesce("attempt_index", F.lit(-1))).alias("group_id"))


_OUT = "json_extract_string(tool_output, '$.stdout')"
_WORDS = f"regexp_split_to_array(trim({_OUT}, e' \\t\\n\\r'), '[ \\t\\n\\r]+')"


@query(f"""SELECT rollout_row_id, CASE WHEN coalesce(trim({_OUT}, e' \\t\\n\\r'), '') = '' THEN '' WHEN len({_WORDS}) > 6 THEN array_to_string({_WORDS}[1:3], ' ') || ' <...truncated...> ' || array_to_string({_WORDS}[-3:], ' ') ELSE {_OUT} END AS text,
  coalesce(trim({_OUT}, e' \\t\\n\\r'), '') <> '' AND len({_WORDS}) > 6 AS truncated FROM rollout_rows""")
def sf13_head_tail(spark, sf_dir):
    cut = X.head_tail(F.get_json_object("tool_output", "$.stdout"), 3, 3)
    return table(spark, sf_dir, "rollout_rows").withColumn("cut", cut).select("rollout_row_id", "cut.text", F.coalesce("cut.truncated", F.lit(False)).alias("truncated"))


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""WITH x AS (SELECT message_id, tool_output AS t FROM turn_messages WHERE tool_output IS NOT NULL)
SELECT message_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, {_re(X.SELECTORS)}, 0), regexp_extract_all(t, {_re(X.PATHS)}, 0)))), '|') AS identities,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(t, {_re(X.LINE_HINTS)}, 0), regexp_extract_all(t, {_re(X.SELECTORS)}, 0)), regexp_extract_all(t, {_re(X.SYMBOLS)}, 0)))), '|') AS hints,
  list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_re(X.ERROR_LINE)})), lambda l: trim(l, e' -:\\t')), lambda l: l <> '')[1] AS error_line FROM x""")
def sf15_feedback_signals(spark, sf_dir):
    m = table(spark, sf_dir, "turn_messages").where("tool_output IS NOT NULL")
    t = F.col("tool_output")
    return m.select("message_id", F.array_join(X.artifact_identities(t), "|").alias("identities"), F.array_join(X.localization_hints(t), "|").alias("hints"), X.first_error_line(t).alias("error_line"))


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), e' \\t\\n\\r')"
# The recorded outputs hold stdout, stderr and exit_code; one without the last has no META section.
_RAW = f"""x AS (SELECT rollout_row_id, tool_output AS j, {_OUT} AS o, json_extract_string(tool_output, '$.stderr') AS e, json_extract_string(tool_output, '$.exit_code') AS c FROM rollout_rows),
y AS (SELECT rollout_row_id, CASE WHEN j IS NULL THEN '{{}}' ELSE concat_ws(chr(10) || chr(10), CASE WHEN o <> '' THEN 'STDOUT:' || chr(10) || o END, CASE WHEN e <> '' THEN 'STDERR:' || chr(10) || e END,
  CASE WHEN c IS NOT NULL THEN 'META:' || chr(10) || '{{"exit_code": ' || c || '}}' END) END AS raw FROM x)"""


@query(f"WITH {_RAW} SELECT rollout_row_id, sha256(raw) AS digest, {_NORMAL} AS text FROM y")
def sf18_payload_digest(spark, sf_dir):
    raw = X.raw_payload(F.col("tool_output"))
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", raw.alias("raw")).select("rollout_row_id", F.sha2("raw", 256).alias("digest"), X.normalize_text(F.col("raw")).alias("text"))


@query(f"""WITH {_RAW}, z AS (SELECT rollout_row_id, raw, {_NORMAL} AS t FROM y), f AS (SELECT rollout_row_id, sha256(raw) AS digest,
  list_sort(list_distinct(list_concat(regexp_extract_all(t, {_re(X.SELECTORS)}, 0), regexp_extract_all(t, {_re(X.PATHS)}, 0)))) AS identities,
  list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(t, {_re(X.LINE_HINTS)}, 0), regexp_extract_all(t, {_re(X.SELECTORS)}, 0)), regexp_extract_all(t, {_re(X.SYMBOLS)}, 0)))) AS hints,
  list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_re(X.ERROR_LINE)})), lambda l: trim(l, e' -:\\t')), lambda l: l <> '')[1] AS error_line FROM z)
SELECT rollout_row_id, digest, array_to_string(identities, '|') AS identities, array_to_string(hints, '|') AS hints, error_line, len(identities) > 0 AS has_identity, error_line IS NOT NULL AS has_error, len(hints) > 0 AS has_hint,
  len(identities) > 0 AND error_line IS NOT NULL AND len(hints) > 0 AS self_contained FROM f""")
def sf19_feedback_packet(spark, sf_dir):
    packet = table(spark, sf_dir, "rollout_rows").select("rollout_row_id", X.feedback(F.col("tool_output")).alias("p")).select("rollout_row_id", "p.*")
    return packet.drop("text", "truncated").withColumn("identities", F.array_join("identities", "|")).withColumn("hints", F.array_join("hints", "|"))


@query()
def pj03_parsed_turns(spark, sf_dir):
    m = table(spark, sf_dir, "turn_messages").where("assistant_response IS NOT NULL")
    return m.select("message_id", TC.turn_column(F.col("assistant_response"), 4).alias("t")).select("message_id", "t.*")


_TOOL_NAMES = ", ".join(f"'{t}'" for t in TC.TOOLS)
_RENAME = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TC.RENAMED.items())
_NEEDS = " AND ".join(f"(tool <> '{t}' OR trim(coalesce(json_extract_string(body, '$.args.{a}'), '')) <> '')" for t, args in TC.TOOLS.items() for a, (_, needed, *_) in args.items() if needed)


@query(f"""WITH m AS (SELECT message_id, coalesce(assistant_response, '') AS t FROM turn_messages),
b AS (SELECT message_id, t, regexp_extract_all(t, '(?s)<tool_call>(.*?)</tool_call>', 1) AS bodies FROM m),
u AS (SELECT message_id, unnest(bodies) AS body FROM b), v AS (SELECT message_id, body, CASE WHEN json_valid(body) THEN lower(trim(coalesce(json_extract_string(body, '$.tool'), ''))) ELSE '' END AS named FROM u),
w AS (SELECT *, CASE named {_RENAME} ELSE named END AS tool FROM v),
g AS (SELECT message_id, bool_and(named <> '') AS named, bool_or(tool = 'submit') AS submits, bool_and(tool IN ({_TOOL_NAMES})) AS allowed, bool_and(CASE WHEN named = '' THEN true ELSE {_NEEDS} END) AS complete FROM w GROUP BY 1),
c AS (SELECT message_id, len(bodies) AS n, len(string_split(t, '<tool_call>')) - 1 AS opened, len(string_split(t, '<think>')) = len(string_split(t, '</think>')) AS think_balanced FROM b),
p AS (SELECT c.*, n > 0 AND n = opened AND coalesce(g.named, true) AS parse_valid, g.submits, g.allowed, g.complete FROM c LEFT JOIN g USING (message_id))
SELECT message_id, n > 0 AS has_call, n::BIGINT AS n_calls, n BETWEEN 1 AND 2 AS count_valid, parse_valid, NOT coalesce(submits, false) OR n = 1 AS submit_alone, parse_valid AND coalesce(allowed, true) AS allowed_tools, parse_valid AND coalesce(complete, true) AS required_args, think_balanced FROM p""")
def fl09_turn_flags(spark, sf_dir):
    return table(spark, sf_dir, "turn_messages").select("message_id", TC.call_flags(F.col("assistant_response"), 2).alias("f")).select("message_id", "f.*")


_POOL_SQL = f"""WITH {_TASKS}, e AS (SELECT *, CASE WHEN len(f) = 0 THEN 'no fail_to_pass' WHEN len(p) = 0 THEN 'no pass_to_pass' WHEN list_has_any(f, p) THEN 'overlap' END AS err, {_IDENTITY} AS identity FROM tasks),
bt AS (SELECT DISTINCT task_id FROM rollout_rows WHERE verifier_status = 'invalid' AND exit_code = 2), bi AS (SELECT DISTINCT image_name FROM rollout_rows WHERE latency_ms > 2000),
m AS (SELECT e.*, coalesce(err, CASE WHEN task_id IN (SELECT task_id FROM bt WHERE task_id IS NOT NULL) THEN 'bad_task' WHEN image_name IN (SELECT image_name FROM bi WHERE image_name IS NOT NULL) THEN 'bad_image' END) AS early FROM e)
SELECT task_row_id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY identity, early IS NULL ORDER BY task_row_id) > 1 THEN 'duplicate' END) AS reason FROM m"""


@query(_POOL_SQL)
def fl05_task_pool(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows")
    t = _tasks(spark, sf_dir).withColumn("row_index", F.col("task_row_id"))
    f, p = F.col("f"), F.col("p")
    error = F.when(F.size(f) == 0, "no fail_to_pass").when(F.size(p) == 0, "no pass_to_pass").when(F.arrays_overlap(f, p), "overlap")
    bad_tasks = r.where("verifier_status = 'invalid' AND exit_code = 2").select("task_id")
    got = P.pool_reasons(t, bad_tasks, r.where("latency_ms > 2000").select("image_name"), error, X.identity_key(F.col("problem_statement"), f, p, "pytest"))
    return got.select("task_row_id", "reason")


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, min(task_row_id) AS first FROM ({_POOL_SQL}) GROUP BY 1")
def fl05_pool_counts(spark, sf_dir):
    """How many tasks each reason drops, and the first of them."""
    return fl05_task_pool(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.min("task_row_id").alias("first"))


_RULES = [("func_", "learnable"), ("func_pm_", "easy"), ("lm_modify", "near_impossible")]


@query("""SELECT rollout_row_id, CASE WHEN task_family = 'lm_modify' THEN 'near_impossible' WHEN task_family LIKE 'func\\_pm\\_%' ESCAPE '\\' THEN 'easy' WHEN task_family LIKE 'func\\_%' ESCAPE '\\' THEN 'learnable' ELSE 'unbanded' END AS band,
  CASE WHEN task_family = 'lm_modify' THEN 'exact' WHEN task_family LIKE 'func\\_%' ESCAPE '\\' THEN 'prefix' ELSE 'default' END AS rule FROM rollout_rows""")
def jn05_longest_prefix(spark, sf_dir):
    return P.longest_prefix(table(spark, sf_dir, "rollout_rows").select("rollout_row_id", "task_family"), "task_family", _RULES, "unbanded").select("rollout_row_id", "band", "rule")


@query("""WITH r AS (SELECT rollout_row_id, row_number() OVER (ORDER BY sha256(concat_ws('|', coalesce(task_id, ''), coalesce(step_index, -1), coalesce(attempt_index, -1), coalesce(turn_index, -1), rollout_row_id)), rollout_row_id) AS hash_rank, count(*) OVER () AS n FROM rollout_rows)
SELECT rollout_row_id, hash_rank, CASE WHEN hash_rank <= least(greatest(CAST(floor(n * 0.1) AS BIGINT), 1), n - 1) THEN 'eval' ELSE 'train' END AS split FROM r""")
def sl04_split_rows(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows").withColumn("row_index", F.col("rollout_row_id"))
    text = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("string")
    token = F.concat_ws("|", F.coalesce("task_id", F.lit("")), text("step_index"), text("attempt_index"), text("turn_index"), F.col("rollout_row_id").cast("string"))
    return P.split_held_out(r, token, 0.1).select("rollout_row_id", "hash_rank", "split")


@query("""WITH t AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders), s AS (SELECT range AS slot FROM range(64))
SELECT slot, id FROM s JOIN t ON (slot + 7 * 64) % n = place""")
def wn01_wraparound(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return P.wraparound_batch(_numbered(o, "id", "place"), 7, 64).select("slot", "id")


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 by ``order``, ranges of it being numbered apart and shifted."""
    from skein.operators.running import running_total

    return running_total(df.withColumn("_one", F.lit(1)), [F.col(order)], "_one", name).drop("_one")


@query("""WITH t AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT id, false AS added FROM t UNION ALL SELECT id, true FROM range(4096) r JOIN t ON r.range % n = place WHERE r.range < (4096 - n % 4096) % 4096""")
def sl06_upsample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return P.upsample_to_multiple(_numbered(o, "id", "place"), 4096).select("id", "added")


@query("""WITH t AS (SELECT cache_row_id, row_number() OVER (ORDER BY coalesce(original_length, 0), cache_row_id) - 1 AS k FROM token_cache)
SELECT cache_row_id, k // 128 AS bucket, k // 16 AS batch, k % 4 AS rank FROM t""")
def wn08_length_buckets(spark, sf_dir):
    k = table(spark, sf_dir, "token_cache").select("cache_row_id", F.struct(F.coalesce("original_length", F.lit(0)), "cache_row_id").alias("o"))
    numbered = _numbered(k, "o", "sorted_place")
    return P.length_buckets(numbered, "o", 16, 4).select("cache_row_id", "bucket", "batch", "rank")


_CONV = "task_id IS NOT NULL AND attempt_index IS NOT NULL"
_PLACE = "place"  # messages arrive out of order, so their turn comes first


@query(f"""SELECT message_id, CAST(sum(CAST(assistant_response IS NOT NULL AS BIGINT)) OVER w AS BIGINT) AS turn FROM turn_messages WHERE {_CONV} WINDOW w AS (PARTITION BY task_id, attempt_index ORDER BY turn_index NULLS FIRST, message_id ROWS UNBOUNDED PRECEDING)""")
def wn07_turn_numbers(spark, sf_dir):
    m = table(spark, sf_dir, "turn_messages").where(_CONV).withColumn(_PLACE, F.struct("turn_index", "message_id"))
    return P.turn_numbers(m, ["task_id", "attempt_index"], _PLACE, F.col("assistant_response").isNotNull()).select("message_id", "turn")


@query(f"""SELECT message_id, coalesce(array_to_string(list_filter(list(coalesce(tool_output, '')) OVER (PARTITION BY task_id, attempt_index ORDER BY turn_index NULLS FIRST, message_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: trim(x) <> ''), chr(10) || chr(10)), '') AS recent
FROM turn_messages WHERE {_CONV}""")
def wn02_recent_turns(spark, sf_dir):
    m = table(spark, sf_dir, "turn_messages").where(_CONV).withColumn(_PLACE, F.struct("turn_index", "message_id"))
    return P.recent_turns(m, ["task_id", "attempt_index"], _PLACE, "tool_output").select("message_id", F.col("recent"))


@query("""WITH n AS (SELECT user_id, event_type = 'error' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), r AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS run FROM n WHERE flag)
SELECT user_id, min(k) AS first, max(k) + 1 AS behind, count(*) AS length FROM r GROUP BY user_id, run""")
def wn09_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return P.islands(e, ["user_id"], "o", F.col("event_type") == "error")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_quantity > 45")
def jn03_semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def jn09_set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT task_id, attempt_index, arg_max(rollout_row_id, rollout_row_id) AS last_row, arg_max(exit_code, rollout_row_id) AS last_exit FROM rollout_rows WHERE task_id IS NOT NULL GROUP BY ALL""")
def jn07_last_wins(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows").where("task_id IS NOT NULL")
    return r.groupBy("task_id", "attempt_index").agg(F.max("rollout_row_id").alias("last_row"), F.max_by("exit_code", "rollout_row_id").alias("last_exit"))


@query("""WITH d AS (SELECT DISTINCT task_id FROM rollout_rows), e AS (SELECT DISTINCT task_id FROM task_rows)
SELECT count(*) FILTER (d.task_id IS NULL) AS missing, count(*) FILTER (e.task_id IS NULL) AS unexpected, count(*) FILTER (d.task_id IS NULL) = 0 AND count(*) FILTER (e.task_id IS NULL) = 0 AS same
FROM (SELECT task_id, 1 AS x FROM d WHERE task_id IS NOT NULL) d FULL JOIN (SELECT task_id, 1 AS y FROM e WHERE task_id IS NOT NULL) e USING (task_id)""")
def fl12_coverage(spark, sf_dir):
    some = lambda n: table(spark, sf_dir, n).where("task_id IS NOT NULL")
    return P.covers(some("rollout_rows"), some("task_rows"), "task_id")


@query("""SELECT task_row_id, row_number() OVER (ORDER BY CASE coalesce(task_family, '') WHEN 'func_basic' THEN 0 WHEN 'lm_modify' THEN 1 ELSE 2 END, task_row_id) - 1 AS place FROM task_rows""")
def sl01_stage_order(spark, sf_dir):
    rank = F.when(F.coalesce("task_family", F.lit("")) == "func_basic", 0).when(F.col("task_family") == "lm_modify", 1).otherwise(2)
    t = table(spark, sf_dir, "task_rows").select("task_row_id", F.struct(rank, "task_row_id").alias("o"))
    return _numbered(t, "o", "place").select("task_row_id", "place")


_PATHS_SQL = "p AS (SELECT DISTINCT unnest(regexp_extract_all(tool_output, '[\\w/]+\\.py')) AS path FROM turn_messages)"
_QUERY = "scan node"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path that a tool's output names."""
    m = table(spark, sf_dir, "turn_messages")
    return m.select(F.explode(F.regexp_extract_all("tool_output", F.lit(r"[\w/]+\.py"), F.lit(0))).alias("path")).distinct()


def _fit_sql(column: str, needle: str, points: tuple[int, int, int], other: str = "0") -> str:
    return f"CASE WHEN {column} = '{needle}' THEN {points[0]} WHEN starts_with({column}, '{needle}') THEN {points[1]} WHEN contains({column}, '{needle}') THEN {points[2]} ELSE {other} END"


_SCORE_SQL = " + ".join([
    _fit_sql("name", _QUERY, X.NAME_POINTS), _fit_sql("low", _QUERY, X.PATH_POINTS),
    *(_fit_sql("name", w, X.WORD_POINTS, f"CASE WHEN contains(low, '{w}') THEN {X.WORD_IN_PATH} ELSE 0 END") for w in _QUERY.split()),
    f"CASE WHEN {' AND '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in _QUERY.split())} THEN {X.ALL_WORDS} ELSE 0 END",
    f"CASE WHEN contains(name, '{_QUERY.replace(' ', '')}') THEN {X.JOINED} WHEN regexp_matches(name, '{'.*'.join(_QUERY.replace(' ', ''))}') THEN {X.LETTERS_IN_NAME} WHEN regexp_matches(low, '{'.*'.join(_QUERY.replace(' ', ''))}') THEN {X.LETTERS_IN_PATH} ELSE 0 END",
])


@query(f"""WITH {_PATHS_SQL}, l AS (SELECT path, lower(path) AS low, string_split(lower(path), '/')[-1] AS name FROM p), s AS (SELECT path, {_SCORE_SQL} AS points FROM l)
SELECT path, (points - {X.FOLDER} * (len(string_split(path, '/')) - 1) - length(path))::INT AS score FROM s WHERE points > 0 ORDER BY score DESC, path LIMIT 21""")
def sl07_path_search(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("score", X.path_score(F.col("path"), _QUERY)).where("score IS NOT NULL").orderBy(F.desc("score"), "path").limit(21)


@query("""WITH l AS (SELECT message_id, unnest(string_split(tool_output, chr(10))) AS line, generate_subscripts(string_split(tool_output, chr(10)), 1) AS line_no FROM turn_messages WHERE tool_output IS NOT NULL)
SELECT message_id, line_no, line FROM l WHERE contains(line, 'scan') ORDER BY message_id, line_no LIMIT 26""")
def sl08_first_matches(spark, sf_dir):
    return R.text_search(table(spark, sf_dir, "turn_messages"), "message_id", "tool_output", "scan", 25)


@query("""WITH x AS (SELECT image_name, min(task_row_id) AS first FROM task_rows WHERE image_name IS NOT NULL GROUP BY 1 ORDER BY first LIMIT 20) SELECT task_row_id, image_name FROM task_rows WHERE image_name IN (SELECT image_name FROM x)""")
def sl10_first_images(spark, sf_dir):
    t = table(spark, sf_dir, "task_rows").where("image_name IS NOT NULL")
    first = t.groupBy("image_name").agg(F.min("task_row_id").alias("first")).orderBy("first").limit(20)
    return t.join(F.broadcast(first.select("image_name")), "image_name", "left_semi").select("task_row_id", "image_name")


@query("""WITH t AS (SELECT rollout_row_id, string_split(json_extract_string(tool_output, '$.stdout'), chr(10)) AS ls FROM rollout_rows),
k AS (SELECT rollout_row_id, len(ls) AS n, list_transform(range(2, least(len(ls), 5) + 1), lambda i: lpad(i::VARCHAR, 8, ' ') || chr(9) || ls[i]) AS got FROM t WHERE ls IS NOT NULL),
j AS (SELECT rollout_row_id, n, array_to_string(got[:2], chr(10)) AS body, len(got) > 2 AS many FROM k)
SELECT rollout_row_id, substr(body, 1, 80) AS text, many OR length(body) > 80 AS truncated FROM j""")
def sl12_line_range(spark, sf_dir):
    part = X.line_range(F.get_json_object("tool_output", "$.stdout"), 2, 5, 2, 80)
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", part.alias("x")).where("x.text IS NOT NULL").select("rollout_row_id", "x.text", "x.truncated")


@query("SELECT rollout_row_id, 'a' AS side FROM rollout_rows WHERE stage = 'format_rft' UNION ALL SELECT rollout_row_id, 'b' FROM rollout_rows WHERE stage <> 'format_rft'")
def st02_union(spark, sf_dir):
    r = table(spark, sf_dir, "rollout_rows")
    return r.where("stage = 'format_rft'").select("rollout_row_id", F.lit("a").alias("side")).unionByName(r.where("stage <> 'format_rft'").select("rollout_row_id", F.lit("b").alias("side")))


@query("""WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids, len(list(o_orderkey)) AS n FROM orders GROUP BY 1), m AS (SELECT *, max(n) OVER (PARTITION BY o_custkey % 50) AS most FROM l)
SELECT o_custkey, array_to_string(list_concat(ids, list_transform(range(most - n), lambda x: 0)), ',') AS padded FROM m""")
def pj34_padding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids")).withColumn("b", F.col("o_custkey") % 50)
    return P.pad_arrays(o, {"ids": 0}, "b").select("o_custkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("padded"))


@query("""SELECT rollout_row_id, CASE WHEN coalesce(verifier_status, '') = 'invalid' THEN 0.0 ELSE CASE coalesce(verifier_status, 'missing') WHEN 'missing' THEN -1.0 WHEN 'correct' THEN 1.0 ELSE 0.0 END - CASE WHEN contains(coalesce(assistant_response, ''), '</tool_call>') THEN 0.0 ELSE 0.2 END END AS reward FROM rollout_rows""")
def ag19_reward(spark, sf_dir):
    status = F.coalesce("verifier_status", F.lit("missing"))
    base = F.when(status == "missing", -1.0).when(status == "correct", 1.0).otherwise(0.0)
    penalty = F.when(F.coalesce("assistant_response", F.lit("")).contains("</tool_call>"), 0.0).otherwise(0.2)
    return table(spark, sf_dir, "rollout_rows").select("rollout_row_id", F.when(status == "invalid", 0.0).otherwise(base - penalty).alias("reward"))
