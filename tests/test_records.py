"""Trajectories, task rows, batches and committed steps, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import messages as M
from skein.functions import text as X
from skein.functions import toolcalls as TC
from skein.operators import gates as G
from skein.operators import records as R
from skein.sources import commits as K

READ = '<tool_call>{"tool":"read","args":{"path":"a.py"}}</tool_call>'


def values(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("plain", "no tool call"),
        ("<think>a</think><think>b</think>" + READ, "more than one think block"),
        ("<think>a" + READ, "think block isn't closed"),
        (READ[:-3], "tool call block isn't closed"),
        ("<tool_call>{nope}</tool_call>", "tool call isn't JSON"),
        ('<tool_call>{"tool":"read","args":{"path":"a"}} more</tool_call>', "tool call isn't JSON"),
        (READ + READ, "2 tool calls, at most 1"),
        ('<tool_call>{"tool":"dance"}</tool_call>', "unknown tool 'dance'"),
        ("<tool_call>[1]</tool_call>", "a tool call must be an object"),
    ],
)
def test_broken_turns(text, error):
    with pytest.raises(TC.TurnError) as told:
        TC.parse_json_turn(text)
    assert str(told.value) == error


def test_turns_read_by_blocks():
    inner = json.dumps({"tool": "submit", "args": {"final_response": 'he said "</tool_call>" and <think>'}})
    assert TC.parse_json_turn(f"text <think> why </think> between <tool_call> {inner} </tool_call> after") == ("why", [json.loads(inner)])
    with pytest.raises(TC.TurnError, match="submit must stand alone"):
        TC.parse_json_turn(READ + f"<tool_call>{inner}</tool_call>", 3)
    assert [c["tool"] for c in TC.parse_json_turn(READ * 3, 3)[1]] == ["read"] * 3
    # a long unclosed turn is read once
    with pytest.raises(TC.TurnError):
        TC.parse_json_turn("<tool_call>" + '{"a": "b"} ' * 200_000)


def test_path_score_by_rule(spark):
    score = lambda path, query: values(spark, X.path_score(F.lit(path), query))
    name, whole, word = X.NAME_POINTS, X.PATH_POINTS, X.WORD_POINTS
    tail = X.ALL_WORDS + X.LETTERS_IN_NAME
    assert score("scan.py", "Scan.py ") == name[0] + whole[0] + word[0] + tail - 7
    assert score("lib/scan.py", "scan") == name[1] + whole[2] + word[1] + tail - X.FOLDER - 11
    assert score("lib/rescan.py", "scan") == name[2] + whole[2] + word[2] + tail - X.FOLDER - 13
    assert score("scan/lib.py", "scan") == whole[1] + X.WORD_IN_PATH + X.ALL_WORDS + X.LETTERS_IN_PATH - X.FOLDER - 11
    assert score("lib/scannode.py", "scan node") == word[1] + word[2] + X.ALL_WORDS + X.JOINED - X.FOLDER - 15
    assert score("lib/s_c_a_n.py", "scan") == X.LETTERS_IN_NAME - X.FOLDER - 14
    assert score("lib/other.py", "scan") is None


def test_payload_sections(spark):
    of = lambda t: values(spark, X.raw_payload(F.lit(t)))
    assert of('{"stdout": "a", "stderr": "b", "z": 1, "metadata": {"é": 2}}') == 'STDOUT:\na\n\nSTDERR:\nb\n\nMETA:\n{"metadata": {"\\u00e9": 2}, "z": 1}'
    assert of('{"stdout": "", "stderr": ""}') == '{"stderr": "", "stdout": ""}' and of(None) == "{}" and of("[1]") == "{}" and of("{broken") == "{}"
    packet = values(spark, X.feedback(F.lit('{"stdout": "tests/a.py::test_b failed\\nKeyError: x\\na.py:3"}')))
    assert packet.has_identity and packet.has_error and packet.has_hint and packet.self_contained
    assert not values(spark, X.feedback(F.lit('{"stdout": "fine"}'))).self_contained


def test_flags_of_a_turn(spark):
    of = lambda t, most=1: values(spark, TC.call_flags(F.lit(t), most)).asDict()
    assert of(READ) == {"has_call": True, "n_calls": 1, "count_valid": True, "parse_valid": True, "submit_alone": True, "allowed_tools": True, "required_args": True, "think_balanced": True}
    assert not of(READ + READ)["count_valid"] and of(READ + READ, 2)["count_valid"]
    assert not of('<tool_call>{"tool":"dance"}</tool_call>')["allowed_tools"] and not of('<tool_call>{"tool":"read","args":{}}</tool_call>')["required_args"]
    assert not of("<think>x" + READ)["think_balanced"] and not of("<tool_call>oops")["parse_valid"]
    assert not of(READ + '<tool_call>{"tool":"answer","args":{"final_response":"x"}}</tool_call>', 2)["submit_alone"]
    assert of(None)["n_calls"] == 0


def test_preprocessed_trajectories(spark):
    rows = [
        (1, "p", "<think>so it is</think>" + READ, None, None, '{"stdout": "KeyError in a.py:3"}', "kept"),
        (2, "p", None, '[{"tool": "bash", "args": {"command": "ls"}}]', "hm", "{}", "kept"),
        (3, "p", "no call", None, None, None, "kept"),
        (4, "p", '<tool_call>{"tool":"read","args":{}}</tool_call>', None, None, None, "kept"),
        (5, None, None, None, None, None, "kept"),
    ]
    df = spark.createDataFrame(rows, "id int, prompt string, assistant_response string, external_tool_calls string, thinking string, tool_output string, extra string")
    got = {r.id: r for r in R.preprocess(df).collect()}
    assert got[1].token_labels == ["think"] * 3 + ["tool_call"] * 5 and got[1].action_tokens == 8 and got[1].format_valid and got[1].feedback.has_error
    assert got[1].action_mask_turn_sdpo == [1] * 8 and got[1].extra == "kept"
    assert got[2].label_blocks[0].text == "hm" and json.loads(got[2].tool_calls[0])["tool"] == "bash" and got[2].format_valid
    assert got[3].parse_error == "no tool call" and got[3].token_labels == [] and got[3].feedback is None and not got[3].format_valid
    assert got[4].validation_errors == ["tool_call[0]: missing path"] and not got[4].format_valid
    assert got[5].parse_error == "external calls must be an array with a call"


def test_task_rows_and_partitions(spark):
    rows = [(1, "t1", " img ", "Fix it", '["a::b"]', "c::d", " Training"), (2, "t2", None, "x", "a", "b", "VAL"), (3, "t3", "i", " ", "a", "b", "all"), (4, "t4", "i", "s", "a", "a", None)]
    df = spark.createDataFrame(rows, "row int, task_id string, image_name string, problem_statement string, fail_to_pass string, pass_to_pass string, part string")
    got = {r.row: r for r in R.task_rows(df, "pytest").collect()}
    assert got[1].image_name == "img" and got[1].fail_to_pass == ["a::b"] and got[1].error is None
    assert got[2].error == "no image" and got[3].prompt_source == "targets" and "a" in got[3].problem_statement and got[4].error == "overlap"
    nested = R.nested_task_rows(R.task_rows(df, "pytest"), "row", 6).collect()
    assert [r.row for r in nested] == []
    assert R.nested_task_rows(R.task_rows(df, "pytest"), "row", 7).first().ground_truth.pass_to_pass == ["c::d"]
    assert [r.row for r in R.partition_rows(df, "part", "TRAIN").collect()] == [1] and R.partition_rows(df, "part", " all ").count() == 4
    for asked, allowed in (("dev", ("train", "eval", "all")), ("eval", ("train",))):
        with pytest.raises(ValueError):
            R.partition_rows(df, "part", asked, allowed)
    assert R.first_rows(df, "row", 2).count() == 2 and R.first_rows(df, "row", None).count() == 4
    assert [r.row for r in R.rows_for_task(df, "t2").collect()] == [2]


def test_completions_and_loop_messages(spark):
    of = lambda message: values(spark, M.completion_text(F.lit(json.dumps({"choices": [{"message": message}]}))))
    assert of({"content": "hi "}) == "hi " and of({"content": [{"type": "text", "text": " a"}, {"type": "image"}, {"type": "text", "text": "b "}]}) == "ab"
    assert of({"content": " ", "tool_calls": [{"function": {"name": "read", "arguments": '{"path": "x"}'}}]}) == '<tool_call>{"tool":"read","args":{"path":"x"}}</tool_call>'
    assert of({"content": None}) is None and values(spark, M.completion_text(F.lit("{}"))) is None
    message = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    loop = lambda *m: [(x.role, x.content) for x in values(spark, M.loop_messages(F.array(*m), "C", "go"))]
    assert loop(message("System", "s"), message("user", "u")) == [("system", "C\n\ns"), ("user", "u")]
    assert loop(message("user", "u"), message("assistant", "a")) == [("system", "C"), ("user", "u"), ("assistant", "a"), ("user", "go")]
    assert [x.content for x in values(spark, M.tool_messages(F.array(F.lit(" a "), F.lit(" "), F.lit(None).cast("string"))))] == ["a"]


def test_masks_budgets_and_losses(spark):
    masks = values(spark, R.turn_masks(F.expr("array(array(1, 1, 1), array(0, 1))"), F.expr("array(1, 1, 0, 1)")))
    assert masks == [[1, 1, 0, 0], [0, 1, 0, 0]]
    assert R.prompt_budget(4000, 1000, 2, 500) == 1500 and R.prompt_budget(100, 1000, 0, 500) == 100 and R.prompt_budget(9, 0, 1, 5) == 9
    with pytest.raises(ValueError):
        R.prompt_budget(10, 100, 1, 100)
    lines = spark.createDataFrame([("r", x) for x in ("step:2 - train/loss:0.5 - val/loss:0.9", "step:1 - train/loss:1.5", "no", "step:3 - train/loss:7e-1")], "run string, line string")
    got = {r.series: r for r in R.loss_series(lines, "line", ["run"]).collect()}
    assert (got["train"].first, got["train"].last, got["train"].least, got["train"].least_step, round(got["train"].delta, 6)) == (1.5, 0.7, 0.5, 2, -0.8) and got["val"].n == 1


def test_verifier_text(spark):
    none = F.lit(None)
    of = lambda missing=none.cast("boolean"), error=none.cast("string"), resolved=none.cast("boolean"), submitted=none.cast("boolean"), valid=none.cast("boolean"), report=none.cast("string"): values(spark, G.verifier_text(missing, error, resolved, submitted, valid, report, "H:"))
    assert of() == "" and of(report=F.lit(" r ")) == "H:\nThe final verifier reported: r"
    assert of(missing=F.lit(True), resolved=F.lit(True)) == f"H:\n{G.NOT_CONFIGURED}"
    assert of(error=F.lit("boom"), submitted=F.lit(True), valid=F.lit(False)) == f"H:\n{G.NOT_CLEAN}\n{G.BAD_SUBMIT}\nVerifier error: boom"
    assert of(resolved=F.lit(False), submitted=F.lit(False), report=F.lit("r")) == f"H:\n{G.NOT_PASSED}\n{G.NO_SUBMIT}"
    at = lambda mode, turn, n, current: values(spark, G.feedback_at_turn(mode, F.lit(turn), F.lit(n), current))
    assert at("all_turns", 0, 5, True) and not at("none", 4, 5, True) and at("last", 4, 5, True) and at("last", 3, 5, False) and not at("last", 0, 0, True)


def test_fingerprint_is_of_rows_in_order(spark):
    rows = [(1, "a", ["x"]), (2, "b", None), (3, "b", [])]
    df = spark.createDataFrame(rows, "k int, name string, t array<string>")
    print_of = lambda d: G.pool_fingerprint(d, "k", ["name"], ["t"]).first().digest
    import hashlib

    assert print_of(df.repartition(3)) == hashlib.sha256(b"a\0x\0\1b\0\1b\0\1").hexdigest()
    assert print_of(df.union(df)) != print_of(df) != print_of(df.where("k < 3"))


def test_steps_count_once_committed(spark, tmp_path):
    steps = K.Steps(spark, f"file://{tmp_path}/run", "format")
    assert steps.last() is None and steps.read() is None
    one = spark.range(3).withColumn("v", F.lit(1))
    steps.write(0, one)
    steps.write(1, one)
    one.write.parquet(steps.path(2))  # a try that died before its commit
    assert steps.last() == 1 and steps.read().count() == 6
    assert steps.drop_dirty(5) == [2] and not K.exists(spark, steps.path(2))
    steps.write(1, one.union(one))  # committed already: nothing changes
    assert steps.read().where("step = 1").count() == 3
    with pytest.raises(ValueError, match="step 4 after 1"):
        steps.write(4, one)
    with pytest.raises(ValueError, match="committed by stage"):
        K.Steps(spark, f"file://{tmp_path}/run", "other").last()
    K.remove(spark, steps.path(1))
    with pytest.raises(ValueError, match="missing"):
        steps.last()


def test_names_and_caches_follow_what_they_depend_on(spark, tmp_path):
    a = K.cache_path("/c", "bands", {"a": 1, "b": 2}, "my set/v1")
    assert a == K.cache_path("/c", "bands", {"b": 2, "a": 1}, "my set/v1") != K.cache_path("/c", "bands", {"a": 1, "b": 3}, "my set/v1")
    assert a.startswith("/c/bands-my_set_v1-") and len(a.rsplit("-", 1)[1]) == 16
    file = tmp_path / "x.json"
    built = []

    def build():
        built.append(1)
        return spark.range(2)

    where = f"file://{file}"
    assert K.file_token(spark, where) == "absent"
    for _ in range(2):
        K.cached_result({"a": 1}, [where], spark, build)
    assert len(built) == 1
    file.write_text("new")
    K.cached_result({"a": 1}, [where], spark, build)
    assert len(built) == 2
    df = spark.createDataFrame([([1, 2], 2)], "input_ids array<int>, n_tokens int")
    K.write_token_cache(df, f"file://{tmp_path}/cache", 3, "f")
    assert spark.read.parquet(f"file://{tmp_path}/cache").first().cache_schema_version == 3
    with pytest.raises(ValueError):
        K.write_token_cache(df.limit(0), f"file://{tmp_path}/none", 3, "f")


def test_search_and_lines(spark):
    df = spark.createDataFrame([(1, "a scan\nb\nscan again"), (2, None), (3, "scan")], "id int, t string")
    assert [(r.id, r.line_no) for r in R.text_search(df, "id", "t", "scan", 1).collect()] == [(1, 1), (1, 3)]
    part = values(spark, X.line_range(F.lit("a\nb\nc\nd"), 2, 3, 5, 100))
    assert part.text == "       2\tb\n       3\tc" and not part.truncated
    assert values(spark, X.line_range(F.lit("a\nb\nc\nd"), 1, 4, 2, 100)).truncated and values(spark, X.line_range(F.lit("abcdef"), 1, 1, 1, 10)).text == "       1\ta"


def test_quantiles_slices_and_codes(spark, tmp_path):
    import statistics

    from skein.functions import coerce as C
    from skein.operators import pool as P
    from skein.operators.nested import nested_nodes, node_table
    from skein.operators.running import exact_quantile
    from skein.sources import io

    rows = [(g, float((i * 37) % 101)) for g, n in (("a", 40), ("b", 7), (None, 5)) for i in range(n)] + [("c", None), ("d", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.threshold for r in exact_quantile(df, "v", 0.8, "g").collect()}
    at = lambda xs: statistics.quantiles(xs, n=5, method="inclusive")[3] if len(xs) > 1 else xs[0]
    for g in ("a", "b", "d"):
        assert abs(got[g] - at([v for h, v in rows if h == g])) < 1e-9
    assert "c" not in got and abs(exact_quantile(df, "v", 0.8).first().threshold - at([v for _, v in rows if v is not None])) < 1e-9
    assert [r.id for r in P.row_slice(spark.range(20), ["id"], 3, 6).collect()] == [3, 4, 5] and P.row_slice(spark.range(2), ["id"], 3, 6).count() == 0
    for text, want in (("true", 1), ("False", 0), ("2.0", 2), (" 3 ", 3), ("2.5", None), ("x", None), (None, None)):
        assert values(spark, C.exit_code(F.lit(text).cast("string"))) == want
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\nnope\n[2]\n{"a"\n{"a": 3}\n')
    assert io.malformed(spark, str(tmp_path / "rows.jsonl")) == 3
    nodes = nested_nodes(spark.createDataFrame([(1, '{"e": [{"path": "x", "in": {"k": 2}}]}')], "record_id long, j string"), ["j"])
    assert tuple(node_table(nodes, "e", {"path": "path", "k": "in.k"}).select("path", "k").first()) == ("x", "2")


def test_compacted_prompts(spark):
    part = lambda *p: values(spark, M.compacted([(n, F.lit(t).cast("string"), k) for n, t, k in p], 5))
    assert tuple(part(("a", "x y", 0), ("b", None, 0), ("c", " ", 1))) == ("x y", False)
    assert tuple(part(("a", "1 2 3", 0), ("b", "4 5 6 7", 2))) == ("1 4 5 6 7", True)
    assert tuple(part(("a", "1 2 3", 3), ("b", "4 5 6 7", 4))) == ("1 2 3 4 5", True)


def test_blocks_histories_and_merges(spark):
    rows = [("a", 0, "tool", "early"), ("a", 1, "assistant", "one"), ("a", 2, "tool", "x"), ("a", 3, "tool", "y"), ("a", 4, "user", "u"), ("a", 5, "assistant", None), ("b", 0, None, "z")]
    df = spark.createDataFrame(rows, "k string, o int, role string, t string")
    got = {(r.k, r.turn): (r.assistant, r.blocks) for r in R.turn_blocks(df, ["k"], "o", "role", "t").collect()}
    assert got == {("a", 0): ("one", ["x", "y"]), ("a", 1): (None, [])}
    of = lambda t, b=None: values(spark, R.feedback_signal(F.lit(t).cast("string"), F.lit(b).cast("array<string>")))
    assert of('{"stdout": "x"}') and of('{"exit_code": 1}') and of('{"exit_code": 0, "metadata": {"a": 1}}') and of(None, ["b"])
    assert not of('{"stdout": " ", "exit_code": 0, "metadata": {}}') and not of(None) and not of("broken")
    merge = lambda a, b: values(spark, R.merged_map(F.from_json(F.lit(a), "map<string,string>"), F.from_json(F.lit(b).cast("string"), "map<string,string>")))
    assert merge('{"a": "1", "b": "2"}', '{"b": null, "c": "3"}') == {"a": "1", "b": None, "c": "3"} and merge('{"a": "1"}', None) == {"a": "1"}
    solved = lambda t, c: values(spark, R.attempt_resolved(F.lit(t).cast("boolean"), F.lit(c).cast("array<int>")))
    assert solved(True, [0, 0]) and not solved(True, [0, 1]) and not solved(True, []) and not solved(None, [0]) and not solved(True, None)
    counts = R.histogram(df, ["k"], "role", "h").collect()
    assert {r.k: r.h for r in counts} == {"a": "assistant:2,tool:3,user:1", "b": "none:1"}
    assert R.first_seen(df, ["role"], "o").where("value = 'tool'").first().first == 0
    assert R.load_tasks(spark, lambda s, d, p: s.createDataFrame([(d, p, "i", "s", "a", "b")], "task_id string, part string, image_name string, problem_statement string, fail_to_pass string, pass_to_pass string"), "d", "train", "pytest").first().error is None


def test_contents_and_histories(spark):
    text = lambda c: values(spark, M.content_text(F.lit(c).cast("string")))
    assert text("plain") == "plain" and text('[{"text": " a "}, "b", 3, {"type": "image"}, " "]') == "a\nb\n3" and text(None) is None
    history = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("assistant", "hi"), ("tool", '<tool_response>\n{"a": 1}\n</tool_response>'), ("tool", "<tool_response>no</tool_response>"))))
    got = [(m.role, m.content) for m in values(spark, M.generation_messages(F.lit("s"), F.lit("u"), history))]
    assert got == [("system", "s"), ("user", "u"), ("assistant", "hi"), ("user", 'Tool response:\n{"a": 1}'), ("tool", "<tool_response>no</tool_response>")]
    assert TC.xml_schema("answer")[1] == ("changed_paths", "list", False, "item")


def test_progress_is_added_once(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    some = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert K.append_progress(some, "k", folder, 3) == {"done": 2, "expected": 3, "status": "partial"}
    assert K.append_progress(some.union(spark.createDataFrame([("c", 3)], "k string, v int")), "k", folder, 3)["status"] == "complete"
    assert K.read_json(spark, f"{folder}/progress.json")["done"] == 3
