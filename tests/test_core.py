"""Core functions on hand-written cases, sources round trip, and streams run twice."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import coerce as C
from skein.functions import text as X
from skein.functions import toolcalls as TC
from skein.operators import pool as P
from skein.operators import selection as S
from skein.operators.running import running_total
from skein.sources import io
from skein.streaming import incremental as I


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_coercions(spark):
    t = F.lit(None).cast("boolean")
    assert one(spark, *(C.coerce_bool(F.lit(x), t) for x in (" Yes", "off", "", "maybe", None))) == (True, False, False, None, None)
    assert one(spark, C.coerce_bool(F.lit(""), F.lit(True), blank_is_false=False)) == (True,)
    assert one(spark, *(C.coerce_int(F.lit(x), F.lit(-1).cast("bigint")) for x in (" 7 ", "3.0", "3.5", "x", None, "-2"))) == (7, 3, -1, -1, -1, -2)
    assert [r.value for r in one(spark, *(C.step_index(F.lit(x), F.lit(9)) for x in ("4", " ", None)))] == [4, 9, 9]
    assert one(spark, C.step_index(F.lit("-1"), F.lit(0)))[0].error
    assert one(spark, *(C.target_list(F.lit(x)) for x in ('["a", " b ", ""]', "a, b", "a\nb\n", "[broken", None, " "))) == (["a", "b"], ["a", "b"], ["a", "b"], ["[broken"], [], [])
    assert one(spark, *(C.canonical_tool(F.lit(x)) for x in (" Answer", "edit", "bash", "rm"))) == ("submit", "apply_patch", "bash", None)
    assert one(spark, C.external_tool(F.lit("str_replace_editor"), F.lit("view")), C.external_tool(F.lit("bash"), F.lit(None).cast("string"))) == ("read", "bash")
    assert one(spark, C.unique_in_order(F.array(F.lit(" b"), F.lit("a"), F.lit("b "), F.lit("")))) == (["b", "a"],)


def test_texts(spark):
    assert one(spark, X.normalize_text(F.lit("\x1b[31ma\x1b[0m  \r\nb\n\n\n\nc \t\n")))[0] == "a\nb\n\nc"
    assert tuple(one(spark, X.head_tail(F.lit("a b c d e"), 1, 2))[0]) == ("a <...truncated...> d e", True)
    assert tuple(one(spark, X.head_tail(F.lit("a  b"), 1, 2))[0]) == ("a  b", False)
    assert tuple(one(spark, X.head_tail(F.lit(" \n"), 1, 2))[0]) == ("", False)
    assert one(spark, X.artifact_identities(F.lit("see b/x.py:3 and t::u, b/x.py:3")))[0] == ["b/x.py:3", "t::u"]
    assert one(spark, X.first_error_line(F.lit("fine\n - Error: x:\nfailed")))[0] == "Error: x"
    fail, passing = F.array(F.lit("a"), F.lit("a")), F.array(F.lit("b"))
    assert one(spark, X.target_error(fail, passing), X.target_error(passing, passing), X.target_error(passing, F.array(F.lit("c")))) == ("repeated fail_to_pass", "overlap", None)
    assert one(spark, X.go_test_regex(F.array(F.lit("a.b"), F.lit("c"))), X.go_test_regex(F.array().cast("array<string>"))) == (r"^(?:a\.b|c)$", "^$")


@pytest.mark.parametrize(
    "text,tools,error",
    [
        ('<think>hm</think><tool_call>{"tool": "bash", "args": {"command": "echo </tool_call>"}}</tool_call>', ["bash"], None),
        ('<tool_call>{"tool": "bash", "args": {}}</tool_call>', ["bash"], "missing command"),
        ('<tool_call>{"tool": "submit", "args": {"final_response": "x"}}</tool_call><tool_call>{"tool": "bash", "args": {"command": "x"}}</tool_call>', None, "submit must stand alone"),
        ('<tool_call>{"tool": "bash"', None, "tool call isn't JSON"),
        ("just talk", None, "no tool call"),
        ("<tool_call><tool>read</tool><args><path>a</path><start_line>3</start_line><end_line>2</end_line></args></tool_call>", ["read"], "end_line before start_line"),
        ("<tool_call><tool>bash</tool><args><command>a</command><command>b</command></args></tool_call>", None, "command is repeated"),
        ("<tool_call><tool>bash</tool><!-- x --></tool_call>", None, "construct isn't allowed"),
    ],
)
def test_turns(spark, text, tools, error):
    got = spark.createDataFrame([(text,)], "t string").select(TC.turn_column(F.col("t"), 2).alias("x")).first().x
    assert (got.tools, got.error) == (tools, error)


@pytest.mark.parametrize("style", ["json", "xml"])
def test_rendered_calls_parse_back(style):
    for call in ({"tool": "submit", "args": {"final_response": "a & <b>", "changed_paths": ["x", "y"]}}, {"tool": "read", "args": {"path": "p", "start_line": 3}}, {"tool": "bash", "args": {"command": "]]>"}}):
        assert TC.parse_turn(TC.render_call(call, style))[1] == [call]


def test_chatml(spark):
    ok = one(spark, TC.chatml_payload(F.lit("<|im_start|>assistant\nhi\n<|im_end|>")))[0]
    assert (ok.payload, ok.error) == ("hi", None)
    assert one(spark, TC.chatml_payload(F.lit("<|im_start|>assistant hi<|im_end|> more")))[0].error == "text after the turn"


def test_reasons_keep_their_order(spark):
    df = spark.createDataFrame([(1, True, False, "", True, True, True, 0, ""), (2, False, True, "disk", False, False, None, 3, "boom"), (3, True, None, None, None, None, None, None, None)], "id int, container_ok boolean, infra_invalid boolean, invalid_reason string, has_submit boolean, format_ok boolean, resolved boolean, exit_code int, oops string")
    got = {r.id: r.reasons for r in S.select_rows(df, S.Policy(True, True, True, True, ("oops",))).collect()}
    assert got == {1: None, 2: "container_init_failed,disk,non_terminal,format_invalid,unresolved,nonzero_exit_code,oops", 3: "non_terminal,format_invalid,unresolved"}


def test_sizes_and_batches(spark):
    assert [P.eval_size(n, 0.1, 3) for n in (0, 1, 2, 50)] == [0, 0, 1, 5] and P.eval_size(9, 0.0, 3) == 0
    with pytest.raises(ValueError):
        P.eval_size(5, 0.1, 1, fixed=5)
    assert [P.effective_batch(n, 64, 8) for n in (7, 20, 100)] == [None, 16, 64]
    df = spark.createDataFrame([(i,) for i in range(5)], "place long")
    assert sorted(r.place for r in P.wraparound_batch(df, 1, 7).collect()) == [0, 1, 2, 2, 3, 3, 4]
    assert P.upsample_to_multiple(df, 4).count() == 8


def test_running_total(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 101, i) for i in range(300)], "g int, o int, v long")
    got = running_total(df, [F.col("o"), F.col("v")], "v", "before", by="g").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.g, r.o, r.v)):
        assert r.before == seen.get(r.g, 0)
        seen[r.g] = r.before + r.v
    assert running_total(df.limit(0), [F.col("o")], "v", "before").count() == 0


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", None)], "z string, a int")
    io.write_jsonl(df, str(tmp_path / "rows"))
    text = "".join(p.read_text() for p in (tmp_path / "rows").glob("part*"))
    assert {json.dumps(json.loads(x)) for x in text.splitlines()} == {'{"a": 1, "z": "b"}', '{"a": null, "z": "a"}'}
    io.write_parquet(df, str(tmp_path / "t.parquet"))
    assert io.read_rows(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError, match="missing columns: b, c"):
        io.require_columns(df, ["c", "b", "a"])
    with pytest.raises(ValueError):
        io.write_parquet(df.limit(0), str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text(json.dumps({"records": [{"task_id": "t1", "status": "bad"}, {"task_id": "t2", "status": "ok"}, {"image_name": "i1"}], "bad_task_ids": ["t3", " "]}))
    tasks, images = io.read_bad_tasks(spark, str(tmp_path / "bad.json"))
    assert {r.task_id for r in tasks.collect()} == {"t1", "t3"} and {r.image_name for r in images.collect()} == {"i1"}
    for name, body in (("a.json", {"records": [{"task_id": "t", "band": "easy"}]}), ("b.json", {"task_band_by_task_id": {"t": "easy"}}), ("c.json", {"task_bands": {"t": {"band": "easy"}}})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [tuple(r) for r in io.read_bands(spark, str(tmp_path / name)).collect()] == [("t", "easy")]
    io.write_manifest(spark, str(tmp_path / "m" / "x.json"), {"b": 1})
    assert json.loads((tmp_path / "m" / "x.json").read_text()) == {"b": 1}
    assert io.latest_file(spark, str(tmp_path), "*.json").endswith("x.json")


def test_streams_resume(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, v string").parquet(src)
    assert I.resumed_append(stream(), "k", out, str(tmp_path / "cp")).count() == 2
    spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string").coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.k for r in I.resumed_append(stream(), "k", out, str(tmp_path / "cp")).collect()) == [1, 2, 3]
    assert sorted(r.k for r in I.first_per_key(stream(), ["k"], str(tmp_path / "first")).collect()) == [1, 2, 3]


def test_windows_drop_late_rows(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = spark.sql("SELECT timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts, 'x' AS k FROM range(180)")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    got = I.running_counts(stream, "ts", "10 minutes", "1 hour", ["k"], str(tmp_path / "w"))
    assert [(r.start.hour, r.n) for r in got.orderBy("start").collect()] == [(0, 60), (1, 60)]


def test_window_counts_hold_every_row(spark, tmp_path):
    src, out, cp = str(tmp_path / "ev"), str(tmp_path / "w"), str(tmp_path / "cp")
    rows = spark.sql("SELECT timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts, 'x' AS k FROM range(180)")
    rows.coalesce(1).write.parquet(src)
    counted = lambda: {(r.start and r.start.hour, r.n) for r in I.window_counts(spark.readStream.schema(rows.schema).parquet(src), "ts", "1 hour", ["k"], out, cp).collect()}
    assert counted() == {(0, 60), (1, 60), (2, 60)}
    late = spark.sql("SELECT timestamp'2025-01-01 00:30:00' AS ts, 'x' AS k UNION ALL SELECT NULL, 'x'")
    late.coalesce(1).write.mode("append").parquet(src)
    assert counted() == {(0, 61), (1, 60), (2, 60), (None, 1)}
