"""Turns and tokens on hand-written cases."""

from pyspark.sql import functions as F

from skein.functions import tokens as K
from skein.operators import turns as T

SCHEMA = "message_id long, task_id string, attempt_index int, turn_index int, assistant_response string, tool_output string, recent string"


def test_frames_and_active_turns(spark):
    rows = [(1, "t", 0, 0, "a0", None, ""), (2, "t", 0, 0, None, "o0", ""), (3, "t", 0, 1, "a1", None, ""), (4, "t", 0, 2, " ", "o2", ""), (5, "t", 0, 3, "a3", "o3", ""), (6, "t", 0, 3, "late", None, ""), (7, None, 0, 0, "x", "y", "")]
    frames = T.turn_frames(spark.createDataFrame(rows, SCHEMA))
    got = {r.turn_index: (r.assistant, r.recent, r.active) for r in frames.collect()}
    assert got == {0: ("a0", "", True), 1: ("a1", "a0", False), 2: (" ", "a0\n\na1", False), 3: ("a3", "a0\n\na1", True)}
    assert [(r.turn_index, r.place) for r in T.active_turns(frames).orderBy("place").collect()] == [(0, 0), (3, 1)]
    solved = spark.createDataFrame([("t", 0, True)], "task_id string, attempt_index int, resolved boolean")
    assert T.batch_metrics(frames, solved).first()[:] == (1, 1.0, 1.0, 1.0, 2.0)
    assert T.batch_metrics(frames.limit(0), solved).first()[:] == (0, 0.0, 0.0, 0.0, 0.0)


def test_token_records(spark):
    text = "so <think>why</think> and <tool_call>{}</tool_call> end"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    full, none, empty = (r.x for r in df.select(K.token_records(F.col("t"), path).alias("x")).collect())
    assert K.tokenizer(path).decode(full.input_ids) == text and {"think", "tool_call", "other"} == set(full.labels)
    assert full.loss_mask == [int(x != "other") for x in full.labels] and none.n_tokens == empty.n_tokens == 0
    short = df.select(K.token_records(F.col("t"), path, 4).alias("x")).first().x
    assert short.n_tokens == 4 and short.loss_mask[-1] == 0
    assert K.fingerprint({"a": 1}, {"f": b"x"}) != K.fingerprint({"a": 1}, {"f": b"y"})
