"""Conversations against the rule stated row by row, and offsets against lstsq."""

import datetime as dt
import random

import numpy as np

from skein.llm import conversations as C

SCHEMA = "message_id long, task_id string, attempt_index int, turn_index int, speaker string, prompt string, assistant_response string, tool_output string, collected_at timestamp, role string"
T0 = dt.datetime(2025, 1, 1)


def row(i, task, attempt, turn, speaker, text, sec=0):
    kind = {"assistant": 1, " Model": 1, "tool": 2}.get(speaker, 0)
    texts = [None] * 3
    texts[kind] = text
    return (i, task, attempt, turn, speaker, *texts, T0 + dt.timedelta(seconds=sec), "clash")


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.task_id, r.attempt_index) for r in C.broken_conversations(df).collect()}


def test_rule_cases(spark):
    rows = [
        # kept: repeated row with other edges, blank beside filled, system optional
        row(1, "a", 0, 0, "user", "hi"), row(2, "a", 0, 0, "user", "  hi\n"), row(3, "a", 0, 0, " Model", "yo"), row(4, "a", 0, 0, "assistant", " ​"), row(5, "a", 0, None, "sys", "s"),
        # two replies
        row(6, "b", 0, 0, "user", "hi"), row(7, "b", 0, 0, "assistant", "x"), row(8, "b", 0, 0, "assistant", "y"),
        # gap, missing turn index, blank reply, empty think, only system
        row(9, "c", 0, 0, "user", "hi"), row(10, "c", 0, 0, "assistant", "x"), row(11, "c", 0, 2, "tool", "o"), row(12, "c", 0, 2, "assistant", "z"),
        row(13, "d", 0, None, "user", "hi"), row(14, "d", 0, 0, "assistant", "x"), row(15, "d", 0, 0, "user", "x"),
        row(16, "e", 0, 0, "user", "hi"), row(17, "e", 0, 0, "assistant", "<think>\n</think>"),
        row(18, "f", 0, 0, "system", "only"),
        # no task, no attempt: nobody's
        row(19, None, 0, 0, "user", "hi"), row(20, "g", None, 0, "user", "hi"),
        # unknown speaker named by its column; very long text
        (21, "h", 0, 0, None, "q" * 300_000, None, None, T0, "clash"), (22, "h", 0, 0, "?", None, "r", None, T0, "clash"),
    ]
    assert found(spark, rows) == {("b", 0), ("c", 0), ("d", 0), ("e", 0), ("f", 0)}
    assert found(spark, []) == set()


def test_rebuilt_in_order_with_roles(spark):
    rows = [row(3, "a", 0, 1, "tool", "out", 100), row(4, "a", 0, 1, "assistant", "done", 50), row(1, "a", 0, 0, "assistant", "do", 8), row(2, "a", 0, 0, "human", "ask", 0), row(5, "a", 0, 0, "sys", "rules", 9)]
    got = C.rebuild_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(m.role, m.text) for m in got[0].messages] == [("system", "rules"), ("user", "ask"), ("assistant", "do"), ("tool", "out"), ("assistant", "done")]
    assert C.rebuild_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def offsets(spark, rows):
    got = C.clock_offsets(C.reply_constraints(C.distinct_messages(C.tidy_messages(spark.createDataFrame(rows, SCHEMA)))))
    return {r.sender: r for r in got.collect()}


def test_offsets_are_the_least_squares_solution(spark):
    """Against lstsq over both offsets and the gap together."""
    random.seed(7)
    rows, true = [], {"user": 0, "tool": 3600}
    at, times = 0, []
    for turn in range(6):
        who = "user" if turn in (0, 3) else "tool"
        at += random.randint(5, 30)
        asked = at
        at += random.randint(5, 30)
        times.append((who, asked - true[who], at))
        rows += [row(2 * turn, "a", 0, turn, who, f"q{turn}", asked - true[who]), row(2 * turn + 1, "a", 0, turn, "assistant", f"r{turn}", at)]
    equations, slacks = [], []
    for t, (who, asked, replied) in enumerate(times):
        unit = [float(who == "user"), float(who == "tool")]
        equations.append([*unit, 1.0])
        slacks.append(replied - asked)
        if t:
            equations.append([-unit[0], -unit[1], 1.0])
            slacks.append(asked - times[t - 1][2])
    want = np.linalg.lstsq(np.array(equations), np.array(slacks, float), rcond=None)[0]
    got = offsets(spark, rows)
    assert abs(got["user"].offset_us / 1e6 - want[0]) < 0.001 and abs(got["tool"].offset_us / 1e6 - want[1]) < 0.001 and abs(got["tool"].gap_us / 1e6 - want[2]) < 0.001
    assert abs(got["tool"].offset_us / 1e6 - 3600) < 30 and got["tool"].feasible and got["user"].feasible


def test_a_slow_clock_is_recovered(spark):
    """Two turns of a user clock an hour slow, even gaps of 20 s: the hour is found to the second, and moves the messages."""
    rows = [row(1, "a", 0, 0, "user", "q0", 0 - 3600), row(2, "a", 0, 0, "assistant", "r0", 20), row(3, "a", 0, 1, "user", "q1", 40 - 3600), row(4, "a", 0, 1, "assistant", "r1", 60)]
    got = offsets(spark, rows)["user"]
    assert got.offset_us == 3600 * 1_000_000 and got.gap_us == 20 * 1_000_000
    whole = C.rebuild_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert [(m.sent_at - T0).total_seconds() for m in whole.messages] == [0, 20, 40, 60] and whole.clocks_agree


def test_no_offset_without_evidence_and_clocks_that_cannot_agree(spark):
    one = [row(1, "a", 0, 0, "user", "q", 0), row(2, "a", 0, 0, "assistant", "r", 50)]
    assert offsets(spark, one)["user"].offset_us == 0
    # the reply is before its question by an hour, the next question an hour after: no offset of the user's clock meets both
    two = [row(1, "a", 0, 0, "user", "q", 3600), row(2, "a", 0, 0, "assistant", "r", 0), row(3, "a", 0, 1, "user", "s", -3600), row(4, "a", 0, 1, "assistant", "t", 10)]
    assert not offsets(spark, two)["user"].feasible
    assert found(spark, two) == set()


def test_times_order_what_turns_leave_open(spark):
    rows = [row(1, "a", 0, 0, "user", "q", 5), row(2, "a", 0, 0, "assistant", "r", 9), row(3, "a", 0, 0, "system", "late", 4), row(4, "a", 0, 0, "system", "early", 1)]
    got = C.rebuild_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert [m.text for m in got.messages] == ["early", "late", "q", "r"]


def merged(spark, rows):
    once = C.distinct_messages(C.tidy_messages(spark.createDataFrame(rows, SCHEMA)))
    return C.merge_messages(once, C.conversation_clocks(C.clock_offsets(C.reply_constraints(once))))


def test_broken_conversations_come_from_the_corrected_order(spark):
    """A tool clock an hour slow: in turn 2 the user spoke first, though the tool's time is the earlier one."""
    rows = [
        row(1, "a", 0, 0, "user", "q0", 0), row(2, "a", 0, 0, "assistant", "r0", 20),
        row(3, "a", 0, 1, "tool", "o1", 40 - 3600), row(4, "a", 0, 1, "assistant", "r1", 60),
        row(5, "a", 0, 2, "tool", "o2", 80 - 3600), row(6, "a", 0, 2, "user", "q2", 70), row(7, "a", 0, 2, "assistant", "r2", 100),
        row(8, "b", 0, 0, "user", "q0", 0), row(9, "b", 0, 0, "assistant", "r0", 20), row(10, "b", 0, 1, "user", " ", 30), row(11, "b", 0, 1, "tool", "", 31),
    ]
    order = sorted(merged(spark, rows).where("task_id = 'a'").collect(), key=lambda r: r.place)
    assert [(r.turn_index, r.role, r.met) for r in order] == [
        (0, "user", True), (0, "assistant", True), (1, "tool", True), (1, "assistant", True), (2, "user", True), (2, "tool", False), (2, "assistant", True)
    ]
    assert found(spark, rows) == {("a", 0), ("b", 0)}
    # the rows come by the corrected times, not by counts beside them
    plan = C.broken_conversations(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "collected_at" in plan and "moved" in plan


def test_merged_order_against_the_rule(spark):
    """Random turns, ends, blanks and clocks, some times at the ends of what a timestamp holds."""
    random.seed(11)
    rows, want = [], set()
    for c in range(300):
        turns = {}
        for turn in random.choice([[0], [0, 1], [0, 1, 2], [1], [0, 2], [-1, 0], [0, None], [0, 2**31 - 1], []]):
            ends = turns[turn] = ([], [])
            for side, speakers in enumerate((("user", "tool"), ("assistant",))):
                for k in range(random.choice([1] * 12 + [0, 2])):
                    speaker, text = random.choice(speakers), random.choice([f"t{k}"] * 9 + [" "])
                    rows += [row(len(rows), "r", c, turn, speaker, text, random.choice([0, 5, -3600, 3600, 2 * 10**11, -6 * 10**10]))] * random.choice([1, 1, 2])
                    ends[side].append((speaker, text.strip()))
        rows.append(row(len(rows), "r", c, random.choice([0, None]), "sys", "s"))
        turns = {t: e for t, e in turns.items() if e[0] or e[1]}
        filled = all(len({e for e in side if e[1]}) == 1 for ends in turns.values() for side in ends)
        if not turns or not filled or set(turns) != set(range(len(turns))):
            want.add(("r", c))
    assert 0 < len(want) < 300 and found(spark, rows) == want


def test_times_at_the_ends_of_their_range(spark):
    from pyspark.sql import functions as F

    rows = [row(1, "a", 0, 0, "user", "q", 0), row(2, "a", 0, 0, "assistant", "r", 1), row(3, "a", 0, 1, "tool", "o", 0), row(4, "a", 0, 1, "assistant", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("collected_at", F.when(F.col("message_id") % 2 == 1, F.timestamp_micros(F.lit(-(2**63)))).otherwise(F.timestamp_micros(F.lit(2**63 - 1))))
    assert C.broken_conversations(df).count() == 0
    bare = df.withColumn("collected_at", F.lit(None).cast("timestamp"))
    assert C.broken_conversations(bare).count() == 0 and C.rebuild_conversations(bare).count() == 1
