"""Conversations rebuilt from message rows.

Each turn puts two constraints on its messages: the incoming message comes
before its reply, and it comes after the earlier turn's reply. The times at
their ends give the offset of each sender's clock by least squares, the
assistant's clock being the reference. The corrected times merge what
turn_index leaves open into the order of the turns. In that order every
constraint is tried: a missing, a doubled or a misplaced end meets none, and
rejects its conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spellings of the speakers.
SPEAKERS = {
    "system": ("system", "sys", "developer"),
    "user": ("user", "human"),
    "assistant": ("assistant", "model", "agent", "ai", "bot"),
    "tool": ("tool", "function", "observation", "environment", "tool_response"),
}
RANK = {"system": 0, "user": 1, "tool": 1, "assistant": 2}

#: White space, control and invisible characters (both regex engines read it).
BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}\x{2800}\x{3164}\x{115F}\x{1160}]"
EMPTY = rf"(?i)</?think\s*/?>|{BLANK}"
EDGES = rf"^{BLANK}+|{BLANK}+$"

CONVERSATION = ["task_id", "attempt_index"]


def speaker_role(speaker: Column, prompt: Column, response: Column, tool: Column) -> Column:
    """One of the four roles; an unknown or missing speaker by the filled column."""
    name = F.lower(F.regexp_replace(speaker, EDGES, ""))
    out = reduce(lambda c, kv: c.when(name.isin(*kv[1]), kv[0]), SPEAKERS.items(), F.when(F.lit(False), ""))
    return out.otherwise(F.when(response.isNotNull(), "assistant").when(tool.isNotNull(), "tool").otherwise("user"))


def tidy_messages(df: DataFrame) -> DataFrame:
    """Rows of known conversations with ``role`` and trimmed ``text``, null where blank.

    Rows without task_id or attempt_index belong to no conversation.
    """
    prompt, response, tool = F.col("prompt"), F.col("assistant_response"), F.col("tool_output")
    role = speaker_role(F.col("speaker"), prompt, response, tool)
    text = F.when(F.col("role") == "assistant", response).when(F.col("role") == "tool", tool).otherwise(prompt)
    rows = df.where(F.col("task_id").isNotNull() & F.col("attempt_index").isNotNull()).withColumn("role", role)
    filled = F.length(F.regexp_replace(text, EMPTY, "")) > 0
    return rows.select(*CONVERSATION, "turn_index", "role", F.when(filled, F.regexp_replace(text, EDGES, "")).alias("text"), "collected_at", "message_id")


def distinct_messages(messages: DataFrame) -> DataFrame:
    """Tidy messages with repeated ones (turn, role and text) once, at their first time, and ``digest``, null where blank.

    The one shuffle is by conversation; later aggregates and windows reuse its partitioning.
    """
    digest = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    rows = messages.select(*CONVERSATION, "turn_index", "role", digest.alias("digest"), F.unix_micros("collected_at").alias("at"), "message_id", "text")
    return rows.repartition(*CONVERSATION).groupBy(*CONVERSATION, "turn_index", "role", "digest").agg(F.min("at").alias("at"), F.min("message_id").alias("message_id"), F.first("text").alias("text"))


def reply_constraints(once: DataFrame) -> DataFrame:
    """Per turn its sender and the slack in microseconds of its two reply-before constraints.

    ``reply_slack``: the incoming message of the turn is before its reply;
    ``ask_slack``: the reply of the turn before is before the incoming message.
    A slack is null where an end isn't there or the difference is out of range.
    """
    spoken, filled = F.col("role") != "system", F.col("digest").isNotNull()
    incoming, reply = filled & F.col("role").isin("user", "tool"), filled & (F.col("role") == "assistant")
    turns = once.groupBy(*CONVERSATION, "turn_index").agg(
        F.bool_or(spoken).alias("spoken"),
        F.min(F.when(incoming, F.col("role"))).alias("sender"),
        F.min(F.when(incoming, F.col("at"))).alias("asked"),
        F.min(F.when(reply, F.col("at"))).alias("replied"),
    )
    by = Window.partitionBy(*CONVERSATION, "spoken").orderBy(F.col("turn_index").asc_nulls_first())
    return turns.select(
        *CONVERSATION,
        "sender",
        F.try_subtract("replied", "asked").alias("reply_slack"),
        F.when(F.col("spoken"), F.try_subtract(F.col("asked"), F.lag("replied").over(by))).alias("ask_slack"),
    )


def clock_offsets(constraints: DataFrame) -> DataFrame:
    """Per conversation and incoming sender the clock offset in microseconds, by least squares.

    With the assistant's clock as reference, each sender's times are to be moved
    by the o, and the conversation has the usual gap g, that together minimise
    the sum of (reply_slack - o - g)^2 and (ask_slack + o - g)^2 over all
    constraints. The normal equations need only counts and sums per sender (r, R
    of replies, a, A of asks): g = sum(R + A - (r - a)(R - A) / (r + a)) /
    sum(4 r a / (r + a)), and o = (R - A - (r - a) g) / (r + a). Where no sender
    has constraints of both kinds g isn't determined and nothing is moved.
    ``feasible`` tells whether any offset meets all of the sender's constraints
    (the largest lower bound isn't above the smallest upper bound).
    """
    total = lambda c: F.coalesce(F.try_sum(c), F.lit(0)).cast("double")
    per = constraints.where("sender IS NOT NULL").groupBy(*CONVERSATION, "sender").agg(
        F.count("reply_slack").alias("r"),
        F.count("ask_slack").alias("a"),
        total("reply_slack").alias("rs"),
        total("ask_slack").alias("as"),
        F.min("reply_slack").alias("upper"),
        F.max(F.try_subtract(F.lit(0), "ask_slack")).alias("lower"),
    )
    whole = Window.partitionBy(*CONVERSATION)
    edges = F.col("r") + F.col("a")
    lean, pull = F.col("r") - F.col("a"), F.col("rs") - F.col("as")
    some = F.when(edges > 0, F.lit(1)).otherwise(0)
    weight = F.sum(F.try_divide(4 * F.col("r") * F.col("a"), edges)).over(whole)
    gap = F.try_divide(F.sum(some * (F.col("rs") + F.col("as") - F.coalesce(F.try_divide(lean * pull, edges), F.lit(0)))).over(whole), weight)
    offset = F.coalesce(F.round(F.try_divide(pull - lean * gap, edges)).try_cast("long"), F.lit(0))
    feasible = F.coalesce(F.col("lower") <= F.col("upper"), F.lit(True))
    return per.select(*CONVERSATION, "sender", edges.alias("edges"), offset.alias("offset_us"), F.round(gap).try_cast("long").alias("gap_us"), feasible.alias("feasible"))


def conversation_clocks(offsets: DataFrame) -> DataFrame:
    """``clock_offsets`` with one row per conversation."""
    return offsets.groupBy(*CONVERSATION).agg(
        F.max(F.when(F.col("sender") == "user", F.col("offset_us"))).alias("user_us"),
        F.max(F.when(F.col("sender") == "tool", F.col("offset_us"))).alias("tool_us"),
        F.bool_and("feasible").alias("clocks_agree"),
    )


def corrected(messages: DataFrame) -> DataFrame:
    """Messages with their ``rank`` in the turn's constraint and, by the clocks joined to them, the corrected time ``moved``."""
    rank = F.when(F.col("role") == "system", RANK["system"]).when(F.col("role") == "assistant", RANK["assistant"]).otherwise(RANK["user"])
    offset = F.when(F.col("role") == "user", F.col("user_us")).when(F.col("role") == "tool", F.col("tool_us"))
    return messages.withColumns({"rank": rank, "moved": F.try_add(F.col("at"), F.coalesce(offset, F.lit(0)))})


def merge_messages(once: DataFrame, clocks: DataFrame) -> DataFrame:
    """Each conversation in one order, with the ``place`` of every message and ``met``: whether its constraints hold there.

    The order is that of turn, place in the turn's constraint and corrected
    time. Right before a reply has to be the incoming message of its turn; right
    before an incoming message the reply of the turn before or, in turn 0,
    nothing; and the last message has to be a reply. Blank messages take part,
    and never meet a constraint, only where their turn has no other. System
    messages stand in an order of their own and have no constraints.
    """
    spoken, filled = F.col("role") != "system", F.col("digest").isNotNull()
    turn = Window.partitionBy(*CONVERSATION, "spoken", "turn_index")
    by = Window.partitionBy(*CONVERSATION, "spoken").orderBy(F.col("turn_index").asc_nulls_first(), "rank", "moved", "digest", "role")
    rows = corrected(once.join(clocks, CONVERSATION, "left")).withColumn("spoken", spoken)
    rows = rows.withColumn("alone", ~F.bool_or(filled).over(turn)).where(filled | F.col("alone"))
    before = lambda c: F.lag(c).over(by)
    reply = F.col("rank") == RANK["assistant"]
    first = before("rank").isNull() & (F.col("turn_index") == 0)
    after_reply = (before("rank") == RANK["assistant"]) & (F.try_add(before("turn_index"), F.lit(1)) == F.col("turn_index"))
    after_incoming = (before("rank") == RANK["user"]) & (before("turn_index") == F.col("turn_index"))
    closed = reply | F.lead("rank").over(by).isNotNull()
    met = filled & closed & F.when(reply, after_incoming).otherwise(first | after_reply)
    return rows.withColumns({"place": F.row_number().over(by) - 1, "met": F.when(F.col("spoken"), F.coalesce(met, F.lit(False)))})


def unmet_conversations(merged: DataFrame) -> DataFrame:
    """(task_id, attempt_index) of the merged conversations with a message whose constraints don't hold, or with none at all."""
    per = merged.groupBy(*CONVERSATION).agg(F.bool_and("met").alias("met"))
    return per.where(~F.coalesce("met", F.lit(False))).select(*CONVERSATION)


def broken_conversations(df: DataFrame) -> DataFrame:
    """(task_id, attempt_index) of every conversation whose messages, merged by corrected time, don't meet their constraints.

    The constraint chain 0 in, 0 out, 1 in, 1 out, ... is met only if every turn
    from 0 on has exactly one incoming message and one reply. Times order the
    messages that claim one end, and never reject a whole chain. Null, blank
    and repeated rows: blank rows never fill an end, equal texts of one speaker
    and turn (apart from surrounding blanks) count once, rows without a turn
    break their conversation unless they are the system's. A conversation of
    system rows only is empty, so broken. Empty input gives an empty result and
    further columns are ignored.
    """
    once = distinct_messages(tidy_messages(df))
    return unmet_conversations(merge_messages(once, conversation_clocks(clock_offsets(reply_constraints(once)))))


def rebuild_conversations(df: DataFrame) -> DataFrame:
    """One row per sound conversation with its ``messages`` in order.

    Message times are corrected by ``clock_offsets`` and merged in the order of
    turn, place in the turn's constraint and corrected time, which alone orders
    several system messages of a turn; those without a turn come first. A conversation's messages are the record
    itself, so they are gathered per conversation only. ``clocks_agree`` is
    false where no clock offset meets all constraints.
    """
    once = distinct_messages(tidy_messages(df))
    merged = merge_messages(once, conversation_clocks(clock_offsets(reply_constraints(once))))
    sound = F.bool_and("met").over(Window.partitionBy(*CONVERSATION))
    entry = F.struct(F.col("turn_index"), F.col("rank"), F.col("moved").alias("at"), F.col("message_id"), F.col("role"), F.col("text"))
    # all by conversation: texts are dealt once, and only those of sound conversations are gathered
    gathered = merged.withColumn("sound", sound).where("sound AND text IS NOT NULL").groupBy(*CONVERSATION).agg(F.sort_array(F.collect_list(entry)).alias("ordered"), F.bool_and("clocks_agree").alias("clocks_agree"))
    messages_out = F.transform("ordered", lambda m: F.struct(m.turn_index.alias("turn_index"), m.role.alias("role"), m.text.alias("text"), F.timestamp_micros(m["at"]).alias("sent_at")))
    return gathered.select(*CONVERSATION, messages_out.alias("messages"), "clocks_agree")
