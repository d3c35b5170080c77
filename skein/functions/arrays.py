"""Masks, labels and test results held in arrays; higher-order column expressions, no explode and no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAINED = ("think", "tool_call")


def action_mask(labels: Column) -> Column:
    """1 for tokens of thoughts and tool calls, 0 for others; null and unknown labels are 0."""
    return F.transform(labels, lambda x: F.coalesce(x.isin(*TRAINED), F.lit(False)).cast("int"))


def label_of_offsets(offsets: Column, spans: Column) -> Column:
    """A label per token (start, stop): tool_call if it overlaps a span of one, else think, else other; empty tokens are other."""

    def label(o):
        over = lambda kind: F.exists(spans, lambda s: (s["label"] == kind) & (s["start"] < o["stop"]) & (o["start"] < s["stop"]) & (o["start"] < o["stop"]))
        return F.when(over("tool_call"), "tool_call").when(over("think"), "think").otherwise("other")

    return F.transform(offsets, label)


def mask_violations(mask: Column, allowed: Column) -> Column:
    """Positions where ``mask`` is set but ``allowed`` isn't, or where ``allowed`` ends."""
    return F.filter(F.transform(mask, lambda x, i: F.when((x > 0) & (F.coalesce(F.get(allowed, i), F.lit(0)) <= 0), i)), lambda i: i.isNotNull())


def valid_length(attention: Column, width: int) -> Column:
    """How many of the last ``width`` attention bits are set, within 0 and ``width``."""
    tail = F.slice(attention, F.greatest(F.size(attention) - width + 1, F.lit(1)), F.lit(width))
    return F.least(F.greatest(F.aggregate(tail, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0)), F.lit(width))


def reward_at_last(mask: Column, reward: Column, width: int) -> Column:
    """``width`` zeros with the reward at the last set position, or at the last position if none is set."""
    last = F.aggregate(F.transform(mask, lambda x, i: F.when(x > 0, i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    at = F.when(last < 0, width - 1).otherwise(F.least(last, F.lit(width - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == at, reward).otherwise(F.lit(0.0)))


def clip_response(held: Column, new: Column, most: int, generated: bool) -> Column:
    """struct(tokens, mask, clipped): ``new`` appended to ``held`` up to ``most`` tokens; the mask is 1 for generated ones."""
    room = F.greatest(F.lit(most) - F.size(held), F.lit(0))
    added = F.slice(new, F.lit(1), room)
    mask = F.concat(F.array_repeat(F.lit(0), F.size(held)), F.array_repeat(F.lit(int(generated)), F.size(added)))
    return F.struct(F.concat(held, added).alias("tokens"), mask.alias("mask"), (F.size(new) > room).alias("clipped"))


def runs_of_ones(mask: Column) -> Column:
    """Maximal runs of set positions as structs (first, behind)."""
    set_at = lambda i: F.coalesce(F.get(mask, i), F.lit(0)) > 0
    starts = F.filter(F.transform(mask, lambda x, i: F.when((x > 0) & ~((i > 0) & set_at(i - 1)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(mask, lambda x, i: F.when((x > 0) & ~set_at(i + 1), i + 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("behind")))


def group_verdict(expected: Column, passed: Column, failed: Column) -> Column:
    """false if an expected test failed, else whether all expected ones passed; without expected ones whether none failed; null without any result."""
    silent = (F.size(passed) == 0) & (F.size(failed) == 0)
    hit = F.when(F.arrays_overlap(expected, failed), False).otherwise(F.size(F.array_except(expected, passed)) == 0)
    return F.when(silent, F.lit(None).cast("boolean")).when(F.size(expected) > 0, hit).otherwise(F.size(failed) == 0)


def missing_selectors(wanted: Column, listed: Column, most: int = 10) -> Column:
    """The first ``most`` wanted names that aren't listed, in order, repetitions kept."""
    return F.slice(F.filter(wanted, lambda x: ~F.array_contains(listed, x)), 1, most)


def lookup(map_column: Column, name: str) -> Column:
    """The value under ``name``, else under the first key that equals it in lower case."""
    other = F.filter(F.map_entries(map_column), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(map_column, F.lit(name)), F.get(other, F.lit(0))["value"])


def metric_allowed(key: Column, exact: list[str], prefixes: list[str], parts: list[str]) -> Column:
    """Whether a metric's key is named, or begins with or contains what is allowed."""
    rule = key.isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        rule = rule | key.startswith(p)
    for p in parts:
        rule = rule | key.contains(p)
    return rule
