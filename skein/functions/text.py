"""Feedback texts: normalising, truncating, and what can be read off them; column expressions only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.coerce import strip

#: The patterns that identify artefacts in feedback.
ANSI = r"\x1B[@-_][0-?]*[ -/]*[@-~]"
PATHS = r"(?:[A-Za-z]:)?[\\/\w.-]+\.(?:py|md|txt|json|yaml|yml|toml|ini|cfg|sh|js|ts|tsx|jsx)(?::\d+)?"
SELECTORS = r"\b[\w./-]+::[\w./-]+\b"
ERROR_LINE = r"(?i)error|exception|failed|traceback"
LINE_HINTS = r"(?:[A-Za-z]:)?[\\/\w.-]+\.\w+:\d+"
SYMBOLS = r"\b[a-zA-Z_][a-zA-Z0-9_]*\(\)"
MARKER = "<...truncated...>"


def normalize_text(text: Column) -> Column:
    """No ANSI codes, one kind of line end, no trailing blanks, at most one empty line in a row."""
    bare = F.regexp_replace(F.regexp_replace(text, ANSI, ""), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"[ \t\x0b\f]+(?=\n|$)", ""), r"\n{3,}", "\n\n"))


def head_tail(text: Column, head: int, tail: int) -> Column:
    """struct(text, truncated): the first and last words around a marker, if there are more than both."""
    words = F.split(strip(text), r"[ \t\n\r\x0b\f]+")
    long = F.size(words) > head + tail
    parts = ([F.array_join(F.slice(words, 1, head), " ")] if head else []) + [F.lit(MARKER)] + ([F.array_join(F.slice(words, -tail, tail), " ")] if tail else [])
    blank = F.coalesce(strip(text), F.lit("")) == ""
    cut = F.when(blank, "").when(long, F.concat_ws(" ", *parts)).otherwise(text)
    return F.struct(cut.alias("text"), (~blank & long).alias("truncated"))


def _all(text: Column, *patterns: str) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def artifact_identities(text: Column) -> Column:
    """Sorted selectors and file paths that the text names."""
    return _all(text, SELECTORS, PATHS)


def localization_hints(text: Column) -> Column:
    """Sorted path:line places, selectors and called symbols."""
    return _all(text, LINE_HINTS, SELECTORS, SYMBOLS)


def first_error_line(text: Column) -> Column:
    """The first line that speaks of an error, without blanks, dashes and colons around; null if none."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(ERROR_LINE))
    bare = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" -:\t"))), lambda x: x != "")
    return F.get(bare, F.lit(0))


def raw_payload(tool_output: Column) -> Column:
    """A tool's JSON output as labelled sections: what it wrote, and its other fields as JSON with sorted keys.

    With neither, the whole output as JSON. Null, broken JSON and other values than objects count as an empty object.
    The byte format of the JSON (blanks, escapes) is Python's, so this is an Arrow batch function.
    """

    @F.pandas_udf("string")
    def render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_sections(t) for t in texts], dtype=object)

    return render(tool_output)


def _sections(text) -> str:
    try:
        output = json.loads(text) if isinstance(text, str) else {}
    except (ValueError, RecursionError):
        output = {}
    output = output if isinstance(output, dict) else {}
    shown = [(name, str(output[key])) for name, key in (("STDOUT", "stdout"), ("STDERR", "stderr")) if str(output.get(key, ""))]
    if others := {k: v for k, v in output.items() if k not in ("stdout", "stderr")}:
        shown.append(("META", json.dumps(others, sort_keys=True)))
    return "\n\n".join(f"{name}:\n{body}" for name, body in shown) or json.dumps(output, sort_keys=True)


def feedback(tool_output: Column, head: int = 368, tail: int = 368) -> Column:
    """The feedback packet: text, truncated, digest of the whole payload, identities, error line, hints, and which of these make it self-contained."""
    raw = raw_payload(tool_output)
    payload = normalize_text(raw)
    cut = head_tail(payload, head, tail)
    identities, error, hints = artifact_identities(payload), first_error_line(payload), localization_hints(payload)
    named, told, placed = F.size(identities) > 0, F.coalesce(strip(error), F.lit("")) != "", F.size(hints) > 0
    return F.struct(
        cut["text"].alias("text"),
        cut["truncated"].alias("truncated"),
        F.sha2(raw, 256).alias("digest"),
        identities.alias("identities"),
        error.alias("error_line"),
        hints.alias("hints"),
        named.alias("has_identity"),
        told.alias("has_error"),
        placed.alias("has_hint"),
        (named & told & placed).alias("self_contained"),
    )


def statement_or_fallback(statement: Column, fail: Column, passing: Column, label: str) -> Column:
    """The statement; if blank, a label with the first four targets of each group and how many more there are."""
    more = lambda c: F.when(F.size(c) > 4, F.concat(F.lit(" (+"), (F.size(c) - 4).cast("string"), F.lit(" more)"))).otherwise("")
    shown = lambda c: F.concat(F.array_join(F.slice(c, 1, 4), ", "), more(c))
    made = F.concat(F.lit(label + ": must pass "), shown(fail), F.lit("; must keep "), shown(passing))
    return F.coalesce(F.nullif(strip(statement), F.lit("")), made)


def identity_key(statement: Column, fail: Column, passing: Column, kind: str) -> Column:
    """A digest that equal tasks share whatever the case, spacing and order of targets."""
    bare = strip(F.lower(F.regexp_replace(statement, r"[ \t\n\r\x0b\f]+", " ")))
    return F.sha2(F.concat_ws("\u0001", F.coalesce(bare, F.lit("")), F.array_join(F.array_sort(fail), "\u0002"), F.array_join(F.array_sort(passing), "\u0002"), F.lit(kind)), 256)


def target_error(fail: Column, passing: Column, most: int = 4096, longest: int = 512) -> Column:
    """The first rule that a pair of target lists breaks, or null."""
    rule = F.when(F.size(fail) == 0, "no fail_to_pass").when(F.size(passing) == 0, "no pass_to_pass")
    rule = rule.when(F.size(fail) > F.size(F.array_distinct(fail)), "repeated fail_to_pass").when(F.size(passing) > F.size(F.array_distinct(passing)), "repeated pass_to_pass")
    rule = rule.when(F.arrays_overlap(fail, passing), "overlap")
    for name, c in (("fail_to_pass", fail), ("pass_to_pass", passing)):
        rule = rule.when(F.size(c) > most, f"too many {name}").when(F.exists(c, lambda x: F.length(x) > longest), f"too long {name}")
    return rule


def go_test_regex(targets: Column) -> Column:
    """One anchored pattern for all targets; of none, a pattern that matches nothing but the empty name."""
    escaped = F.transform(targets, lambda x: F.regexp_replace(x, r"([.^$*+?()\[\]{}|\\-])", r"\\$1"))
    return F.when(F.size(targets) == 0, "^$").otherwise(F.concat(F.lit("^(?:"), F.array_join(escaped, "|"), F.lit(")$")))


#: Points of a match that is exact, at the beginning, or inside.
NAME_POINTS, PATH_POINTS, WORD_POINTS = (4000, 2600, 1800), (3200, 1400, 900), (900, 600, 350)
#: Points of a word elsewhere in the path, of all words found, of the query without blanks inside the name, of its letters in order in the name or the path; what each folder costs.
WORD_IN_PATH, ALL_WORDS, JOINED, LETTERS_IN_NAME, LETTERS_IN_PATH, FOLDER = 180, 500, 220, 140, 80, 25


def path_score(path: Column, query: str) -> Column:
    """A fuzzy score of a path for a query; null where nothing of the query is in it.

    Additive: the query against the file's name and against the path, each of
    its words against the name, else the path, and the query as a run of
    letters. Deep and long paths lose.
    """
    whole, words = query.lower().strip(), query.lower().split()
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    fit = lambda c, needle, points: F.when(c == needle, points[0]).when(c.startswith(needle), points[1]).when(c.contains(needle), points[2])
    letters = lambda c: c.rlike("(?s)" + ".*".join(re.escape(x) for x in "".join(words)))
    found = [fit(name, whole, NAME_POINTS), fit(low, whole, PATH_POINTS)]
    found += [F.coalesce(fit(name, w, WORD_POINTS), F.when(low.contains(w), WORD_IN_PATH)) for w in words]
    if words:
        found.append(F.when(reduce(lambda a, w: a & low.contains(w), words, F.lit(True)), ALL_WORDS))
        joined = F.when(name.contains("".join(words)), JOINED) if len(words) > 1 else F.lit(None).cast("int")
        found.append(F.coalesce(joined, F.when(letters(name), LETTERS_IN_NAME), F.when(letters(low), LETTERS_IN_PATH)))
    points = reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), found, F.lit(0))
    return F.when(points > 0, points - FOLDER * (F.size(F.split(path, "/")) - 1) - F.length(path))


def line_range(text: Column, first: int, last: int, most_lines: int, most_chars: int) -> Column:
    """struct(text, truncated): lines ``first`` to ``last`` with their numbers, at most ``most_lines`` of them and ``most_chars`` characters."""
    lines = F.split(text, "\n")
    wanted = F.slice(lines, first, max(last - first + 1, 0))
    body = F.array_join(F.transform(F.slice(wanted, 1, most_lines), lambda x, i: F.concat(F.lpad((i + first).cast("string"), 8, " "), F.lit("\t"), x)), "\n")
    return F.struct(F.substring(body, 1, most_chars).alias("text"), ((F.size(wanted) > most_lines) | (F.length(body) > most_chars)).alias("truncated"))
