"""Coercions of loosely typed values, as column expressions (nothing leaves the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true and false.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")
VERDICT_TRUE = ("pass", "passed", "success", "resolved")
VERDICT_FALSE = ("fail", "failed", "error", "unresolved")
SPACE = r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, SPACE, "")


def coerce_bool(text: Column, fallback: Column, blank_is_false: bool = True) -> Column:
    """true or false by its word; a null or any other text is ``fallback``."""
    word = F.lower(strip(text.cast("string")))
    false = FALSE_WORDS + (("",) if blank_is_false else ())
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*false), False).otherwise(fallback)


def optional_verdict(text: Column) -> Column:
    """true, false or null; also by the words that test runners use."""
    word = F.lower(strip(text.cast("string")))
    return F.when(word.isin(*TRUE_WORDS, *VERDICT_TRUE), True).when(word.isin(*FALSE_WORDS, *VERDICT_FALSE), False)


def first_verdict(*texts: Column) -> Column:
    """The verdict of the first value that has one."""
    return F.coalesce(*(optional_verdict(t) for t in texts))


def coerce_int(text: Column, fallback: Column) -> Column:
    """A whole number, also written as 3.0 or with blanks around; else ``fallback``."""
    bare = strip(text.cast("string"))
    whole = F.regexp_extract(bare, r"^([+-]?\d{1,18})(?:\.0*)?$", 1)
    return F.when(whole != "", whole.cast("bigint")).otherwise(fallback)


def exit_code(text: Column) -> Column:
    """A whole number, also of a truth value (0 or 1) or a fraction without rest; else null."""
    word = F.lower(strip(text.cast("string")))
    return F.when(word.isin("true", "false"), (word == "true").cast("bigint")).otherwise(coerce_int(text, F.lit(None).cast("bigint")))


def step_index(text: Column, fallback: Column) -> Column:
    """struct(value, error): null and blank take ``fallback``; fractions, negatives and words are errors."""
    bare = strip(text.cast("string"))
    number = F.when(bare.rlike(r"^\d{1,18}$"), bare.cast("bigint"))
    missing = bare.isNull() | (bare == "")
    error = F.when(~missing & number.isNull(), F.lit("step_index must be a whole number from 0 on"))
    return F.struct(F.when(missing, fallback).otherwise(number).alias("value"), error.alias("error"))


def target_list(text: Column) -> Column:
    """Test targets of a JSON list, comma, newline or single text; trimmed, without blanks, in order."""
    bare = strip(text)
    listed = F.from_json(F.when(bare.startswith("[") & bare.endswith("]"), bare), "array<string>")
    parts = F.when(bare.contains(","), F.split(bare, ",")).otherwise(F.split(bare, "\n"))
    items = F.transform(F.coalesce(listed, parts), strip)
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def target_set(text: Column) -> Column:
    """``target_list`` without repetitions."""
    return F.array_distinct(target_list(text))


def unique_in_order(values: Column) -> Column:
    """Trimmed, without blanks and repetitions, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")))


def canonical_tool(name: Column) -> Column:
    """One of the six tools, or null; two other names are understood."""
    word = F.lower(strip(name))
    renamed = F.when(word == "answer", "submit").when(word == "edit", "apply_patch").otherwise(word)
    return F.when(renamed.isin("bash", "read", "file_search", "text_search", "apply_patch", "submit"), renamed)


def external_tool(name: Column, command: Column) -> Column:
    """The tool that a call of an outside tool set amounts to, or null."""
    word = F.lower(strip(name))
    edits = F.when(command == "view", "read").when(command.isin("create", "str_replace", "insert", "undo_edit"), "apply_patch")
    return F.when(word == "bash", "bash").when(word.isin("submit", "answer"), "submit").when(word == "str_replace_editor", edits)


def family_of_task(task_id: Column, family: Column) -> Column:
    """The given family, else what stands before ``__`` in the part after the last dot."""
    tail = F.substring_index(task_id, ".", -1)
    derived = F.when(tail.contains("__"), F.element_at(F.split(tail, "__"), 2))
    return F.coalesce(F.nullif(strip(family), F.lit("")), F.nullif(derived, F.lit("")), F.lit("unknown"))


def resolved_task_id(first: Column, second: Column, dataset: str, row_index: Column) -> Column:
    """The first id that isn't blank, else one made of data set and row."""
    named = F.coalesce(F.nullif(strip(first), F.lit("")), F.nullif(strip(second), F.lit("")))
    return F.coalesce(named, F.concat(F.lit(dataset + ":"), row_index.cast("string")))


def file_slug(text: Column, fallback: str) -> Column:
    """A name that is safe in a file system."""
    slug = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def group_id(task_id: Column, attempt: Column) -> Column:
    """The id of one attempt's group."""
    return F.concat(task_id, F.lit("#attempt-"), attempt.cast("string"))
