"""Trajectories, task rows, batches and steps as frames of records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import arrays as A
from skein.functions import coerce as C
from skein.functions import text as X
from skein.functions import toolcalls as TC
from skein.functions.coerce import strip

#: The stages whose masks a preprocessed turn carries; all of them train thoughts and tool calls.
STAGES = ("format_rft", "positive_rft", "turn_sdpo")
#: Spellings of the partitions of a task pool.
PARTITIONS = {"train": ("train", "training"), "eval": ("eval", "val", "validation", "heldout", "held_out", "test"), "all": ("all", "")}

_TURN = "calls array<string>, blocks array<struct<type:string,text:string>>, labels array<string>, parse_error string, validation_errors array<string>"


def labelled_turn(text: Column, external: Column, thinking: Column, most: int = 1) -> Column:
    """struct of a turn's calls, labelled blocks, word labels and errors.

    A blank text is made up from ``external`` (a JSON array of calls) and ``thinking``. The labels
    count words, one at least per block; ``token_records`` gives those of a tokenizer.
    """

    def read(said, outside, thought):
        if isinstance(said, str) and said:
            thinking, calls = TC.parse_turn(said, most)
        else:
            try:
                given = json.loads(outside) if isinstance(outside, str) else []
            except ValueError:
                given = None
            if not isinstance(given, list) or not given:
                raise TC.TurnError("external calls must be an array with a call")
            thinking, calls = thought if isinstance(thought, str) else None, [TC._call(c) for c in given]
        blocks = ([("think", thinking)] if thinking else []) + [("tool_call", TC.render_call(c)) for c in calls]
        labels = [kind for kind, body in blocks for _ in range(max(1, len(body.split())))]
        wrong = [f"tool_call[{i}]: {e}" for i, c in enumerate(calls) for e in TC.validation_errors(c)]
        return [json.dumps(c, sort_keys=True) for c in calls], [{"type": k, "text": b} for k, b in blocks], labels, None, wrong

    @F.pandas_udf(_TURN)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for row in zip(*columns):
                try:
                    rows.append(read(*row))
                except TC.TurnError as e:
                    rows.append(([], [], [], str(e), []))
            yield pd.DataFrame(rows, columns=["calls", "blocks", "labels", "parse_error", "validation_errors"])

    return run(text, external, thinking)


def preprocess(df: DataFrame, most: int = 1) -> DataFrame:
    """Trajectory rows ready for training: calls, labels, a mask per stage, counts, ``format_valid`` and the feedback packet.

    Reads prompt, assistant_response, tool_output and, where the frame has
    them, external_tool_calls and thinking; further columns stay. Broken turns
    keep their row with ``parse_error``, empty labels and no feedback.
    """
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    read = df.withColumn("_turn", labelled_turn(F.col("assistant_response"), have("external_tool_calls"), have("thinking"), most)).withColumn("_feedback", X.feedback(F.col("tool_output")))
    mask = A.action_mask(F.col("_turn.labels"))
    sound = F.col("_turn.parse_error").isNull()
    return read.withColumns(
        {
            "tool_calls": F.col("_turn.calls"),
            "label_blocks": F.col("_turn.blocks"),
            "token_labels": F.col("_turn.labels"),
            **{f"action_mask_{stage}": mask for stage in STAGES},
            "action_tokens": F.aggregate(mask, F.lit(0), lambda a, x: a + x),
            "parse_error": F.col("_turn.parse_error"),
            "validation_errors": F.col("_turn.validation_errors"),
            "format_valid": sound & (F.size("_turn.validation_errors") == 0),
            "feedback": F.when(sound, F.col("_feedback")),
        }
    ).drop("_turn", "_feedback")


def task_rows(df: DataFrame, label: str) -> DataFrame:
    """Typed task rows with ``error`` where one is unusable; nothing is thrown, so broken rows can be counted.

    Image trimmed, targets as arrays, a blank statement made from the targets, ``prompt_source`` tells which.
    """
    fail, passing = C.target_list(F.col("fail_to_pass")), C.target_list(F.col("pass_to_pass"))
    rows = df.withColumns({"image_name": strip(F.col("image_name")), "fail_to_pass": fail, "pass_to_pass": passing})
    blank = F.coalesce(strip(F.col("problem_statement")), F.lit("")) == ""
    error = F.when(F.coalesce(F.col("image_name"), F.lit("")) == "", "no image").otherwise(X.target_error(F.col("fail_to_pass"), F.col("pass_to_pass")))
    return rows.withColumns(
        {
            "prompt_source": F.when(blank, "targets").otherwise("statement"),
            "problem_statement": X.statement_or_fallback(F.col("problem_statement"), F.col("fail_to_pass"), F.col("pass_to_pass"), label),
            "error": error,
        }
    )


def nested_task_rows(tasks: DataFrame, key: str, most_chars: int = 4000) -> DataFrame:
    """Usable tasks with a statement of fewer than ``most_chars`` characters, as prompt messages and nested ground truth."""
    kept = tasks.where("error IS NULL").where(F.length("problem_statement") < most_chars)
    message = F.struct(F.lit("user").alias("role"), F.col("problem_statement").alias("content"))
    truth = F.struct("task_id", "image_name", "fail_to_pass", "pass_to_pass")
    return kept.select(key, F.array(message).alias("prompt"), truth.alias("ground_truth"))


def partition_rows(df: DataFrame, column: str, asked: str, allowed: tuple[str, ...] = ("train", "eval", "all")) -> DataFrame:
    """The rows of the partition ``asked`` in any of its spellings; one that isn't ``allowed`` (a partial cache) is refused."""
    bare = asked.strip().lower()
    name = next((k for k, spellings in PARTITIONS.items() if bare in spellings), None)
    if name not in allowed:
        raise ValueError(f"partition {asked!r} isn't one of {', '.join(allowed)}")
    return df if name == "all" else df.where(F.lower(strip(F.col(column))).isin(*PARTITIONS[name]))


def first_rows(df: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first ``most`` rows by ``order``; all without a limit."""
    return df if most is None else df.orderBy(order).limit(max(most, 0))


def flatten_batch(df: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """One row per place of the parallel ``arrays`` of a columnar batch, with ``row`` from 0; shorter arrays give nulls."""
    return df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("row", "_e")).select(*keep, "row", *(F.col(f"_e.{c}").alias(c) for c in arrays))


def final_turn(turns: Column, otherwise: Column) -> Column:
    """The last turn that isn't blank, else ``otherwise``."""
    return F.coalesce(F.try_element_at(F.filter(turns, lambda t: F.coalesce(strip(t), F.lit("")) != ""), F.lit(-1)), otherwise)


def flatten_steps(df: DataFrame, keys: list[str], order: str, steps: str) -> DataFrame:
    """The step lists of a run as one list of rows, in order: keys, the list's place, the step's place, and the step's fields."""
    return df.select(*keys, order, F.posexplode(steps).alias("place", "_s")).select(*keys, order, "place", "_s.*")


def rows_for_task(df: DataFrame, task: str, fallback: str = "") -> DataFrame:
    """The rows of a task by its trimmed id; rows without one belong to the fallback task."""
    own = F.coalesce(strip(F.col("task_id")), F.lit(""))
    return df.where((own == task) | ((own == "") & F.lit(bool(fallback) and fallback == task)) if task else (own == "") & F.lit(False))


def text_search(df: DataFrame, key: str, text: str, needle: str, most: int) -> DataFrame:
    """The first ``most`` lines that hold ``needle``, and one more where there are more; key, line_no from 1, line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_k", "line")).where(F.col("line").contains(needle))
    return lines.select(key, (F.col("_k") + 1).cast("bigint").alias("line_no"), "line").orderBy(key, "line_no").limit(most + 1)


def attempt_records(messages: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """One flat record per attempt of (keys, turn_index, role, text): its turns, their lengths in words, its tool blocks, whether a turn was cut to ``limit`` words.

    An attempt's turns are the record itself, so they are gathered per attempt only.
    """
    words = F.size(F.split(strip(F.col("text")), r"\s+"))
    entry = F.struct("turn_index", "role", "text", words.alias("words"))
    per = messages.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_m"))
    said = lambda role: F.filter("_m", lambda m: m["role"] == role)
    return per.select(
        *keys,
        F.transform(said("assistant"), lambda m: m["text"]).alias("assistant_turns"),
        F.transform(said("assistant"), lambda m: m["words"]).alias("turn_lengths"),
        F.transform(said("tool"), lambda m: m["text"]).alias("tool_blocks"),
        F.exists(said("assistant"), lambda m: m["words"] > limit).alias("capped"),
    )


def generation_length(mask: Column, labels: Column, text_tokens: Column) -> Column:
    """A row's generated tokens: those of its mask, else its labels that aren't -100, else its text's tokens; null where nothing is known."""
    return F.coalesce(F.size(F.filter(mask, lambda x: x > 0)), F.size(F.filter(labels, lambda x: x != -100)), text_tokens)


def turn_masks(turns: Column, response: Column) -> Column:
    """Each turn's mask, padded with zeros to the response's width and set only where the response's is."""
    fit = lambda t: F.concat(F.slice(t, F.lit(1), F.size(response)), F.array_repeat(F.lit(0), F.greatest(F.size(response) - F.size(t), F.lit(0))))
    return F.transform(turns, lambda t: F.zip_with(fit(t), response, lambda a, b: F.when((a > 0) & (b > 0), 1).otherwise(0)))


def prompt_budget(configured: int, tokens_per_device: int, devices: int, response_width: int) -> int:
    """The longest prompt that leaves room for the response; an error where none does."""
    room = tokens_per_device * max(devices, 1)
    if response_width <= 0 or room <= 0:
        return configured
    if room <= response_width:
        raise ValueError(f"response of {response_width} leaves no room in {room} tokens")
    return min(configured, room - response_width)


def loss_series(lines: DataFrame, text: str, run: list[str]) -> DataFrame:
    """First, last and least loss of each run and series (train, val) from lines ``step:N - train/loss:X``, the step of the least, and last minus first."""
    parts = []
    for series in ("train", "val"):
        pattern = F.lit(rf"step:\s*(\d+)\s*-.*?\b{series}/loss:\s*(-?[0-9.]+(?:[eE][-+]?\d+)?)")
        part = lambda k, kind, p=pattern: F.regexp_extract_all(text, p, F.lit(k))[0].try_cast(kind)
        held = lines.where(F.regexp_like(text, pattern))
        parts.append(held.select(*run, F.lit(series).alias("series"), part(1, "bigint").alias("step"), part(2, "double").alias("loss")))
    seen = parts[0].unionByName(parts[1]).where("step IS NOT NULL AND loss IS NOT NULL")
    per = seen.groupBy(*run, "series").agg(
        F.count("*").alias("n"),
        F.min_by("loss", F.struct("step", "loss")).alias("first"),
        F.max_by("loss", F.struct("step", "loss")).alias("last"),
        F.min("loss").alias("least"),
        F.min_by("step", F.struct("loss", "step")).alias("least_step"),
    )
    return per.withColumn("delta", F.col("last") - F.col("first"))


def load_tasks(spark: SparkSession, loader: Callable[[SparkSession, str, str], DataFrame], dataset: str, split: str, label: str) -> DataFrame:
    """The typed tasks of what a loader gives for a dataset and a split."""
    return task_rows(loader(spark, dataset, split), label)


def turn_blocks(messages: DataFrame, keys: list[str], order: str, role: str, text: str) -> DataFrame:
    """Per assistant entry, numbered from 0, its text and the tool blocks that follow it; blocks before the first belong to none."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.col(role) == "assistant"
    placed = messages.withColumn("_turn", F.sum(F.coalesce(said, F.lit(False)).cast("long")).over(by) - 1).where("_turn >= 0")
    blocks = F.sort_array(F.collect_list(F.when(F.col(role) == "tool", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return placed.groupBy(*keys, F.col("_turn").alias("turn")).agg(F.max(F.when(said, F.col(text))).alias("assistant"), F.transform(blocks, lambda b: b["t"]).alias("blocks"))


def feedback_signal(tool_output: Column, blocks: Column) -> Column:
    """Whether there is anything to learn from: output, an exit code that isn't zero, another field that isn't empty, or tool blocks."""
    fields = F.from_json(tool_output, "map<string,string>")
    filled = lambda k, v: (F.coalesce(strip(v), F.lit("")) != "") & ~((k != "stdout") & (k != "stderr") & v.isin("[]", "{}", "false", "0"))
    told = F.exists(F.map_entries(fields), lambda e: F.when(e["key"] == "exit_code", F.coalesce(e["value"].cast("string"), F.lit("0")) != "0").otherwise(filled(e["key"], e["value"])))
    return F.coalesce(told, F.lit(False)) | (F.coalesce(F.size(blocks), F.lit(0)) > 0)


def first_seen(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(kind, value, first): every distinct value of each column and where it stands first, for lists in order of appearance; one pass, one shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(order, pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.kind", "p.value").agg(F.min(order).alias("first"))


def histogram(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Per key the counts of a column's values as ``name:count`` in the order of names; a missing value is ``none``."""
    counted = df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("none")).alias("v")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda e: F.concat(e["v"], F.lit(":"), e["n"].cast("string"))), ",").alias(out))


def step_report(df: DataFrame, step: str, selected: Column, held_out: Column, text: str, histograms: list[str]) -> DataFrame:
    """Per step the rows, those selected, those held out and of these selected, the mean length in words, and a histogram of each column."""
    words = F.size(F.split(strip(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    on = lambda c: F.coalesce(c, F.lit(False))
    out = df.groupBy(step).agg(F.count("*").alias("n"), F.count_if(on(selected)).alias("selected"), F.count_if(on(held_out)).alias("held_out"), F.count_if(on(held_out) & on(selected)).alias("held_out_selected"), F.avg(F.when(F.col(text).isNotNull(), words)).alias("mean_words"))
    for c in histograms:
        out = out.join(histogram(df, [step], c, f"{c}_counts").withColumnRenamed(step, "_step"), F.col(step).eqNullSafe(F.col("_step"))).drop("_step")
    return out


def merged_map(truth: Column, extra: Column) -> Column:
    """The entries of both maps, ``extra``'s winning wherever it has the key, null or not."""
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(extra, empty)
    return F.map_concat(F.map_filter(F.coalesce(truth, empty), lambda k, _: ~F.map_contains_key(own, k)), own)


def attempt_resolved(terminal: Column, exit_codes: Column) -> Column:
    """An attempt is resolved if it ended by itself, has steps, and every step's exit code is zero."""
    return F.coalesce(terminal, F.lit(False)) & (F.coalesce(F.size(exit_codes), F.lit(0)) > 0) & F.forall(F.coalesce(exit_codes, F.array().cast("array<int>")), lambda c: F.coalesce(c == 0, F.lit(False)))
