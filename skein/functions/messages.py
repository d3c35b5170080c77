"""Messages and prompts as arrays of (role, content), and the blocks made of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.coerce import strip
from skein.functions.text import MARKER


def known_roles(messages: Column) -> Column:
    """Messages of system, user and assistant that have content, trimmed; tool messages become the user's."""
    renamed = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"), strip(m["content"]).alias("content")))
    return F.filter(renamed, lambda m: m["role"].isin("system", "user", "assistant") & (F.coalesce(m["content"], F.lit("")) != ""))


def prompt_of(messages: Column) -> Column:
    """The messages without the assistant's at the end."""
    last = F.aggregate(F.transform(messages, lambda m, i: F.when(m["role"] != "assistant", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(messages, F.lit(1), last)


def turn_block(index: Column, assistant: Column, tools: Column) -> Column:
    """The text of one turn: its number, what the assistant said and each tool's response."""
    blocks = F.transform(tools, lambda t, i: F.concat(F.lit("[TOOL_RESPONSE_"), (i + 1).cast("string"), F.lit("]\n"), t))
    return F.concat_ws("\n", F.concat(F.lit("[TURN_"), index.cast("string"), F.lit("]")), F.concat(F.lit("[ASSISTANT]\n"), assistant), F.array_join(blocks, "\n"))


def sections(*named: tuple[str, Column]) -> Column:
    """Headed sections in order, blank ones left out."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(strip(c), F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), strip(c))) for name, c in named))


def known_paths(paths_newest_last: Column, most: int = 10) -> Column:
    """Distinct paths, newest first, at most ``most``."""
    return F.slice(F.array_distinct(F.reverse(paths_newest_last)), 1, most)


def tagged_block(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null if either is missing."""
    after = F.substr(text, F.instr(text, start) + len(start))
    return F.when((F.instr(text, start) > 0) & (F.instr(after, end) > 0), F.substring_index(after, end, 1))


def compacted(parts: list[tuple[str, Column, int]], budget: int) -> Column:
    """struct(text, truncated): the parts joined by empty lines, blank ones left out, or cut to ``budget`` words.

    Parts are cut in the order given, each down to its least number of words
    (0: it may go), until all fit; what then is still too long is cut off.
    """
    texts = [F.coalesce(c, F.lit("")) for _, c, _ in parts]
    words = [F.filter(F.split(t, r"\s+"), lambda w: w != "") for t in texts]
    total = reduce(lambda a, w: a + F.size(w), words, F.lit(0))
    over, kept = F.greatest(total - budget, F.lit(0)), []
    for w, (_, _, least) in zip(words, parts):
        cut = F.least(over, F.greatest(F.size(w) - least, F.lit(0)))
        kept.append(F.slice(w, F.lit(1), F.size(w) - cut))
        over = over - cut
    flat = F.array_join(F.slice(F.concat(*kept), F.lit(1), F.lit(budget)), " ")
    whole = F.array_join(F.array_compact(F.array(*(F.when(strip(t) != "", t) for t in texts))), "\n\n")
    return F.struct(F.when(total > budget, flat).otherwise(whole).alias("text"), (total > budget).alias("truncated"))


def response_payload(tool_output: Column, head: int = 368, tail: int = 368) -> Column:
    """A tool's JSON output as a tagged block: keys sorted, every long text in it cut around a marker."""

    def short(value):
        if isinstance(value, str):
            words = value.split()
            return " ".join([*words[:head], MARKER, *words[-tail:]]) if len(words) > head + tail else value
        if isinstance(value, dict):
            return {k: short(v) for k, v in value.items()}
        return [short(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf("string")
    def render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                try:
                    value = json.loads(t) if isinstance(t, str) and t else {}
                except ValueError:
                    value = {"stdout": t}
                value = value if isinstance(value, dict) else {"stdout": value}
                if not value.get("metadata"):
                    value.pop("metadata", None)
                out.append(f"<tool_response>\n{json.dumps(short(value), sort_keys=True)}\n</tool_response>")
            yield pd.Series(out, dtype=object)

    return render(tool_output)


def completion_text(payload: Column) -> Column:
    """The assistant's text of a completion payload: its content, else its text parts joined, else its first tool call as a block; null if there is none.

    A call's block is canonical JSON, so what has only a call is read in an Arrow batch; all else by column expressions.
    """
    at = "$.choices[0].message."
    content = F.get_json_object(payload, at + "content")
    listed = F.from_json(content, "array<struct<text:string>>")
    parts = F.when(content.startswith("["), F.nullif(strip(F.array_join(F.transform(F.filter(listed, lambda x: x["text"].isNotNull()), lambda x: x["text"]), "")), F.lit("")))
    plain = F.when(~content.startswith("[") & (strip(content) != ""), content)
    name = F.nullif(strip(F.get_json_object(payload, at + "tool_calls[0].function.name")), F.lit(""))
    arguments = F.get_json_object(payload, at + "tool_calls[0].function.arguments")

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, given in batches:
            out = []
            for n, text in zip(names, given):
                try:
                    args = json.loads(text) if isinstance(text, str) else {}
                except ValueError:
                    args = {}
                args = args if isinstance(args, dict) else {}
                out.append("<tool_call>" + json.dumps({"tool": n, "args": args}, separators=(",", ":")) + "</tool_call>" if isinstance(n, str) else None)
            yield pd.Series(out, dtype=object)

    return F.coalesce(plain, parts, F.when(name.isNotNull(), call(name, arguments)))


def loop_messages(raw: Column, contract: str, follow_up: str) -> Column:
    """The messages an agent goes on from: those with role and content, the contract before the system's text or as its own message, and a follow-up where the last word isn't the user's."""
    kept = F.filter(F.transform(raw, lambda m: F.struct(F.lower(strip(m["role"])).alias("role"), strip(m["content"]).alias("content"))), lambda m: (F.coalesce(m["role"], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != ""))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    led = F.coalesce(F.get(kept, F.lit(0))["role"] == "system", F.lit(False))
    first = F.when(led, message("system", F.concat(F.lit(contract + "\n\n"), F.get(kept, F.lit(0))["content"]))).otherwise(message("system", F.lit(contract)))
    rest = F.when(led, F.slice(kept, F.lit(2), F.size(kept))).otherwise(kept)
    whole = F.concat(F.array(first), rest)
    return F.when(F.element_at(whole, -1)["role"] == "user", whole).otherwise(F.concat(whole, F.array(message("user", F.lit(follow_up)))))


def tool_messages(blocks: Column) -> Column:
    """A user message per tool block that isn't blank, trimmed."""
    kept = F.filter(F.transform(blocks, strip), lambda b: F.coalesce(b, F.lit("")) != "")
    return F.transform(kept, lambda b: F.struct(F.lit("user").alias("role"), b.alias("content")))


def content_text(content: Column) -> Column:
    """A message's content as text: a string as it is, a JSON list as its texts and scalars joined by line breaks, blank ones left out."""
    listed = F.from_json(F.when(strip(content).startswith("["), content), "array<string>")
    texts = F.transform(listed, lambda x: strip(F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)))
    return F.coalesce(F.array_join(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n"), content)


def generation_messages(system: Column, user: Column, history: Column) -> Column:
    """System, user and history as messages; a tool-response block of valid JSON becomes the user's, others keep their role."""
    opening, closing = "<tool_response>", "</tool_response>"

    def entry(m):
        text = strip(m["content"])
        inner = strip(F.substr(text, F.lit(len(opening) + 1), F.length(text) - len(opening) - len(closing)))
        block = text.startswith(opening) & text.endswith(closing) & F.get_json_object(inner, "$").isNotNull()
        return F.when(F.coalesce(block, F.lit(False)), F.struct(F.lit("user").alias("role"), F.concat(F.lit("Tool response:\n"), inner).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content")))

    first = F.array(*(F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", system), ("user", user))))
    return F.concat(first, F.transform(history, entry))
