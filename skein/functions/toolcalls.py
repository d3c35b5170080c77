"""Tool calls in assistant turns: parsing, validating and rendering, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments of the six tools as name -> (type, required, least, most).
TOOLS = {
    "bash": {"command": ("str", True, 1, None), "cwd": ("str", False, 1, None), "timeout_sec": ("int", False, 1, 7200)},
    "read": {"path": ("str", True, 1, None), "start_line": ("int", False, 1, None), "end_line": ("int", False, 1, None)},
    "file_search": {"query": ("str", True, 1, None), "root": ("str", False, 1, None), "top_k": ("int", False, 1, 50)},
    "text_search": {"query": ("str", True, 1, None), "path_hint": ("str", False, 1, None), "top_k": ("int", False, 1, 50)},
    "apply_patch": {"patch": ("str", True, 1, None), "path": ("str", False, 1, None), "description": ("str", False, None, None)},
    "submit": {"final_response": ("str", True, 1, None), "changed_paths": ("list", False, None, None)},
}
RENAMED = {"answer": "submit", "edit": "apply_patch"}
TURN_SCHEMA = "thinking string, tools array<string>, calls array<string>, error string"
_TYPES = {"str": str, "int": int, "list": list}


class TurnError(ValueError):
    """What is wrong with a turn."""


def _call(value) -> dict:
    if not isinstance(value, dict):
        raise TurnError("a tool call must be an object")
    tool = str(value.get("tool", "")).strip().lower()
    tool = RENAMED.get(tool, tool)
    if tool not in TOOLS:
        raise TurnError(f"unknown tool {tool!r}")
    args = value.get("args", {})
    if not isinstance(args, dict):
        raise TurnError("args must be an object")
    return {"tool": tool, "args": args}


#: The blocks of a turn; JSON strings are taken whole, so a closing tag inside one does no harm. What opens and never closes comes last.
_BLOCKS = re.compile(
    r"""<think>(?P<thought>.*?)</think>
    |<tool_call>(?P<call>(?:"(?:[^"\\]|\\.)*+"|[^"<]++|<(?!/tool_call>))*+)</tool_call>
    |<(?P<unclosed>think|tool_call)>""",
    re.S | re.X,
)


def _within_limits(calls: list[dict], most: int) -> list[dict]:
    """The calls of a turn, if there are some, no more than ``most``, and none beside a submission."""
    tools = [c["tool"] for c in calls]
    for broken, rule in ((not tools, "no tool call"), ("submit" in tools and len(tools) > 1, "submit must stand alone"), (len(tools) > most, f"{len(tools)} tool calls, at most {most}")):
        if broken:
            raise TurnError(rule)
    return calls


def _begins_with_json(text: str) -> bool:
    try:
        json.JSONDecoder().raw_decode(text.lstrip())
    except (ValueError, RecursionError):
        return False
    return True


def parse_json_turn(text: str, most: int = 1) -> tuple[str | None, list[dict]]:
    """Thinking and calls of a turn whose calls are JSON; TurnError tells what is wrong.

    One pattern splits the turn into its blocks, then the list of blocks is
    judged. Text between blocks is ignored.
    """
    blocks = [(m.lastgroup, m[m.lastgroup], m.end()) for m in _BLOCKS.finditer(text)]
    of = lambda kind: [body for k, body, _ in blocks if k == kind]
    for name, rest in ((body, text[end:]) for k, body, end in blocks if k == "unclosed"):
        raise TurnError("tool call isn't JSON" if name == "tool_call" and not _begins_with_json(rest) else f"{name.replace('_', ' ')} block isn't closed")
    if len(of("thought")) > 1:
        raise TurnError("more than one think block")
    try:
        bodies = [json.loads(body) for body in of("call")]
    except (ValueError, RecursionError):
        raise TurnError("tool call isn't JSON") from None
    return next((t.strip() or None for t in of("thought")), None), _within_limits([_call(b) for b in bodies], most)


def _xml_value(tool: str, name: str, node: ElementTree.Element):
    kind = TOOLS[tool].get(name, ("str",))[0]
    if kind == "list":
        return [item.text or "" for item in node]
    if len(node):
        raise TurnError(f"{name} must be text")
    text = node.text or ""
    if kind == "int":
        if not re.fullmatch(r"\s*-?\d+\s*", text):
            raise TurnError(f"{name} must be a whole number")
        return int(text)
    return text


def parse_xml_turn(text: str, most: int = 1) -> tuple[str | None, list[dict]]:
    """Thinking and calls of a turn whose calls are XML elements: <tool_call><tool>..</tool><args>..</args></tool_call>.

    Comments, declarations, processing instructions, namespaces and entities of
    one's own are refused, and so are repeated arguments.
    """
    thoughts = re.findall(r"<think>(.*?)</think>", text, re.S)
    if len(thoughts) > 1:
        raise TurnError("more than one think block")
    calls: list[dict] = []
    for body in re.findall(r"<tool_call>.*?</tool_call>", text, re.S):
        plain = re.sub(r"<!\[CDATA\[.*?\]\]>", "", body, flags=re.S)
        if re.search(r"<!|<\?|xmlns|&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", plain):
            raise TurnError("construct isn't allowed")
        try:
            root = ElementTree.fromstring(body)
        except ElementTree.ParseError:
            raise TurnError("tool call isn't XML") from None
        tool = (root.findtext("tool") or root.get("name") or "").strip().lower()
        tool = RENAMED.get(tool, tool)
        if tool not in TOOLS:
            raise TurnError(f"unknown tool {tool!r}")
        holder = root.find("args")
        args: dict = {}
        for node in holder if holder is not None else []:
            if node.tag in args:
                raise TurnError(f"{node.tag} is repeated")
            args[node.tag] = _xml_value(tool, node.tag, node)
        calls.append({"tool": tool, "args": args})
    return (thoughts[0].strip() or None) if thoughts else None, _within_limits(calls, most)


def parse_turn(text: str, most: int = 1, mode: str = "auto") -> tuple[str | None, list[dict]]:
    """``mode`` json, xml, or auto: the format by how the first call goes on; if it fails, the other, then the first error."""
    if mode != "auto":
        return (parse_json_turn if mode == "json" else parse_xml_turn)(text, most)
    opening = re.search(r"<tool_call>\s*(.)", text, re.S)
    order = [parse_xml_turn, parse_json_turn] if opening and opening[1] == "<" else [parse_json_turn, parse_xml_turn]
    kinds = {m == "<" for m in re.findall(r"<tool_call>\s*(.)", text, re.S)}
    if len(kinds) > 1:
        raise TurnError("JSON and XML calls are mixed")
    try:
        return order[0](text, most)
    except TurnError as first:
        try:
            return order[1](text, most)
        except TurnError:
            raise first from None


def validation_errors(call: dict) -> list[str]:
    """What a call's arguments break: unknown ones, missing ones, types, ranges, then the order of lines."""
    known, args = TOOLS[call["tool"]], call["args"]
    errors = [f"unknown {a}" for a in sorted(set(args) - set(known))]
    errors += [f"missing {a}" for a, (_, required, *_) in known.items() if required and a not in args]
    for a, (kind, _, least, most) in known.items():
        if a not in args:
            continue
        value = args[a]
        if not isinstance(value, _TYPES[kind]) or (kind == "list" and not all(isinstance(x, str) for x in value)):
            errors.append(f"{a} isn't {kind}")
        elif kind == "str" and least and len(value.strip()) < least:
            errors.append(f"{a} is empty")
        elif kind == "int" and (value < least or (most and value > most)):
            errors.append(f"{a} is out of range")
    lines = [args.get("start_line"), args.get("end_line")]
    if call["tool"] == "read" and all(isinstance(x, int) for x in lines) and lines[1] < lines[0]:
        errors.append("end_line before start_line")
    return errors


def render_call(call: dict, style: str = "json") -> str:
    """The call as a block; XML keeps texts in CDATA unless they hold its end, which falls back to JSON."""
    if style == "xml" and "]]>" not in json.dumps(call["args"]):
        def one(v):
            return "".join(f"<item><![CDATA[{x}]]></item>" for x in v) if isinstance(v, list) else str(v) if isinstance(v, int) else f"<![CDATA[{v}]]>"

        args = "".join(f"<{a}>{one(v)}</{a}>" for a, v in call["args"].items())
        return f"<tool_call><tool>{call['tool']}</tool><args>{args}</args></tool_call>"
    return f"<tool_call>{json.dumps(call)}</tool_call>"


def turn_column(text: Column, most: int = 1, mode: str = "auto") -> Column:
    """struct(thinking, tools, calls as JSON, error) of each turn; null and broken turns have an error."""

    @F.pandas_udf(TURN_SCHEMA)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                try:
                    thinking, calls = parse_turn(t if isinstance(t, str) else "", most, mode)
                    bad = [e for c in calls for e in validation_errors(c)]
                    rows.append((thinking, [c["tool"] for c in calls], [json.dumps(c, sort_keys=True) for c in calls], "; ".join(bad) or None))
                except TurnError as e:
                    rows.append((None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["thinking", "tools", "calls", "error"])

    return parse(text)


def chatml_payload(text: Column) -> Column:
    """struct(payload, error) of one ChatML assistant turn."""
    bare = F.btrim(text)
    start, end = "<|im_start|>assistant", "<|im_end|>"
    error = F.when(bare.isNull() | ~bare.startswith(start), "no assistant turn").when(~bare.contains(end), "turn isn't closed").when(~bare.endswith(end), "text after the turn")
    inner = F.btrim(F.substr(bare, F.lit(len(start) + 1), F.length(bare) - len(start) - len(end)))
    return F.struct(F.when(error.isNull(), F.regexp_replace(inner, r"^\s+|\s+$", "")).alias("payload"), error.alias("error"))


def call_flags(text: Column, most: int = 1) -> Column:
    """struct of flags of a turn with JSON calls: presence, count, parse, submit alone, allowed tools, required arguments, balanced thoughts.

    Column expressions only, for turns whose JSON strings hold no closing tag; ``turn_column`` reads any turn.
    """
    turn = F.coalesce(text, F.lit(""))
    bodies = F.regexp_extract_all(turn, F.lit("(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    tags = lambda tag: F.size(F.split(turn, tag, -1)) - 1
    n = F.size(bodies)
    field = lambda x, path: F.get_json_object(x, f"$.{path}")
    raw = F.transform(bodies, lambda x: F.lower(F.btrim(F.coalesce(field(x, "tool"), F.lit("")))))
    tools = F.transform(raw, lambda t: F.coalesce(F.element_at(F.create_map(*(F.lit(w) for kv in RENAMED.items() for w in kv)), t), t))

    def complete(x):
        tool = F.lower(F.btrim(field(x, "tool")))
        out = F.lit(True)
        for name, args in TOOLS.items():
            names = [name, *(old for old, new in RENAMED.items() if new == name)]
            for arg, (_, required, *_) in args.items():
                if required:
                    out = out & (~tool.isin(*names) | (F.btrim(F.coalesce(field(x, f"args.{arg}"), F.lit(""))) != ""))
        return out

    parsed = (n == tags("<tool_call>")) & (n > 0) & F.forall(raw, lambda t: t != "")
    return F.struct(
        (n > 0).alias("has_call"),
        n.cast("bigint").alias("n_calls"),
        ((n > 0) & (n <= most)).alias("count_valid"),
        parsed.alias("parse_valid"),
        (~F.array_contains(tools, "submit") | (n == 1)).alias("submit_alone"),
        (parsed & F.forall(tools, lambda t: t.isin(*TOOLS))).alias("allowed_tools"),
        (parsed & F.forall(bodies, complete)).alias("required_args"),
        (tags("<think>") == tags("</think>")).alias("think_balanced"),
    )


def xml_schema(tool: str) -> list[tuple[str, str, bool, str | None]]:
    """The arguments of a tool as XML: name, kind, whether it is required, and the tag of a list's items, in the order of the registry."""
    return [(name, kind, required, "item" if kind == "list" else None) for name, (kind, required, *_) in TOOLS[RENAMED.get(tool, tool)].items()]
