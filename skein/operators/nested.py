"""Deeply nested records as flat tables that keep parent-child links.

JSON text is decoded, value by value, into Arrow nested arrays; that is the only
walk over values. From there on every array of objects becomes a child table by
its list offsets and parent indices, and the record's key, the parent's path
and its own position travel with it through vectorised ``take`` kernels.

Keys that are stored irregularly are settled first, over the whole table: a
key that holds an array (or an object) anywhere is read as one wherever a
string with its JSON, or a lone object in place of an array, stands instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread

#: Keys whose strings are what somebody or some program wrote, so never structure; arrays and objects stored under them as such are.
FREE_TEXT = frozenset({"stdout", "stderr", "text", "thinking", "content", "message", "command", "patch", "old", "new", "query", "code", "prompt"})

ARRAY, OBJECT, STRING_CONTAINER, LONE = 1, 2, 4, 8
ATTRS = "\x00attrs"


def decode(text: str | None):
    """The JSON value of ``text``, or None where it isn't complete JSON."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _container(text: str):
    """The array or object whose JSON the string is, else None."""
    head = text.lstrip()[:1]
    if head not in ("[", "{"):
        return None
    value = decode(text)
    return value if isinstance(value, (list, dict)) else None


def _clean(key: str) -> str:
    """``key`` without lone surrogates, which no Arrow string can hold."""
    return key if key.isascii() else key.encode("utf-8", "replace").decode()


def _kinds(value, seen: dict[str, int]) -> None:
    """Add what each key below ``value`` holds to ``seen``."""
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack.extend(x for x in at if isinstance(x, (list, dict)))
            continue
        for key, x in at.items():
            if isinstance(x, (list, dict)):
                stack.append(x)
            if key in FREE_TEXT:
                continue
            key = _clean(key)
            if isinstance(x, list):
                seen[key] = seen.get(key, 0) | ARRAY
            elif isinstance(x, dict):
                seen[key] = seen.get(key, 0) | OBJECT
            elif isinstance(x, str) and (inner := _container(x)) is not None:
                seen[key] = seen.get(key, 0) | STRING_CONTAINER
                stack.append(inner)


def irregular_keys(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Keys stored in more than one way, with the kinds they natively hold.

    One pass, pre-aggregated per task and merged by key. Only keys that are
    both irregular somewhere and structural somewhere come back, which is a
    part of the schema's vocabulary and doesn't grow with the rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    value = decode(text)
                    if isinstance(value, (list, dict)):
                        _kinds(value, seen)
            if len(seen) > 50_000:
                yield _kind_batch(seen)
                seen = {}
        yield _kind_batch(seen)

    kinds = df.select(*columns).mapInArrow(scan, "key string, kinds int").groupBy("key").agg(F.bit_or("kinds").alias("kinds"))
    array, obj, text = (F.col("kinds").bitwiseAND(k) > 0 for k in (ARRAY, OBJECT, STRING_CONTAINER))
    return {r.key: r.kinds for r in kinds.where((array & (obj | text)) | (obj & text)).toLocalIterator()}


def _kind_batch(seen: dict[str, int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int32())], ["key", "kinds"])


def _regular(key: str | None, x, kinds: dict[str, int]):
    """``x`` as the kind its key holds elsewhere."""
    known = kinds.get(key, 0) if key is not None else 0
    if isinstance(x, str):
        if not known & (ARRAY | OBJECT) or key in FREE_TEXT:
            return x
        inner = _container(x)
        if inner is None or (isinstance(inner, list) and not known & ARRAY):
            return x
        x = inner
    if isinstance(x, dict) and known & ARRAY and key not in FREE_TEXT:
        return [x]
    return x


def _skeleton(x: dict, kinds: dict[str, int], prefix: str, scalars: dict) -> dict:
    """What leads to arrays of objects; everything else goes to ``scalars``."""
    out = {}
    for key, value in x.items():
        key = _clean(key)
        value = _regular(key, value, kinds)
        if not isinstance(value, (list, dict)):
            scalars[prefix + key] = value
        elif isinstance(value, dict):
            if inner := _skeleton(value, kinds, f"{prefix}{key}.", scalars):
                out[key] = inner
        elif (items := _elements(value, key, kinds)) is not None:
            out[key] = items
        else:
            scalars[prefix + key] = value
    return out


def _elements(values: list, key: str | None, kinds: dict[str, int]) -> list | None:
    """The array with its objects as skeletons; None if it holds none, at any depth."""
    out, found = [], False
    for x in values:
        if isinstance(x, str) and key is not None and kinds.get(key, 0) & ARRAY:
            inner = _container(x)
            x = inner if isinstance(inner, dict) else x
        if isinstance(x, dict):
            scalars: dict = {}
            node = _skeleton(x, kinds, "", scalars)
            node[ATTRS] = json.dumps(scalars)
            out.append({"o": node})
            found = True
        elif isinstance(x, list):
            inner = _elements(x, None, kinds)
            out.append({"a": inner} if inner is not None else None)
            found |= inner is not None
        else:
            out.append(None)
    return out if found else None


def _join(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _text(indices: pa.Array) -> pa.Array:
    return pc.cast(indices, pa.string())


def _flatten(values: pa.Array, record: pa.Array, path: pa.Array, parent: pa.Array, name: str, depth: int, out: list) -> None:
    """Emit every object under ``values``; the other arrays run parallel to it."""
    kind = values.type
    if pa.types.is_struct(kind):
        for i in range(kind.num_fields):
            field = kind.field(i)
            if field.name == ATTRS:
                continue
            child = pc.struct_field(values, [i])
            if not (pa.types.is_struct(field.type) or pa.types.is_list(field.type)):
                continue
            keep = pc.indices_nonzero(pc.is_valid(child))
            if len(keep) == 0:
                continue
            base = path.take(keep)
            dotted = _join(base, pc.if_else(pc.equal(base, ""), field.name, "." + field.name))
            _flatten(child.take(keep), record.take(keep), dotted, parent.take(keep), field.name, depth, out)
        return
    index = pc.list_parent_indices(values)
    inner = pc.list_flatten(values)
    lengths = pc.fill_null(pc.list_value_length(values), 0)
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    position = pc.subtract(pa.array(range(len(inner)), pa.int64()), starts.take(index).cast(pa.int64()))
    bracket = _join(path.take(index), "[", _text(position), "]")
    up, rec = parent.take(index), record.take(index)
    names = {inner.type.field(i).name for i in range(inner.type.num_fields)} if pa.types.is_struct(inner.type) else set()
    if "o" in names:
        child = pc.struct_field(inner, "o")
        keep = pc.indices_nonzero(pc.is_valid(child))
        if len(keep):
            child, here, rows = child.take(keep), bracket.take(keep), rec.take(keep)
            attrs = pc.struct_field(child, ATTRS)
            out.append((rows, here, up.take(keep), pa.array([name] * len(keep)), position.take(keep).cast(pa.int32()), pa.array([depth] * len(keep), pa.int32()), attrs))
            _flatten(child, rows, here, here, name, depth + 1, out)
    if "a" in names:
        child = pc.struct_field(inner, "a")
        keep = pc.indices_nonzero(pc.is_valid(child))
        if len(keep):
            _flatten(child.take(keep), rec.take(keep), bracket.take(keep), up.take(keep), name, depth, out)


def flatten_batch(keys: pa.Array, texts: list[str | None], column: str, kinds: dict[str, int]) -> list[tuple]:
    """The nodes of one column of one batch, as tuples of Arrow arrays."""
    roots, rows = [], []
    for i, text in enumerate(texts):
        value = decode(text)
        try:
            if isinstance(value, list):
                items = _elements(value, None, kinds)
                value = None if items is None else {"": items}
            elif isinstance(value, dict):
                value = _skeleton(value, kinds, "", {})
            else:
                value = None
        except RecursionError:
            value = None
        if value:
            roots.append(value)
            rows.append(i)
    if not roots:
        return []
    out: list[tuple] = []
    record = pa.array(rows, pa.int64())
    blank = pa.array([""] * len(rows))
    _flatten(pa.array(roots), record, blank, pa.nulls(len(rows), pa.string()), column, 0, out)
    return [(keys.take(r), pa.array([column] * len(r)), *rest) for r, *rest in out]


def nested_nodes(df: DataFrame, columns: list[str], key: str = "record_id") -> DataFrame:
    """One row per record and object that is an element of an array, at any depth.

    Columns: the key, ``column_name``, ``node_path`` (keys joined by ``.``, the
    zero-based position in brackets), ``parent_path`` (null under the record
    itself), ``table_name`` (the array's key), ``position``, ``depth`` and
    ``attrs`` (JSON of the object's own scalars, inner objects dotted).

    Repeated rows count once. Null and unreadable values (also those nested beyond
    Python's recursion limit) have no nodes, null elements count for positions only, an empty table gives an empty result,
    and other columns of ``df`` are ignored. Rows with the same key but other
    content are kept apart only by their paths, each of which comes once.
    """
    rows = spread(df.select(key, *columns), key)
    kinds = irregular_keys(rows, columns)
    field = next(f for f in df.schema.fields if f.name == key)
    names = [key, "column_name", "node_path", "parent_path", "table_name", "position", "depth", "attrs"]
    schema = f"{key} {field.dataType.simpleString()}, column_name string, node_path string, parent_path string, table_name string, position int, depth int, attrs string"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, column in enumerate(columns):
                for arrays in flatten_batch(keys, batch.column(i + 1).to_pylist(), column, kinds):
                    yield pa.record_batch(list(arrays), names)

    # a repeated row gives the same nodes again; only nodes are shuffled, never the JSON
    return rows.mapInArrow(expand, schema).dropDuplicates([key, "column_name", "node_path"])


def node_table(nodes: DataFrame, table_name: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one array: ``fields`` maps a column to a dotted name in ``attrs``."""
    got = nodes.where(F.col("table_name") == table_name)
    key = nodes.columns[0]
    picked = [F.get_json_object("attrs", f"$['{path}']").alias(name) for name, path in fields.items()]
    return got.select(key, "column_name", "node_path", "parent_path", "position", *picked)
