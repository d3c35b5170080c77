"""The nested operator against a plain recursive walk."""

import json

import pytest

from skein.operators.nested import FREE_TEXT, nested_nodes

ARRAYS = {"calls", "edits", "subs"}
OBJECTS = {"args"}


def walk(x, path, out):
    """Paths of objects in arrays, row by row."""
    if isinstance(x, dict):
        for key, v in x.items():
            if key in FREE_TEXT and isinstance(v, str):
                continue
            if isinstance(v, str) and key in ARRAYS | OBJECTS:
                try:
                    inner = json.loads(v)
                except ValueError:
                    continue
                v = inner if isinstance(inner, (dict, list)) else None
            if isinstance(v, dict) and key in ARRAYS:
                v = [v]
            walk(v, f"{path}.{key}" if path else key, out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            if isinstance(v, dict):
                out.add(f"{path}[{i}]")
            walk(v, f"{path}[{i}]", out)


CASES = [
    '{"calls": [{"args": {"edits": [{"p": 1}, null, {"p": 2}]}, "subs": [{"args": {}}]}], "text": "[{\\"a\\": 1}]"}',
    '{"calls": {"args": "{\\"edits\\": {\\"p\\": \\"ü\\"}}"}}',
    '{"calls": "[{\\"args\\": {}}, null]", "args": {"x": 1}}',
    '{"calls": "[]"}',
    '{"calls": [[{"edits": []}], [null, {"edits": [{}]}]]}',
    '[{"edits": [{"p": []}]}, 3]',
    '{"calls": [{"args"',
    "null",
    "",
    None,
    '{"stdout": [{"a": 1}], "\\ud800": [{"a": "\\ud800"}]}',
]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, c, "clash") for i, c in enumerate(CASES)] + [(0, CASES[0], "clash")]
    df = spark.createDataFrame(rows, "record_id long, doc string, node_path string")
    return nested_nodes(df, ["doc"]).collect()


def test_paths_match_a_row_walk(nodes):
    for i, text in enumerate(CASES[:-1]):
        want: set = set()
        try:
            walk(json.loads(text) if text else None, "", want)
        except ValueError:
            pass
        assert {r.node_path for r in nodes if r.record_id == i} == want, text


def test_each_node_once_with_its_parent(nodes):
    keys = [(r.record_id, r.node_path) for r in nodes]
    assert len(keys) == len(set(keys))
    by = {(r.record_id, r.node_path): r for r in nodes}
    child = by[(0, "calls[0].args.edits[2]")]
    assert child.parent_path == "calls[0]" and child.position == 2 and json.loads(child.attrs) == {"p": 2}
    assert by[(0, "calls[0]")].parent_path is None


def test_lone_surrogates_do_not_crash(nodes):
    assert {r.node_path for r in nodes if r.record_id == len(CASES) - 1} == {"?[0]", "stdout[0]"}


def test_empty_table(spark):
    assert nested_nodes(spark.createDataFrame([], "record_id long, doc string"), ["doc"]).count() == 0


def test_arrays_under_free_text_keys_are_structure(spark):
    """A string under such a key never is, whatever it holds."""
    rows = [(1, '{"content": [{"a": 1}, null, {"b": [{"c": 2}]}], "message": {"parts": [{"x": 1}]}, "text": "[{\\"no\\": 1}]"}'), (2, '{"content": "[{\\"no\\": 1}]", "text": {"items": [{}]}}')]
    df = spark.createDataFrame(rows, "record_id long, j string")
    got = {(r.record_id, r.node_path) for r in nested_nodes(df, ["j"]).collect()}
    assert got == {(1, "content[0]"), (1, "content[2]"), (1, "content[2].b[0]"), (1, "message.parts[0]"), (2, "text.items[0]")}
