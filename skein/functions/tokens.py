"""Tokens with labels: spans of thoughts and tool calls in a text, and a tokenizer's offsets laid over them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = re.compile(r"<think>.*?</think>|<tool_call>.*?</tool_call>", re.S)
RECORD = "input_ids array<int>, loss_mask array<int>, labels array<string>, n_tokens int, n_loss int"


def tokenizer(path: str):
    """The tokenizer of the JSON file at ``path``, once per process; special tokens in a text are ordinary text."""
    import tokenizers

    held = vars(tokenizers).setdefault("_skein_tokenizers", {})  # outlives this task's copy of the code
    if path not in held:
        held[path] = tokenizers.Tokenizer.from_file(path)
        held[path].encode_special_tokens = True
    return held[path]


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, label) of the blocks in a text."""
    return [(m.start(), m.end(), "think" if m[0].startswith("<think>") else "tool_call") for m in _BLOCK.finditer(text)]


def label(start: int, stop: int, blocks: list[tuple[int, int, str]]) -> str:
    """tool_call if the token overlaps one, else think, else other; an empty token is other."""
    if start >= stop:
        return "other"
    over = {kind for a, b, kind in blocks if a < stop and start < b}
    return "tool_call" if "tool_call" in over else "think" if over else "other"


def token_records(text: Column, path: str, most: int | None = None) -> Column:
    """struct of token ids, loss mask, labels and lengths; at most ``most`` tokens, the last of them without loss if it was cut there."""

    @F.pandas_udf(RECORD)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = tokenizer(path)
        for texts in batches:
            whole = [t if isinstance(t, str) else "" for t in texts]
            rows = []
            for t, e in zip(whole, model.encode_batch(whole, add_special_tokens=False)):
                blocks = spans(t)
                labels = [label(a, b, blocks) for a, b in e.offsets][:most]
                mask = [int(x != "other") for x in labels]
                if most is not None and len(e.ids) > most and mask:
                    mask[-1] = 0
                rows.append((e.ids[:most], mask, labels, len(labels), sum(mask)))
            yield pd.DataFrame(rows, columns=["input_ids", "loss_mask", "labels", "n_tokens", "n_loss"])

    return encode(text)


def fingerprint(settings: dict, files: dict[str, bytes] | None = None) -> str:
    """A digest of settings and of the files a cache depends on: equal inputs, equal digests."""
    body = {"settings": settings, "files": {n: hashlib.sha256(b).hexdigest() for n, b in sorted((files or {}).items())}}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
