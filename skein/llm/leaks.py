"""Evaluation passages that stand in training text, by suffix arrays.

The training texts of a shard, as word numbers, get a suffix array (sorted by
their first SEED words, which is as deep as the search has to go before it
extends). Every suffix of every evaluation text is looked up in it by binary
search; each hit is extended to the longest verbatim match. A match that is long enough is a leak;
a shorter one is an anchor, from which the alignment is carried on to both sides
with the few changed, added or dropped words that the definition allows.

Why anchors of SEED = 7 words lose nothing: a passage of 30 words with at most
3 changed has 27 others in at most 4 runs, so one run of 7 or more, and longer
passages hold such a stretch of 30.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut, spread

SEED, PASSAGE, EDITS, SHARD_WORDS, BLOCK_CHARS = 7, 30, 3, 1_500_000, 20_000_000
#: Hits extended at once; a seed that everything shares is worked off in slices of so many.
SLICE = 1_000_000

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf])|(.))")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<br\s*/?>")
_NUMBERING = re.compile(r"^[ \t>*+\-]*\d+[.)][ \t]+", re.M)
_OTHER = re.compile(r"[^\w\s]|_")
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACES = bytes.maketrans(bytes(range(32)), b" " * 32)


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    return " " if m[2] else m[3]


def words(text: str) -> list[bytes]:
    """The text's words without case, punctuation, markup, escapes and spacing."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _NUMBERING.sub("", text).lower()
    if text.isascii():
        return text.encode().translate(_SPACES, _PUNCTUATION).split()
    return " ".join(_OTHER.sub("", text).split()).encode("utf-8", "ignore").split()


class Items:
    """The evaluation texts as one row of word numbers, with the sorted look-up of their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[bytes, int] = {}
        row, owner = [], []
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 2) for w in words(text)]
            row += [0] * 8 + own
            owner += [-1] * 8 + [item] * len(own)
        self.row, self.owner = np.array(row + [0] * 8, np.int64), np.array(owner + [-1] * 8, np.int64)
        self.bits = max(2, (len(self.number) + 2).bit_length())
        self.at = np.flatnonzero(_whole(self.row > 0))
        self.keys = self.pack(self.row, self.at)

    def pack(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sortable keys of the SEED words from each position on."""
        per = 63 // self.bits
        columns = [sum(row[at + j] << (self.bits * (min(per, SEED - i) - 1 - (j - i))) for j in range(i, min(i + per, SEED))) for i in range(0, SEED, per)]
        if len(columns) == 1:
            return columns[0]
        return np.rec.fromarrays(columns)


def _whole(good: np.ndarray) -> np.ndarray:
    """Where SEED consecutive positions are good."""
    run = np.cumsum(np.concatenate([[0], good]))
    out = np.zeros(len(good), bool)
    out[: len(good) - SEED + 1] = run[SEED:] - run[:-SEED] == SEED
    return out


def _slide(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How far a from i and b from j agree in the direction of step."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = i[live] + step * n[live], j[live] + step * n[live]
        same = (a[x] == b[y]) & (a[x] > 1)
        live = live[same]
        n[live] += 1
    return n


def _reach(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Words of ``a`` reached from i on with 0..EDITS edits, ending in a match; shape (EDITS + 1, n).

    Furthest-reaching points by diagonal (b's offset minus a's). Neither side
    steps over the zeros that separate texts.
    """
    n, width = len(i), 2 * EDITS + 1
    far = np.full((width, n), -1, np.int64)
    far[EDITS] = _slide(a, i, b, j, step)
    best = [far[EDITS].copy()]

    def free(offset: np.ndarray, diagonal: int, side: str) -> np.ndarray:
        x = i + step * offset if side == "a" else j + step * (offset + diagonal)
        row = a if side == "a" else b
        return (offset >= 0) & (row[np.clip(x, 0, len(row) - 1)] > 0)

    for _ in range(EDITS):
        new = np.full((width, n), -1, np.int64)
        matched = best[-1].copy()
        for d in range(-EDITS, EDITS + 1):
            k = d + EDITS
            tries = [np.where(free(far[k], d, "a") & free(far[k], d, "b"), far[k] + 1, -1)]
            if k > 0:
                tries.append(np.where(free(far[k - 1], d - 1, "b"), far[k - 1], -1))
            if k + 1 < width:
                tries.append(np.where(free(far[k + 1], d + 1, "a"), far[k + 1] + 1, -1))
            at = np.maximum.reduce(tries)
            ok = np.flatnonzero(at >= 0)
            if len(ok):
                slid = _slide(a, i[ok] + step * at[ok], b, j[ok] + step * (at[ok] + d), step)
                new[k, ok] = at[ok] + slid
                matched[ok] = np.maximum(matched[ok], np.where(slid > 0, at[ok] + slid, 0))
        far = np.maximum(far, new)
        best.append(matched)
    return np.stack(best)


def search(items: Items, doc_ids: np.ndarray, rows: list[list[int]]) -> pd.DataFrame:
    """Leaks of one shard: doc_id, item_id, words (longest verbatim run), item_word and doc_word (where it begins in both)."""
    gap = [0] * 8
    flat: list[int] = list(gap)
    begins = []
    for row in rows:
        begins.append(len(flat))
        flat += row
        flat += gap
    corpus = np.array(flat, np.int64)
    at = np.flatnonzero(_whole(corpus > 1))
    empty = pd.DataFrame({"doc_id": [], "item_id": [], "words": [], "item_word": [], "doc_word": []}, dtype="int64")
    if not len(at) or not len(items.at):
        return empty
    keys = items.pack(corpus, at)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = at[order], keys[order]
    low, high = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.keys, "right")
    upto = np.cumsum(high - low)
    found = []
    for begin in range(0, int(upto[-1]), SLICE):
        hit = np.arange(begin, min(begin + SLICE, int(upto[-1])))
        own = np.searchsorted(upto, hit, "right")
        found.append(_extend(items, corpus, items.at[own], suffixes[high[own] - (upto[own] - hit)]))
    if not found:
        return empty
    i, j, length = (np.concatenate(x) for x in zip(*found))
    at_doc = np.searchsorted(np.array(begins), j, "right") - 1
    starts = np.flatnonzero((items.row[:-1] == 0) & (items.row[1:] > 0)) + 1
    item_word = i - starts[np.searchsorted(starts, i, "right") - 1]
    out = pd.DataFrame({"doc_id": doc_ids[at_doc], "item_id": items.owner[i], "words": length, "item_word": item_word, "doc_word": j - np.array(begins)[at_doc]})
    return out.sort_values(["doc_id", "item_id", "words", "item_word", "doc_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc_id", "item_id"])


def _extend(items: Items, corpus: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those hits of item positions ``i`` at corpus positions ``j`` that are leaks, with the length of their verbatim runs."""
    first = (items.row[i - 1] != corpus[j - 1]) | (items.row[i - 1] == 0)  # else the hit one word earlier holds this one
    i, j = i[first], j[first]
    if not len(i):
        return i, j, i
    length = SEED + _slide(items.row, i + SEED, corpus, j + SEED, 1)
    right = _reach(items.row, i + length, corpus, j + length, 1)
    left = _reach(items.row, i - 1, corpus, j - 1, -1)
    leak = length >= PASSAGE
    for e1 in range(EDITS + 1):
        for e2 in range(EDITS + 1 - e1):
            leak |= length + right[e1] + left[e2] >= max(PASSAGE, 10 * (e1 + e2))
    return i[leak], j[leak], length[leak]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, words, item_word, doc_word.

    ``words`` is the longest verbatim run, ``item_word`` and ``doc_word`` its
    places in the item and in the document, in words. Null and empty texts leak
    nothing, copies count each, repeated items of one id are one item per text,
    extra columns are ignored. The evaluation texts go to the executors in
    blocks of at most BLOCK_CHARS characters (one text may exceed that by
    itself), each block searched over all documents; where there are several,
    a block's leaks are written before the next one is fetched, so the driver
    holds one block at a time.
    """
    items = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    docs = spread(docs.where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        part = docs.mapInPandas(_searcher([(r.item_id, r.text) for r in own]), "doc_id long, item_id long, words long, item_word long, doc_word long")
        part = cut(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("words", "item_word", "doc_word"), F.struct("words", -F.col("item_word"), -F.col("doc_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def _searcher(texts: list[tuple[int, str]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(texts)
        number = items.number.get
        ids: list[int] = []
        rows: list[list[int]] = []
        held = 0
        for frame in frames:
            for doc, text in zip(frame.doc_id, frame.text):
                row = [number(w, 1) for w in words(text)]
                ids.append(doc)
                rows.append(row)
                held += len(row)
                if held > SHARD_WORDS:
                    yield search(items, np.array(ids, np.int64), rows)
                    ids, rows, held = [], [], 0
        if rows:
            yield search(items, np.array(ids, np.int64), rows)

    return run


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents into which no item leaked."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
