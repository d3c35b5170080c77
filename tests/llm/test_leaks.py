"""Leaks against dynamic programming over every window of 30 words."""

import random

import numpy as np
import pytest

from skein.llm import leaks as L


def by_definition(item: list, doc: list) -> bool:
    """Some n >= 30 consecutive item words, the first and the last unchanged, stand in the document with at most n / 10 edits."""
    for s, head in enumerate(item):
        for j0, d in enumerate(doc):
            if d != head:
                continue
            rest = doc[j0 + 1 : j0 + 46]
            row = list(range(len(rest) + 1))  # row[j]: edits between the words after the head so far and rest[:j]
            for n, w in enumerate(item[s + 1 : s + 40], 2):
                last, row[0] = row[0], n - 1
                closed = 99
                for j, x in enumerate(rest, 1):
                    if x == w:
                        closed = min(closed, last)
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != x))
                if n >= 30 and closed <= n // 10:
                    return True
    return False


def noisy(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(1, len(out) - 1)
        what = rng.choice("sid")
        if what == "s":
            out[k] = "other"
        elif what == "i":
            out.insert(k, "extra")
        else:
            del out[k]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_matches_the_definition(seed):
    rng = random.Random(seed)
    items = [(i, [f"w{rng.randrange(400)}" for _ in range(rng.choice([29, 30, 45, 80]))]) for i in range(6)]
    docs = []
    for d in range(120):
        item = rng.choice(items)[1]
        n = rng.choice([20, 27, 30, 31, 40, len(item)])
        s = rng.randrange(max(1, len(item) - n))
        passage = noisy(item[s : s + n], rng.choice([0, 1, 2, 3, 4, 6]), rng)
        docs.append((d, [f"x{rng.randrange(50)}" for _ in range(rng.randrange(15))] + passage + [f"x{rng.randrange(50)}" for _ in range(rng.randrange(15))]))
    index = L.Items([(i, " ".join(w)) for i, w in items])
    got = L.search(index, np.array([d for d, _ in docs]), [[index.number.get(w.encode(), 1) for w in ws] for _, ws in docs])
    got = set(zip(got.doc_id, got.item_id))
    want = {(d, i) for d, ws in docs for i, item in items if by_definition(item, ws)}
    assert got == want


def test_words_ignore_layout():
    assert L.words("**Don’t** `retry_trie`,\\n<b>now</b> &amp;  1. “so”​") == [b"dont", b"retrytrie", b"now", b"1", b"so"]
    assert L.words("1. one\n- two\n> 2) three") == [b"one", b"two", b"three"]
    assert L.words("") == [] and L.words("…") == []


def test_documents_with_copies_nulls_and_long_texts(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    long = "filler " * 200_000 + passage.upper()
    docs = spark.createDataFrame([(1, passage, "z"), (2, passage, "z"), (3, None, "z"), (4, "", "z"), (5, long, "z"), (6, " ".join(passage.split()[:25]), "z")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "too short")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.words) for r in L.leaks(docs, items).collect()) == [(1, 7, 60), (2, 7, 60), (5, 7, 60)]
    assert L.leaks(docs, items.limit(0)).count() == 0 and L.leaks(docs.limit(0), items).count() == 0
    assert {r.doc_id for r in L.without_leaks(docs, L.leaks(docs, items)).collect()} == {3, 4, 6}


def test_long_tags_places_blocks_and_slices(spark, monkeypatch):
    """A tag of any length breaks no passage; places are those of the longest run; slices and blocks change nothing."""
    words = [f"word{i}" for i in range(60)]
    tag = '<span title="' + "y" * 5_000 + '">'
    docs = [(d, "pre fix " + " ".join(words[:20]) + f" {tag} " + " ".join(words[20:40]) + " post", "x") for d in range(20)] + [(90, " ".join(words[10:55]), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, other string").repartition(3)
    items = spark.createDataFrame([(1, " ".join(words)), (2, "other " + " ".join(words[5:]))], "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in L.leaks(df, items).select("doc_id", "item_id", "words", "item_word", "doc_word").collect())
    whole = found()
    assert [r for r in whole if r[0] == 0] == [(0, 1, 40, 0, 2), (0, 2, 35, 1, 7)] and (90, 1, 45, 10, 0) in whole and len(whole) == 42
    monkeypatch.setattr(L, "SLICE", 7)
    assert found() == whole
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    assert found() == whole
