"""Texts that break off, found by prefix self-joins of texts and of sentence shapes.

A text that stands as a strict prefix of a longer one elsewhere breaks off: that
join runs over whole texts, by hashes of a fixed-length prefix and then in
sorted order. Few documents have a longer copy, but their last sentence or line
does: once names, numbers and all but common words are masked, what a text ends
with is either something that other texts end with as well, or a strict prefix
of what they carry on with. Every sentence and line of the corpus therefore
gives the hashes of all its token prefixes, with how often the corpus goes on
after each and how often it stops there; the tail of each document is joined to
them by hash. A tail without siblings is judged by its last word and by its last
three, two or one tokens: whether texts ever stop after them.

A batch is read at once: one pass of the token pattern over all its texts, then
numbers in arrays. Prefix hashes are running sums of numbers times powers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut, cut_counted, spread

#: A tail is whole if at least this share of the corpus' copies stop there too.
STOPS = 0.1
#: A tail that only ever ends documents is whole if they are at least this share of what goes on from one token before.
RARE = 0.05
#: A last part of an identifier is cut if at most this share of the longer parts' copies is whole.
WHOLE = 0.02
#: So many copies have to go on for a deviation in the last tokens to count.
SUPPORT = 3
#: A tail without siblings goes on if others do after its last tokens, at most so many of them.
CONTEXT = 3
#: A text of at least so many characters that another one carries on within the line breaks off.
PREFIX = 40
#: Characters read at once, and entries a task holds before it passes them on; neither changes a count.
CHUNK, HELD = 1_000_000, 1_000_000
#: Shared beginnings (8 bytes each) that are broadcast; of more, the join shuffles. Neither changes a result.
LEADS = 1_000_000
#: Words beyond this rank of the vocabulary are masked, as names are.
COMMON = 4_000

_TOKEN = re.compile(r"[^\W_一-鿿]+(?:[_./\\@:-]+[^\W_一-鿿]+)*|\S")
#: Private characters that separate the texts, lines and sentences of a batch.
DOC, LINE, SENTENCE = "\ue000", "\ue001", "\ue002"
_PRIVATE = re.compile(f"[{DOC}{LINE}{SENTENCE}]")
_SENTENCE = re.compile(r"([.!?])\s+")
_HAN_SENTENCE = re.compile(r"([。！？])\s*")
_CLOSERS = "\"'”’)*`"
#: What may stand in place of the rest; an ellipsis is also written on purpose.
_DEBRIS = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|(?<!\\)\\|&(?:#\w{0,5}|[a-zA-Z]{1,6}))$")
_NOTICE = re.compile(r"\s*[\[(<{]+\s*(?:\.\.\.|…)?\s*(?:output |text |content |message |log )?(?:truncated|cut(?: off)?|clipped|snipped|snip|omitted|\+?\d+ (?:more )?(?:chars?|characters|bytes|words|tokens|lines)\b[^\])>}]*)[^\])>}\n]{0,40}[\])>}]+$", re.I)
_JOINT = re.compile(r"[_./\\@:-]+")
_UNJOINED = str.maketrans("", "", "_./\\@:-")
_PART = re.compile(r"[A-Z]?[a-z]+")
_EXTENSION = re.compile(r"\.([a-z]{1,4})$")
_MASK = (1 << 63) - 1
#: Makes blanks and line breaks sort behind all that may follow within a word.
_LAST = {ord(" "): "\U0010fffc", ord("\n"): "\U0010fffd"}


def known_words(path: str) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """Words that are one token of the vocabulary at ``path``, each with its leading blank: the COMMON first ones, and all."""
    import base64

    with open(path, "rb") as lines:
        ranked = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
    words = [(t[1:].lower(), rank) for t, rank in ranked if t[:1] == b" " and t[1:].isalpha()]
    return frozenset(w for w, rank in words if rank < COMMON), frozenset(w for w, _ in words)


class Shapes:
    """Token classes with their numbers, remembered while they are few."""

    def __init__(self, vocabulary: str):
        import xxhash

        # as the engine's xxhash64, without the sign
        self.digest = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "ignore"), 42) & _MASK
        self.common, self.known = known_words(vocabulary)
        #: Numbers below 3 separate.
        self.marks = {DOC: 0, LINE: 1, SENTENCE: 2}
        self.seen: dict[str, int] = dict(self.marks)
        #: Words and identifiers since the last drain; a task may give one again, so they are made distinct over all tasks.
        self.names: set[str] = set()
        self.named: set[str] = set()

    def numbers(self, tokens: list[str], fragments: list[int]) -> np.ndarray:
        """The numbers of ``tokens``; those at ``fragments`` end texts, so they may be cut and are no evidence of a word."""
        if len(self.seen) > HELD:
            self.seen, self.named = dict(self.marks), set()
        held = [tokens[i] for i in fragments]
        for i in fragments:
            tokens[i] = DOC
        whole = set(tokens)
        for i, t in zip(fragments, held):
            tokens[i] = t
        fresh = whole - self.named - self.marks.keys()
        self.named |= fresh
        self.names.update(t.lower() if t.isalpha() else t for t in fresh if t.isalpha() or _PART.search(t))
        for t in whole.union(held).difference(self.seen):
            self.seen[t] = max(3, self.digest(self.shape(t)))
        return np.fromiter(map(self.seen.__getitem__, tokens), np.uint64, len(tokens))

    def shape(self, token: str) -> str:
        if len(token) == 1 and not token.isalnum():
            return token
        if token.isalpha():
            if token != token.lower() and token[1:] != token[1:].lower() and not token.isupper():
                return "C" if len(token) > 3 else "c"
            low = token.lower()
            return low if low.encode("utf-8", "ignore") in self.common or "一" <= token <= "鿿" else "W"
        bare = token.translate(_UNJOINED)
        if bare.isdigit():
            return "9" * min(len([p for p in _JOINT.split(token) if p]), 4)
        kind = "".join([c for c in "/\\@:-." if c in token])
        if kind == "-" and bare.isalpha() and "_" not in token:
            return "-".join([self.shape(p) for p in token.split("-") if p])
        last = token.rsplit("::", 1)[-1].rsplit("/", 1)[-1]
        stem, dot, extension = last.rpartition(".")
        if dot and len(extension) <= 4 and extension.isascii() and extension.isalpha() and extension.islower():
            extension = dot + extension
        else:
            stem, extension = last, ""
        end = stem[max(map(stem.rfind, "_.:-")) + 1 :]
        short = len(end) < 4 and not end.isdigit() and end.lower().encode("utf-8", "ignore") not in self.known
        return f"I{kind}{'_' if '_' in stem else ''}{extension}{'s' if short else ''}"


def strip_marks(text: str) -> tuple[str, bool, bool]:
    """The text without what stands for a lost rest; whether an ellipsis and whether surer debris stood there."""
    dots = debris = False
    while True:
        text = text.rstrip()
        if text[-1:] in ("]", ")", ">", "}"):
            inner = text.rstrip("])>}")
            if m := _NOTICE.search(text, max(inner.rfind(c) for c in "])>}") + 1):
                text, debris = text[: m.start()], True
                continue
        elif m := _DEBRIS.search(text, max(0, len(text) - 10)):  # no debris is longer
            text, debris = text[: m.start()], True
            continue
        if text.endswith("…"):
            text, dots = text.rstrip("…"), True
        elif text.endswith("..."):
            text, dots = text.rstrip("."), True
        else:
            return text, dots, debris


#: Odd numbers; sums and products wrap around on purpose.
_K, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C
    return (h ^ (h >> np.uint64(29))) & np.uint64(_MASK)


def _times(k: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(k) * n & (1 << 64) - 1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _K
    return np.cumprod(out)


#: The hash of the empty prefix, with which every sentence begins.
EMPTY = np.uint64(1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each stands."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Counts:
    """Hashes with how often texts go on after them and how often they stop, summed."""

    def __init__(self):
        self.held = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
        self.added: tuple[list, list] = ([], [])

    def add(self, keys: np.ndarray, stops: bool) -> None:
        self.added[stops].append(keys)

    def settle(self) -> None:
        (on, n_on), (stop, n_stop) = (_runs(np.concatenate(a)) if a else (np.empty(0, np.uint64), np.empty(0, np.int64)) for a in self.added)
        self.added = ([], [])
        keys = np.union1d(self.held[0], np.union1d(on, stop))
        out = [keys, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
        for column, own, n in ((1, self.held[0], self.held[1]), (2, self.held[0], self.held[2]), (1, on, n_on), (2, stop, n_stop)):
            out[column][np.searchsorted(keys, own)] += n
        self.held = out


class Scan:
    """Prefix counts of a task's texts, and the tail of each text."""

    def __init__(self, vocabulary: str):
        self.shapes, self.counts = Shapes(vocabulary), Counts()
        self.caret = np.uint64(self.shapes.digest("^"))

    def read(self, texts: list[str]) -> dict[str, pa.Array]:
        """Count the texts' segments; give per text the prefix hashes of its tail (longest first), what is plain to see (sound end, debris, open block), and the hashes of the identifier part, the word and the last one to CONTEXT tokens it ends with."""
        marks = [strip_marks(t) for t in texts]
        bodies = [b for b, _, _ in marks]
        joined = DOC.join(bodies)
        if joined.count(DOC) >= len(bodies) or LINE in joined or SENTENCE in joined:
            joined = DOC.join(_PRIVATE.sub("", b) for b in bodies)
        joined = _SENTENCE.sub("\\1" + SENTENCE, joined.replace("\n", LINE))
        if not joined.isascii():
            joined = _HAN_SENTENCE.sub("\\1" + SENTENCE, joined)
        tokens = _TOKEN.findall(joined)
        tokens.append(DOC)
        bounds = np.array([i for i, t in enumerate(tokens) if t in self.shapes.marks], np.int64)
        kind = np.array([self.shapes.marks[tokens[i]] for i in bounds])
        start, end = np.concatenate([[0], bounds[:-1] + 1]), bounds
        doc = np.concatenate([[0], np.cumsum(kind == 0)[:-1]])
        line = np.concatenate([[0], np.cumsum(kind < 2)[:-1]])
        keep = end > start
        start, end, doc, line = start[keep], end[keep], doc[keep], line[keep]
        n = len(start)
        follows = doc[1:] == doc[:-1]
        last = np.concatenate([~follows, [True]])[:n] if n else np.zeros(0, bool)
        first = np.concatenate([[True], line[1:] != line[:-1]])[:n]
        a = self.shapes.numbers(tokens, [int(i) for i in end[last] - 1]) + np.uint64(1)
        a[bounds] = 0
        prefix, runs = self._hash(a, start, end)
        line_start = self._line_starts(a, start, end, np.concatenate([[False], follows])[:n])
        self._count(prefix, runs, line_start, start, end, first, last)
        return self._ends(texts, marks, tokens, prefix, runs, line_start, start, end, doc, first, last)

    def _hash(self, a: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """At each token the hash of its segment's prefix up to it, and those of the last 1 to CONTEXT tokens."""
        length = end - start
        owner = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        where = start[owner] + at
        terms = np.zeros(len(a), np.uint64)
        terms[where] = a[where] * _powers(int(length.max(initial=0)) + 1)[at]
        sums = np.cumsum(terms)
        prefix = np.zeros(len(a), np.uint64)
        before = np.where(start > 0, sums[start - 1], np.uint64(0)) if len(start) else sums[:0]
        prefix[where] = _mix(sums[where] - before[owner] + (at.astype(np.uint64) + np.uint64(1)) * _C)
        runs, run = [], np.zeros(len(a), np.uint64)
        for k in range(CONTEXT):
            run = run * _K
            run[k:] += a[: len(a) - k] if k else a
            runs.append(_mix(run + _times(_K, k + 1)))
        return prefix, runs

    def _line_starts(self, a: np.ndarray, start: np.ndarray, end: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Per segment the hashes of what ended the segment before with its first 0 to 3 tokens; shape (4, n)."""
        before = np.where(follows, a[np.concatenate([[0], end[:-1] - 1])[: len(start)]] if len(start) else a[:0], self.caret)
        h, out = (before ^ np.uint64(1)) * _K + _C, []
        for j in range(4):
            out.append(_mix(h + _times(_C, j)))
            h = h * _K + a[np.minimum(start + j, len(a) - 1)]
        return np.stack(out) if len(start) else np.zeros((4, 0), np.uint64)

    def _count(self, prefix, runs, line_start, start, end, first, last) -> None:
        """Every segment that others follow goes on after each of its prefixes and stops after all of it."""
        add = self.counts.add
        s, e = start[~last], end[~last]
        within = np.zeros(len(prefix) + 1, np.int64)
        np.add.at(within, s, 1)
        np.add.at(within, e - 1, -1)
        inside = np.flatnonzero(np.cumsum(within)[:-1] > 0)
        add(np.full(len(s), EMPTY), False)
        add(prefix[inside], False)
        add(prefix[e - 1], True)
        place = inside - s[np.searchsorted(s, inside, "right") - 1] if len(inside) else inside
        for k, run in enumerate(runs):
            add(run[inside[place >= k]], False)
            add(run[e[e - s > k] - 1], True)
        opening = first & ~last
        taken = np.minimum(end - start, 3)
        for j in range(4):
            add(line_start[j][opening & (taken > j)], False)
            add(line_start[j][opening & (taken == j)], True)
        if sum(map(len, self.counts.added[0])) > HELD:
            self.counts.settle()

    def _ends(self, texts, marks, tokens, prefix, runs, line_start, start, end, doc, first, last) -> dict[str, pa.Array]:
        n = len(texts)
        none = [None] * n
        out = {c: list(none) for c in ("tail", "part", "word", *(f"run{k + 1}" for k in range(CONTEXT)))}
        sound, opened, final = [False] * n, [False] * n, [""] * n
        for k in np.flatnonzero(last):
            d, s, e = int(doc[k]), int(start[k]), int(end[k])
            if e - s <= 2 and first[k]:
                hashes = [int(line_start[j][k]) for j in range(e - s, -1, -1)]
            else:
                hashes = [int(h) for h in prefix[max(s, e - 4) : e][::-1]]
                if e - s < 4:
                    hashes.append(int(EMPTY))
            out["tail"][d] = hashes
            for r in range(CONTEXT):
                if e - s > r:
                    out[f"run{r + 1}"][d] = int(runs[r][e - 1])
            token, before = tokens[e - 1], tokens[e - 2] if e - s > 1 else ""
            out["part"][d], out["word"][d] = self._last_part(token), self._last_word(token)
            # a full stop after a path may be the one before its extension
            final[d] = before if token == "." and "/" in before and not _EXTENSION.search(before) else ""
        for d, (body, dots, _) in enumerate(marks):
            sound[d] = body.rstrip(_CLOSERS)[-1:] in set(".!?。！？") and bool(body) and not dots and not final[d]
            opened[d] = ("```" in body and body.count("```") % 2 == 1) or body.rfind("<tool_call>") > body.rfind("</tool_call>")
        arrays = {c: pa.array(v, pa.list_(pa.int64()) if c == "tail" else pa.int64()) for c, v in out.items()}
        return arrays | {"sound": pa.array(sound), "debris": pa.array([m[2] for m in marks], pa.bool_()), "open": pa.array(opened)}

    def _last_part(self, token: str) -> int | None:
        if token.isalpha() or not token[-1].isalpha() or not (parts := _PART.findall(token)):
            return None
        return self.shapes.digest("part:" + parts[-1])

    def _last_word(self, word: str) -> int | None:
        # capitalised, it may be a name that happens to begin a longer one
        whole = len(word) < 3 or not word.isalpha() or not word.islower() or word.encode("utf-8", "ignore") in self.shapes.known
        return None if whole else self.shapes.digest("word:" + word)

    def drain(self) -> tuple[list[np.ndarray], list[str]]:
        """The hashes so far, with on (longer copies) and stop (copies that end there), and the identifiers."""
        self.counts.settle()
        got, names = self.counts.held, list(self.shapes.names)
        self.counts, self.shapes.names = Counts(), set()
        return got, names


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("digest", pa.int64()), ("tail", pa.list_(pa.int64()))]
    + [(c, pa.bool_()) for c in ("sound", "debris", "open")]
    + [(c, pa.int64()) for c in ("part", "word", *(f"run{k + 1}" for k in range(CONTEXT)), "hash", "goes_on", "stops")]
    + [("name", pa.string())]
)
_SCHEMA = ", ".join(f"{f.name} {'array<long>' if f.name == 'tail' else {'int64': 'long', 'bool': 'boolean', 'string': 'string'}[str(f.type)]}" for f in _ARROW)
RUNS = [f"run{k + 1}" for k in range(CONTEXT)]


def _scan(df: DataFrame, vocabulary: str) -> DataFrame:
    """One pass over the texts: a row per document, and rows of pre-aggregated prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and held < CHUNK:
                    held += len(texts[stop])
                    stop += 1
                own = {c: batch.column(c).slice(at, stop - at) for c in ("doc_id", "source", "digest")}
                yield _batch(own | scan.read(texts[at:stop]), stop - at)
                at = stop
            if len(scan.counts.held[0]) > HELD or len(scan.shapes.names) > HELD:
                yield from _prefixes(scan)
        yield from _prefixes(scan)

    texts = df.where(F.length(F.trim("text")) > 0).select("doc_id", "source", "text", F.xxhash64("text").alias("digest"))
    return spread(texts, "doc_id").mapInArrow(run, _SCHEMA)


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of all columns, null where none is given."""
    return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _prefixes(scan: Scan) -> Iterator[pa.RecordBatch]:
    (keys, on, stop), names = scan.drain()
    yield _batch({"hash": pa.array(keys.astype(np.int64)), "goes_on": pa.array(on), "stops": pa.array(stop)}, len(keys))
    yield _batch({"name": pa.array(names, pa.string())}, len(names))


def _parts(names: DataFrame) -> DataFrame:
    """(hash, goes_on, stops) of the parts of distinct identifiers, and of distinct words: how many of them have a part longer than this, or just this."""
    word = F.col("name").rlike(r"^\p{L}+$")
    parts = F.when(word, F.array(F.concat(F.lit("word:"), "name"))).otherwise(F.transform(F.regexp_extract_all("name", F.lit("([A-Z]?[a-z]+)")), lambda p: F.concat(F.lit("part:"), p)))
    whole = names.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    length = F.length("part")
    counted = whole.select("n", "part", F.explode(F.sequence(F.lit(6), length)).alias("upto"), length.alias("length"))
    digest = F.xxhash64(F.substring("part", F.lit(1), F.col("upto"))).bitwiseAND(F.lit(_MASK))
    return counted.groupBy(digest.alias("hash")).agg(F.sum(F.when(F.col("upto") < F.col("length"), F.col("n")).otherwise(0)).alias("goes_on"), F.sum(F.when(F.col("upto") == F.col("length"), F.col("n")).otherwise(0)).alias("stops"))


def _bodies(df: DataFrame) -> DataFrame:
    """(digest, sound, body) of the distinct texts that begin with the same PREFIX characters as another one, without what stands for a lost rest.

    Marks are at the end, so texts of PREFIX characters keep them; one begins another only if those hash alike.
    """
    texts = df.where(F.length(F.rtrim("text")) >= PREFIX).select(F.xxhash64("text").alias("digest"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("lead"), "text")
    shared, count = cut_counted(texts.groupBy("lead").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("lead"), n=F.count(F.lit(1)))
    if count["n"] <= LEADS:  # known to be small: the texts stay where they are
        shared = F.broadcast(shared)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [strip_marks(t) for t in batch.column(1).to_pylist()]
            sound = [b.rstrip(_CLOSERS)[-1:] in set(".!?。！？") and bool(b) and not dots for b, dots, _ in read]
            yield pa.record_batch([batch.column(0), pa.array(sound, pa.bool_()), pa.array([b.translate(_LAST) for b, _, _ in read], pa.string())], ["digest", "sound", "body"])

    return texts.join(shared, "lead", "left_semi").select("digest", "text").mapInArrow(strip, "digest long, sound boolean, body string")


def _carried_on(bodies: DataFrame) -> DataFrame:
    """Digests of the texts, of (digest, sound, body), that another text carries on within the line: the prefix self-join of whole texts.

    Sorted, a text stands right before those it begins, so each is compared with the next
    distinct one only; a partition's last text is compared with the first ones of those after it.
    """

    def breaks(body: str, following: str, sound: bool) -> bool:
        if len(body) < PREFIX or not following.startswith(body):
            return False
        rest = following[len(body) :].split("\U0010fffd", 1)[0]
        if sound:  # the full stop before an extension
            return body[-1] == "." and rest[:1].isascii() and rest[:1].isalnum()
        return any(c.isalnum() for c in rest)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        first, last, held = None, None, {}
        for batch in batches:
            found = []
            for digest, sound, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if body != last:
                    found += [d for d, s in held.items() if breaks(last, body, s)]
                    first, last, held = body if first is None else first, body, {}
                held[digest] = sound
            yield pa.record_batch([pa.array(found, pa.int64()), *(pa.nulls(len(found), t) for t in (pa.int32(), pa.bool_(), pa.string(), pa.string()))], ["digest", "at", "sound", "body", "first"])
        n = len(held)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array([at] * n, pa.int32()), pa.array(held.values(), pa.bool_()), pa.array([last] * n, pa.string()), pa.array([first] * n, pa.string())], ["digest", "at", "sound", "body", "first"])

    ordered = bodies.repartitionByRange("body").sortWithinPartitions("body")
    seen = cut(ordered.mapInArrow(pairs, "digest long, at int, sound boolean, body string, first string"))
    edges = seen.where("at IS NOT NULL")
    # as many rows as partitions, and those that are copies of a partition's last text
    after = edges.groupBy("at").agg(F.first("first").alias("first")).select(F.col("at").alias("before"), F.lead("first").over(Window.orderBy("at")).alias("following"))
    met = edges.join(after, F.col("at") == F.col("before")).where("following IS NOT NULL")
    crossing = met.where(F.udf(breaks, "boolean")("body", "following", "sound"))
    return seen.where("at IS NULL").select("digest").union(crossing.select("digest")).distinct()


def tails(df: DataFrame, vocabulary: str) -> DataFrame:
    """Per document (doc_id, source) whether it is ``truncated``, and the evidence.

    ``stops`` and ``goes_on`` say how often other texts stop, or carry on, after
    exactly this tail; ``known`` how many of the last tokens have to be left off
    to find longer copies at all (null if more than three); ``cut_part`` that it
    ends in an identifier whose last part is hardly ever whole but often longer;
    ``cut_word`` that it ends in no word of the corpus but in the beginning of one;
    ``cut_context`` that others go on after its last tokens, of the longest run
    of at most CONTEXT of them that stands elsewhere; ``carried_on`` that another
    text begins with all of it.
    """
    scanned = cut(_scan(df, vocabulary))
    docs = scanned.where("doc_id IS NOT NULL").drop("hash", "goes_on", "stops", "name")
    carried = _carried_on(_bodies(df))
    ends = docs.select("digest", F.explode(F.array(F.col("tail")[0], *RUNS)).alias("hash")).where("hash IS NOT NULL").distinct().groupBy("hash").agg(F.lit(0).cast("long").alias("goes_on"), F.lit(0).cast("long").alias("stops"), F.count("*").alias("ends"))
    parts = _parts(scanned.where("name IS NOT NULL").select("name").distinct())
    own = scanned.where("hash IS NOT NULL").select("hash", "goes_on", "stops").unionByName(parts).withColumn("ends", F.lit(0).cast("long"))
    # an end carries on after its own shorter prefixes, as every sentence does
    prefixes = own.unionByName(ends).groupBy("hash").agg(F.sum("goes_on").alias("goes_on"), F.sum("stops").alias("stops"), F.sum("ends").alias("ends"))
    # offsets below 0 look up the part of an identifier, the word and the tokens that the tail ends with
    below = ["part", "word", *RUNS]
    looks = F.concat(F.transform("tail", lambda h, i: F.struct(i.alias("off"), h.alias("hash"))), F.array(*(F.struct(F.lit(-1 - k).alias("off"), F.col(c).alias("hash")) for k, c in enumerate(below))))
    wanted = docs.select("doc_id", F.explode(looks).alias("w")).select("doc_id", "w.off", "w.hash").where("hash IS NOT NULL")
    looked = wanted.join(prefixes, "hash", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    at = lambda k, c: F.max(F.when(F.col("off") == k, zero(c)))
    run = lambda k: -3 - k
    stopped = lambda k: at(k, "stops") + F.greatest(at(k, "ends") - 1, F.lit(0))
    known = F.min(F.when((F.col("off") >= 0) & (zero("goes_on") >= F.lit(SUPPORT)), F.col("off")))
    # the longest run that stands elsewhere often enough decides, shorter ones only for a tail of which nothing is known
    context = F.lit(False)
    for k in range(CONTEXT):
        met = F.coalesce(at(run(k), "goes_on") + stopped(run(k)) >= SUPPORT, F.lit(False))
        goes = (at(run(k), "goes_on") >= SUPPORT) & (stopped(run(k)) < RARE * at(run(k), "goes_on"))
        context = F.when(met, goes & (F.lit(k == CONTEXT - 1) | known.isNull())).otherwise(context)
    seen = looked.groupBy("doc_id").agg(
        at(0, "goes_on").alias("goes_on"),
        stopped(0).alias("stops"),
        ((at(0, "stops") == 0) & (at(0, "ends") - 1 < RARE * F.coalesce(at(1, "goes_on"), F.lit(0)))).alias("only_ends"),
        known.alias("known"),
        F.coalesce((at(-1, "goes_on") >= SUPPORT) & (at(-1, "stops") <= WHOLE * (at(-1, "stops") + at(-1, "goes_on"))), F.lit(False)).alias("cut_part"),
        F.coalesce((at(-2, "goes_on") > 0) & (at(-2, "stops") == 0), F.lit(False)).alias("cut_word"),
        context.alias("cut_context"),
    )
    found = docs.select("doc_id", "source", "digest", "sound", "debris", "open").join(carried.withColumn("carried_on", F.lit(True)), "digest", "left").withColumn("carried_on", F.coalesce("carried_on", F.lit(False)))
    joined = found.drop("digest").join(seen, "doc_id")
    return joined.withColumn("truncated", _judge())


def _judge() -> Column:
    stops, on = F.col("stops"), F.col("goes_on")
    settled = stops + on > 0
    whole = (stops >= STOPS * (stops + on)) & ~F.col("only_ends")
    off = F.greatest(F.coalesce("known", F.lit(9)), F.lit(1))
    unsettled = off <= F.when(F.col("sound"), 1).otherwise(2)
    plain = F.col("debris") | F.col("open") | F.col("cut_part") | F.col("carried_on")
    return plain | F.when(settled, ~whole).otherwise(unsettled | F.col("cut_word") | (~F.col("sound") & F.col("cut_context")))


def truncated(df: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source) of the documents whose text breaks off.

    Null and blank texts don't break off; copies count each; doc_id has to be
    unique; an empty table gives an empty result; other columns are ignored.
    """
    return tails(df, vocabulary).where("truncated").select("doc_id", "source")


def rates(df: DataFrame, vocabulary: str) -> DataFrame:
    """Per source (lower case, without blanks around) the texts, the truncated ones and their rate."""
    source = F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    per = tails(df, vocabulary).groupBy(source.alias("source")).agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"))
    return per.withColumn("rate", F.col("truncated") / F.col("texts"))
