"""Overlaps against the edit distance of every pair."""

import random

from skein.llm import overlap as O
from skein.llm.leaks import words

SCHEMA = "task_row_id long, task_id string, repo_slug string, task_partition string, problem_statement string, digest string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != x))
    return row[-1]


def test_pairs_match_brute_force(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 8, 16, 40]))] for _ in range(25)]
    rows = []
    for i in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 8])):
            k = rng.randrange(len(own))
            what = rng.choice("sid")
            own[k : k + (what != "i")] = [] if what == "d" and len(own) > 1 else [f"v{rng.randrange(9)}"]
        text = " ".join(own)
        text = rng.choice([text, text.upper() + ".", "- " + text.replace(" ", "\n"), f"**{text}**"])
        rows.append((i, f"job-{i}", "o/n", rng.choice(["train", "Training ", "val", "TEST", None]), text, "x"))
    rows += [(900, None, None, "train", None, "x"), (901, None, None, "test", "  ", "x"), (902, None, None, "train", "?!", "x"), (903, None, None, "test", "...", "x")]
    got = {(r.train_row_id, r.held_row_id, r.edits) for r in O.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    part = {r[0]: (r[3] or "").strip().lower() for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            if part[a[0]] in ("train", "training") and part[b[0]] in ("val", "test") and a[4] and b[4]:
                x, y = words(a[4]), words(b[4])
                d = distance(x, y)
                if x and y and d <= int(O.TOLERANCE * max(len(x), len(y))):
                    want.add((a[0], b[0], d))
    assert got == want and want


def test_report_and_empty(spark):
    long = "tale " * 50_000
    rows = [(1, "job-1", "O/N", "train", long, ""), (2, "job-2", "https://h/o/n.git", "test", long.upper(), ""), (3, "job-3", "o/n", "eval", "other words here", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.split, r.repository): (r.held_rows, r.overlapping, r.exact) for r in O.overlap_report(df).collect()}
    assert got == {("test", "o/n"): (1, 1, 1), ("eval", "o/n"): (1, 0, 0)}
    assert O.overlaps(df.limit(0)).count() == 0


def test_one_template_for_all(spark):
    """Statements that share all their words but a few: the hot keys lose no pair and find no other, whatever the lengths."""
    rng = random.Random(9)
    frame = [f"frame{i}" for i in range(24)]
    rows = []
    for i in range(160):
        own = list(frame)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"own{rng.randrange(400)}"
        own += [f"end{rng.randrange(3)}"] * rng.randrange(4)
        rows.append((i, ["train", "eval", "test"][i % 3], " ".join(own)))
    df = spark.createDataFrame([(i, t, p, None, None) for i, p, t in rows], "task_row_id long, problem_statement string, task_partition string, repo_slug string, task_id string")
    got = {(r.train_row_id, r.held_row_id) for r in O.overlaps(df).collect()}

    texts = {i: t.split() for i, _, t in rows}
    want = {(i, j) for i, p, _ in rows if p == "train" for j, q, _ in rows if q != "train" and distance(texts[i], texts[j]) <= int(O.TOLERANCE * max(len(texts[i]), len(texts[j])))}
    assert got == want and len(want) > 20
