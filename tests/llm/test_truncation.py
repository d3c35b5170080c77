"""Truncation: cut texts found, whole texts with odd ends left alone."""

import random

import pytest

from skein.llm import truncation as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SENTENCES = [
    "The worker closes the file before the first test has started.",
    "Nobody noticed because the old check only covers the second case.",
    "This change was made after the call to `{a}` in lib/{b}.py failed for {n} users.",
    "We saw {n} lost rows within the last hour, all of them from `{a}`.",
]
CLOSERS = ["Thanks in advance", "Labels: open, later", "Waiting for the next run...", "```\nx = 1\n```", "- lib/one.py\n- lib/two.py"]


def text(rng):
    parts = [s.format(a=f"{rng.choice('abcdef')}un_{rng.choice('xyz')}et", b=rng.choice(["load", "save"]), n=rng.randint(2, 900)) for s in rng.choices(SENTENCES, k=6)]
    return " ".join(parts[:3]) + "\n\n" + " ".join(parts[3:])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(600):
        t = text(rng)
        if i % 10 == 0:
            last = t.rindex(". ") + 2
            t = t[: rng.randint(last + 6, len(t) - 3)].rstrip() + rng.choice(["", "…", "...", "\\u00", "�", " [truncated]"])
            cut.add(i)
        elif i % 10 == 1:
            t += "\n\n" + rng.choice(CLOSERS)
        rows.append((i, " Src" if i % 2 else "src", t, "x"))
    return rows, cut


def test_cut_texts_are_found(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, hash string")
    got = {r.doc_id for r in T.truncated(df, VOCABULARY).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(got)


def test_copies_nulls_long_and_empty(spark, corpus):
    rows, cut = corpus
    extra = [(1000 + k, None, rows[0][2], "x") for k in range(3)] + [(2000, "s", None, "x"), (2001, "s", "  ", "x"), (2002, "s", "word " * 300_000 + "\n```\nopen", "x")]
    df = spark.createDataFrame(rows + extra, "doc_id long, source string, text string, hash string")
    got = {r.doc_id for r in T.truncated(df, VOCABULARY).collect()}
    assert {1000, 1001, 1002, 2002} <= got and not {2000, 2001} & got
    rates = {r.source: r for r in T.rates(df, VOCABULARY).collect()}
    assert rates["src"].texts == 600 and 0.09 < rates["src"].rate < 0.12
    assert T.truncated(df.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("text,body,dots,debris", [("so it…", "so it", True, False), ("so it [... 12 more characters]", "so it", False, True), ("so\\u00", "so", False, True), ("a &am", "a", False, True), ("plain.", "plain.", False, False)])
def test_marks(text, body, dots, debris):
    assert T.strip_marks(text) == (body, dots, debris)


def test_identifier_counts_do_not_depend_on_tasks(spark):
    rows = [(i, "s", f"The call to load_handlers failed for {i} users.", "x") for i in range(60)] + [(60, "s", "The name is now x_hand", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, hash string")
    one, many = ({r.doc_id for r in T.tails(df.repartitionByRange(n, "doc_id"), VOCABULARY).where("cut_part").collect()} for n in (1, 61))
    assert one == many == set()


def test_cuts_without_siblings(spark):
    long = "Vessel registry of the harbour office, second ledger: the quartermaster counted"
    rows = [(1, "Perennial shrubs outlived every orchard.\n\nGardeners whispered proudly about peren"), (2, "Gardeners whispered loudly about perennial shrubs."), (3, long + " eleven barrels"), (4, long + " eleven barrels of tar and pitch.\nSigned"), (5, long + " nine crates.\n\nWith regards, Zo")]
    rows += [(10 + i, f"Zebra {a} and so they agreed because of the weather. Rain fell.") for i, a in enumerate(("lions", "tigers", "otters", "badgers"))] + [(20, "Unlike yesterday's plan, trains ran late because of the")]
    df = spark.createDataFrame([(i, "s", t, "x") for i, t in rows], "doc_id long, source string, text string, hash string")
    assert {r.doc_id for r in T.truncated(df, VOCABULARY).collect()} == {1, 3, 20}


def test_prefixes_without_templates(spark):
    """Paragraphs of the standard library's own documentation, one in ten cut within a sentence: most are found, few whole ones are."""
    import ast
    import random
    import sysconfig
    from pathlib import Path

    found = set()
    for path in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        try:
            tree = ast.parse(path.read_text())
        except (SyntaxError, UnicodeDecodeError):
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.ClassDef, ast.Module)):
                found |= {" ".join(p.split()) for p in (ast.get_docstring(node) or "").split("\n\n")}
    texts = sorted(p for p in found if len(p) > 120 and p[-1] == "." and ">>>" not in p)
    rng = random.Random(3)
    rows, cut = [], set()
    for i, text in enumerate(texts):
        if i % 10 == 0 and (short := text[: rng.randrange(len(text) // 2, len(text) - 2)].rstrip())[-1].isalnum():
            cut.add(i)
            text = short
        rows.append((i, text, "x"))
    got = {r.doc_id for r in T.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string"), VOCABULARY).collect()}
    assert len(cut) > 80 and len(got & cut) >= 0.7 * len(cut) and len(got - cut) <= 0.01 * len(rows)


def test_texts_that_begin_others(spark):
    """The join of whole texts against every pair of texts."""
    import random

    rng = random.Random(5)
    base = ["The cache of the river module was read before it was filled and " + " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30)) for _ in range(40)]
    texts = base + [b[: rng.randrange(20, len(b))].rstrip() for b in base for _ in range(3)] + base[:5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    digests = {r.doc_id: r.d for r in df.selectExpr("doc_id", "xxhash64(text) AS d").collect()}
    got = {r.digest for r in T._carried_on(T._bodies(df)).collect()}
    want = {digests[i] for i, t in enumerate(texts) if len(t) >= T.PREFIX and any(len(u) > len(t) and u.startswith(t) for u in texts)}
    assert got == want


def test_counts_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    rows = [(i, f"The cache in lib/part_{i}.py holds {i} rows. It was read early by `load_{i}` and the rest", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    columns = ["doc_id", "goes_on", "stops", "known", "cut_part", "cut_word", "cut_context", "truncated"]
    one = T.tails(df.coalesce(1), VOCABULARY).select(*columns).orderBy("doc_id").collect()
    monkeypatch.setattr(T, "CHUNK", 200)
    assert T.tails(df.repartition(9), VOCABULARY).select(*columns).orderBy("doc_id").collect() == one
