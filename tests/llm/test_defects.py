"""Defective pairs by type, sound answers that look like them, and the clusters behind."""

import random

from skein.llm import defects as D
from skein.llm import minhash as M

SCHEMA = "rollout_row_id long, prompt string, assistant_response string, sentences string"
ASK = "Find out why the test in lib/one.py fails when the cache is empty and repair it, because nobody has looked at it for weeks now."


def test_each_type(spark):
    sound = "I traced the failure to `load_cache` in lib/one.py. The guard was missing, and it is now in place before the first read."
    rows = {
        1: (ASK, None, "empty"), 2: (ASK, " ​\n", "empty"), 3: (ASK, "<think>\n</think>", "empty"), 4: (ASK, "N/A", "empty"), 5: (ASK, "```\n```", "empty"), 6: (ASK, "[no response]", "empty"),
        10: (ASK, sound, None), 11: (ASK, sound[:-20], "truncated"), 12: (ASK, sound + "\n```python\nx = 1", "truncated"), 13: (ASK, sound + '\n<tool_call>{"tool":"apply', "truncated"), 14: (ASK, sound + "\n\n- lib/one.py\n- lib/two.py", None), 15: (ASK, sound + "\n```python\nx = 1\n```", None),
        20: (ASK, ASK.upper(), "copied"), 21: (ASK, "> " + ASK + "\n\nDone.", "copied"), 22: (ASK, "> Find out why the test in lib/one.py fails\n\n" + sound, None),
        30: (ASK, "I cannot assist with this request.", "refusal"), 31: (ASK + " Now.", "I read it carefully. I cannot assist with this request. I hope you understand.", "refusal"), 32: (ASK, "I'm sorry for the noise, I cannot help with the old one. " + sound, None), 33: (ASK, "Debo negarme a cambiar lib/one.py.", "refusal"), 34: (ASK, "抱歉,我无法协助处理这个请求。", "refusal"),
        40: (ASK, "Der Wert wird jetzt erst gelesen, wenn der Puffer nicht leer ist, und die anderen Tests sind auch grün.", "other_language"), 41: (ASK + " Please answer in German.", "Der Wert wird jetzt erst gelesen, wenn der Puffer nicht leer ist, und die anderen Tests sind auch grün.", None),
        50: (None, sound, None), 51: (ASK, "word and the test is now " * 60_000 + "done.", None),
    }
    rows |= {100 + i: (ASK + f" Case {i}.", sound, None) for i in range(20)}
    df = spark.createDataFrame([(i, p, r, "x") for i, (p, r, _) in rows.items()], SCHEMA)
    got = {r.rollout_row_id: r.defect for r in D.defects(df).collect()}
    assert got == {i: d for i, (_, _, d) in rows.items() if d}
    assert D.defects(df.limit(0)).count() == 0


def test_clusters_hold_the_similar(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(12)]
    texts = []
    for b in base:
        for k in range(6):
            own = b.split()
            if k:
                own[rng.randrange(2)] = f"z{k}"
            texts.append(" ".join(own))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "digest long, shape string")
    got = {r.digest: r.cluster for r in M.clusters(df).collect()}
    sets = [set(M.shingles(t).tolist()) for t in texts]
    alike = lambda a, b: len(a & b) >= M.SIMILARITY * len(a | b)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                parent[root(i)] = root(j)
    assert all((got[i] == got[j]) == (root(i) == root(j)) for i in range(len(texts)) for j in range(i))


def test_refusals_of_one_prompt(spark):
    said = "I will not touch the billing ledger of this vendor."
    df = spark.createDataFrame([(i, ASK, said, "x") for i in (1, 2)], SCHEMA)
    assert {(r.rollout_row_id, r.defect) for r in D.defects(df).collect()} == {(1, "refusal"), (2, "refusal")}


def test_links_past_head_and_neighbour(spark, monkeypatch):
    a, b = M._permutations()
    monkeypatch.setattr(M, "_permutations", lambda: (a * 0, b))  # one bucket for all
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(1, one), (2, two), (3, one + " x"), (4, two + " x")], "digest long, shape string")
    got = {r.digest: r.cluster for r in M.clusters(df).collect()}
    assert got[1] == got[3] != got[2] == got[4]


WORDS = "river candle marble saddle thistle copper lantern meadow harbor velvet".split()


def test_unlisted_templates_are_found_by_recurrence(spark):
    """Three refusals that no phrase names, each under 30 unrelated prompts, found whole; a sound template beside them stays."""
    templates = [
        lambda i: "I'm afraid that is beyond what I am permitted to do.",
        lambda i: "That request falls outside my remit, so I will leave it alone.",
        # no two are equal: only the clusters tell that they recur
        lambda i: f"Purtroppo questo compito va oltre quello che mi è consentito fare in questa sede e quindi lo lascio a qualcun altro, caro {WORDS[i % 10]} {WORDS[i // 10]}",
    ]
    rows = []
    for k, said in enumerate(templates):
        assert not D.declines(said(0))
        rows += [(k * 100 + i, f"Why does the {WORDS[i % 10]} {WORDS[i // 10]} of module {i} fail with code {k}?", said(i) + ("" if k < 2 else "."), "x") for i in range(30)]
    rows += [(1000 + i, f"Why does lib/{w}.py fail on the {w}?", f"The check in lib/{w}_{i}.py was inverted, and every caller relied on it.", "x") for i, w in enumerate(WORDS)]
    # short everyday answers are no templates
    rows += [(2000 + i, f"Is the {w} done?", "Yes, it is.", "x") for i, w in enumerate(WORDS)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.rollout_row_id: r.defect for r in D.defects(df).collect()}
    assert got == {r[0]: "refusal" for r in rows if r[0] < 1000}


def test_clusters_decide(spark, monkeypatch):
    """Without links the template of which no two copies are equal goes unfound."""
    said = "Questo va oltre quello che mi è consentito fare in questa sede e quindi lo lascio volentieri a qualcun altro, caro {}."
    df = spark.createDataFrame([(i, f"Why does the {w} fail?", said.format(w), "x") for i, w in enumerate(WORDS)], SCHEMA)
    assert D.defects(df).count() == 10
    monkeypatch.setattr(D, "clusters", lambda texts: texts.selectExpr("digest", "string(digest) AS cluster"))
    assert D.defects(df).count() == 0


def test_empty_at_any_length():
    assert D.is_empty("<p></p>" * 500) and D.is_empty("```\n```\n" * 300) and D.is_empty(" \n" * 10_000)
    assert not D.is_empty("<p></p>" * 500 + "word")
    assert not D.breaks_off("All of it is done now.</final_answer_of_the_model>")


def test_recall_of_links():
    """Pairs at a similarity of 0.8 or more share a band nearly always."""
    rng = random.Random(4)
    a, b = M._permutations()
    hit = total = 0
    for _ in range(400):
        own = [f"w{rng.randrange(5000)}" for _ in range(80)]
        other = list(own)
        for _ in range(rng.randint(1, 2)):
            other[rng.randrange(80)] = "z"
        x, y = M.shingles(" ".join(own)), M.shingles(" ".join(other))
        if len(set(x) & set(y)) < M.SIMILARITY * len(set(x) | set(y)):
            continue
        total += 1
        bands = [((a * (s % M._PRIME) + b) % M._PRIME).min(axis=1).reshape(M.BANDS, M.ROWS) for s in (x, y)]
        hit += (bands[0] == bands[1]).all(axis=1).any()
    assert total > 100 and hit >= 0.97 * total
