"""Broken pairs of prompt and response, with the type of the defect.

Refusals are found through templates: the sentences of all responses, masked to
their shapes, are clustered by verified MinHash. A cluster that recurs across
unrelated prompts, in responses that bring nothing of their own to any of them
(no name, path, number or code that the prompt hasn't), answers none of them:
it is a refusal template. Phrases of refusal break the tie where recurrence
can't tell: for clusters under too few prompts and for those that name things.
A response made of such templates and of sentences that mostly accompany them
refuses. Copies, foreign languages and broken ends are plain checks of the pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.minhash import SHINGLE, clusters
from skein.session import cut, spread

#: Share of the response that stands in the prompt, and of the prompt that the response holds, for a copy.
COPIED, COVERED = 0.75, 0.5
#: A sentence accompanies refusals if at least this share of its occurrences stand in responses that hold a template.
COMPANY = 0.5
#: A template recurs under at least so many different prompts, and at least this share of its responses bring nothing of their own.
PROMPTS, BARE = 3, 0.5

#: Stand-ins for no content.
STAND_INS = frozenset({"", "null", "none", "nil", "nan", "n a", "na", "empty", "no response", "no answer", "no output", "no content", "undefined", "tbd", "todo", "pending", "missing", "blank"})

#: How a refusal says that it won't do the work, by language.
DECLINES = re.compile(
    r"(?i)\b(?:can(?:no|')?t|won't|will not|not able to|unable to|must decline to|have to decline|refuse to|decline to|rather not|not willing to|not going to|don't feel comfortable)\s+(?:be\s+)?(?:\w+\s+)?"
    r"(?:help\b|assist\b|work on\b|provid|answer|comply\b|continu|edit|modif|chang|touch|do this|do that|support|respond|fulfil|engage|discuss|give|look at)"
    r"|\bno answer will be given\b|\bnot something i (?:do|can do|will do)\b|\boutside of what i'm allowed\b|\bguidelines (?:keep|prevent|stop|forbid)|\bi must decline\b|\bi have to refuse\b|\bagainst my (?:policy|guidelines)"
    r"|\bdabei kann ich nicht helfen|\bmuss ich (?:leider )?ablehnen|\bkann (?:ich )?(?:leider )?nicht (?:helfen|beantworten|weiterhelfen)|\bmöchte ich nicht (?:bearbeiten|ändern)"
    r"|\bje ne peux pas (?:répondre|aider|vous aider|modifier|traiter)|\bje dois refuser\b|\bje refuse de\b"
    r"|\bno puedo (?:ayudar|responder|modificar|atender)|\bdebo negarme\b|\bme niego a\b|\btengo que rechazar\b"
    r"|无法(?:协助|帮助|处理|回答|提供)|不能(?:修改|协助|帮助|处理|回答|提供)|拒绝(?:修改|处理|回答|协助)|请找其他人帮忙"
)

#: One of these stands in whatever DECLINES finds, and looking for them is cheap.
_HINTS = ("can't", "cannot", "cant ", "won't", "will not", "not able", "unable", "declin", "refus", "rather not", "not willing", "not going", "don't feel", "no answer", "not something", "outside of what", "guidelines", "against my", "ann ich", "ann nicht", "ann leider", "ablehn", "möchte ich nicht", "je ne peux", "no puedo", "negarme", "niego", "rechazar", "无法", "不能", "拒绝", "请找")

#: Function words by language, none shared between two of them.
FUNCTION_WORDS = {
    "en": "the and that which was were this with from now only after before when where because it its been have has on both so no not other same until into are",
    "de": "der das und nicht wird wurde ist auf dem den ein eine einer aus wenn nach zwei obwohl jetzt gibt es auch bleiben dass für bitte warum ohne nur kann vorher",
    "fr": "le les des une est était dans pour que qui ne pas après ce cette aucun maintenant sont mais fait et du où au aux chaque avec sans trop même deux ci",
    "es": "el los una se ha y en por para con la del que no al después está ahora ninguna pero cada sin cuando otras también más muy aunque dos ya las",
}
#: Words by which a prompt asks for an answer in a language.
ASKS = re.compile(
    r"(?i)(?:answer|repl(?:y|ies)|respond|write|antwort\w*|répond\w*|responde\w*|contest\w*|escrib\w*|écri\w*|schreib\w*)\W+(?:\w+\W+){0,4}?(?:in|auf|en)\s+"
    r"(english|german|french|spanish|chinese|englisch|deutsch|französisch|spanisch|chinesisch|anglais|allemand|français|espagnol|chinois|inglés|alemán|francés|español|chino)"
    r"|用\s*(英|德|法|西班牙|中|汉)[文语]"
)
LANGUAGES = {
    "en": ("english", "englisch", "anglais", "inglés", "英"),
    "de": ("german", "deutsch", "allemand", "alemán", "德"),
    "fr": ("french", "französisch", "français", "francés", "法"),
    "es": ("spanish", "spanisch", "espagnol", "español", "西班牙"),
    "zh": ("chinese", "chinesisch", "chinois", "chino", "中", "汉"),
}
_NAMED = {name: language for language, names in LANGUAGES.items() for name in names}
_WORDS = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_EVERY = {w: tuple(k for k, ws in _WORDS.items() if w in ws) for ws in _WORDS.values() for w in ws}

_THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
_SUBMIT = re.compile(r'^\s*<tool_call>\s*\{"tool"\s*:\s*"(?:submit|answer)".*?"(?:final_response|response|answer|text)"\s*:\s*"((?:[^"\\]|\\.)*)"\s*\}\s*\}\s*</tool_call>\s*$', re.S)
_CODE = re.compile(r"```.*?(?:```|$)", re.S)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n ]*\"|'[^'\n ]*'")
_NUMBER = re.compile(r"[\w.]*\d[\w.]*")
_JOINTS = frozenset("_/\\:@")
_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_SOUND = frozenset(".!?。！？…;:\"'”’»)]}*`")
_CLOSING = re.compile(r"</\w+>")
_PATH_STOP = re.compile(r"/\w*\.")
_MARKUP = re.compile(r"</?\w+>|```\w*")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")


def plain(text: str) -> str:
    """The response without its thoughts; a submitted final response for its call."""
    text = _THINK.sub("", text)
    if m := _SUBMIT.match(text):
        text = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1])
    return text


def is_empty(text: str | None) -> bool:
    """Blank, markup without content, or a stand-in for no content, at any length."""
    if text is None:
        return True
    if "<" in text or "`" in text:
        text = _MARKUP.sub(" ", _THINK.sub("", text))
    # a stand-in has at most three words
    return " ".join(m[0].lower() for m in islice(_TOKEN.finditer(text), 4)) in STAND_INS


def breaks_off(text: str) -> bool:
    """Ends inside a code block, a tool call, a word or a sentence."""
    if text.count("```") % 2 or text.count("<tool_call>") > text.count("</tool_call>"):
        return True
    end = text.rstrip()
    if end[-1:] in _SOUND or (end[-1:] == ">" and _CLOSING.fullmatch(end, max(0, end.rfind("<")))):
        return end[-1] == "." and "/" in end and bool(_PATH_STOP.fullmatch(end, end.rfind("/")))
    last = end.rsplit("\n", 1)[-1]
    if _ITEM.match(last):
        return "/" in last and not re.search(r"\.\w{1,5}$", last)
    return True


def masked(text: str) -> tuple[list[str], list[str]]:
    """The text's words with names (paths, joined or quoted ones) and numbers as ``x``, and those names and numbers."""
    names: list[str] = []
    if "`" in text or '"' in text or "'" in text:
        names = [n for n in _QUOTED.findall(text) if len(n) > 2]
        text = _QUOTED.sub(" x ", text)
    out = []
    for word in text.split():
        if not word.isalpha():
            if not _JOINTS.isdisjoint(word):
                names.append(word)
                word = "x"
            elif not word.strip(".,;:!?()").isalpha() and (found := _NUMBER.findall(word)):
                names += found
                word = _NUMBER.sub(" x ", word)
        out.append(word)
    return out, names


def language(text: str) -> str | None:
    """The language of most of the prose: en, de, fr, es, zh, or None if there is too little."""
    return _spoken(_TOKEN.findall(" ".join(masked(_CODE.sub(" ", text) if "```" in text else text)[0]).lower()))


def _spoken(tokens: list[str]) -> str | None:
    score = dict.fromkeys(_WORDS, 0.0)
    for owners in filter(None, map(_EVERY.get, tokens)):
        for k in owners:
            score[k] += 1 / len(owners)
    han = 0 if all(map(str.isascii, tokens)) else sum("一" <= t[0] <= "鿿" for t in tokens)
    best = max(score, key=score.get)
    if han > 6 and han / 2 > score[best]:
        return "zh"
    return best if score[best] >= 2 and len(tokens) >= 4 else None


def asked_language(prompt: str) -> str | None:
    """The language that the prompt asks for."""
    found = list(ASKS.finditer(prompt))
    return _NAMED.get((found[-1][1] or found[-1][2]).lower()) if found else None


def is_copy(prompt: str, response: str) -> bool:
    """Nearly all of the response is the prompt, and most of the prompt."""
    a, b = _TOKEN.findall(prompt.lower()), _TOKEN.findall(response.lower())
    if not a or not b:
        return False
    held = set(a)
    if len([t for t in b if t in held]) < COPIED * len(b):
        return False
    n = min(4, len(a), len(b))
    runs = set(zip(*(a[i:] for i in range(n))))
    inside = [False] * len(b)
    hit = set()
    for i, run in enumerate(zip(*(b[i:] for i in range(n)))):
        if run in runs:
            inside[i : i + n] = [True] * n
            hit.add(run)
    return sum(inside) >= COPIED * len(b) and len(hit) >= COVERED * len(runs)


def shape(sentence: str) -> str:
    """The sentence with names, numbers and quotations masked, in lower case."""
    return _shape(masked(sentence)[0])


def _shape(words: list[str]) -> str:
    return " ".join(_TOKEN.findall(" ".join(words).lower()))


def declines(sentence: str) -> bool:
    """Whether the sentence declines in so many words."""
    low = sentence.lower().replace("’", "'")
    return any(hint in low for hint in _HINTS) and bool(DECLINES.search(low))


def brings(names: list[str], prompt: str) -> bool:
    """Whether one of ``names`` doesn't stand in ``prompt``, which is in lower case; a word before a colon is no name."""
    for name in names:
        bare = name.strip(".,;:!?()[]{}`\"'").lower()
        if bare and bare not in prompt and (len(bare) < len(name.rstrip(".,;:!?")) or not bare.isalpha()):
            return True
    return False


def judge(prompt: str | None, response: str | None) -> tuple[str | None, bool, bool, list[tuple[str, bool, bool]]]:
    """The plain defect of a pair, whether the response gives code, whether it brings anything of its own, and its sentences as (shape, declines, candidate).

    A sentence is a candidate if it brings nothing of its own, or if some sentence of its response declines.
    """
    if is_empty(response):
        return "empty", False, False, []
    text, prompt = plain(response), prompt or ""
    sentences = [s for s in _SENTENCE.split(_CODE.sub("\n", text) if "```" in text else text) if s.strip() and not s.lstrip().startswith(">")]
    read = [masked(s) for s in sentences]
    shapes = [_shape(words) for words, _ in read]
    low = text.lower().replace("’", "'")
    hinted = any(hint in low for hint in _HINTS)
    refused = [hinted and declines(s) for s in sentences]
    asked = prompt.lower()
    own = [brings(names, asked) for _, names in read]
    told = [(s, d, not o or True in refused) for s, d, o in zip(shapes, refused, own) if s]
    spoken, wanted = _spoken(" ".join(shapes).split()), language(prompt)
    if is_copy(prompt, text):
        defect = "copied"
    elif breaks_off(response):
        defect = "truncated"
    elif spoken and wanted and spoken != wanted and spoken != asked_language(prompt):
        defect = "other_language"
    else:
        defect = None
    code = "```" in text or "<tool_call>" in text
    return defect, code, code or True in own, told


def pairs(df: DataFrame) -> DataFrame:
    """One pass over the pairs: rollout_row_id, defect, code, own, the prompt's number, and the sentences; only candidates carry their shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
        sentence = pa.struct([("digest", pa.int64()), ("shape", pa.string()), ("declines", pa.bool_())])
        for batch in batches:
            prompts = batch.column(1).to_pylist()
            got = [judge(p, r) for p, r in zip(prompts, batch.column(2).to_pylist())]
            flat = [s for *_, told in got for s in told]
            offsets = [0, *accumulate(len(told) for *_, told in got)]
            digests = pa.array([number(s) for s, _, _ in flat], pa.int64())
            values = pa.StructArray.from_arrays([digests, pa.array([s if c else None for s, _, c in flat], pa.string()), pa.array([d for _, d, _ in flat], pa.bool_())], fields=list(sentence))
            told = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            words = [number(" ".join(_TOKEN.findall(p.lower())) if p else "") for p in prompts]
            yield pa.record_batch([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.bool_()), pa.array(words, pa.int64()), told], ["rollout_row_id", "defect", "code", "own", "prompt", "sentences"])

    return spread(df.select("rollout_row_id", "prompt", "assistant_response"), "rollout_row_id").mapInArrow(run, "rollout_row_id long, defect string, code boolean, own boolean, prompt long, sentences array<struct<digest:long,shape:string,declines:boolean>>")


def sentence_clusters(judged: DataFrame) -> DataFrame:
    """(rollout_row_id, prompt, own, digest, declines, cluster, words) of every occurrence of a sentence shape that is a candidate anywhere.

    Copied prompts say nothing about answers, so they are left out unless they decline.
    """
    declined = F.exists("sentences", lambda s: s.declines)
    told = judged.where(F.coalesce(F.col("defect") != "copied", F.lit(True)) | declined)
    said = told.select("rollout_row_id", "prompt", "own", F.explode("sentences").alias("s")).select("rollout_row_id", "prompt", "own", "s.digest", "s.shape", "s.declines")
    texts = cut(said.where("shape IS NOT NULL").groupBy("digest").agg(F.first("shape").alias("shape")))
    words = texts.select("digest", F.size(F.split("shape", " ")).alias("words"))
    return said.drop("shape").join(clusters(texts), "digest").join(words, "digest")


def refusal_templates(said: DataFrame) -> DataFrame:
    """(cluster, refusal) of the clusters of ``sentence_clusters``.

    A cluster of full shingles (SHINGLE words or more) is a template if it
    recurs under PROMPTS prompts or more and at least BARE of its occurrences
    stand in responses that bring nothing of their own. For the others the
    phrases decide: most occurrences decline.
    """
    by_prompt = said.groupBy("cluster", "prompt").agg(F.count("*").alias("n"), F.count_if("declines").alias("n_declines"), F.count_if(~F.col("own")).alias("n_bare"), F.min("words").alias("words"))
    per = by_prompt.groupBy("cluster").agg(F.count("*").alias("prompts"), F.sum("n").alias("n"), F.sum("n_declines").alias("n_declines"), F.sum("n_bare").alias("n_bare"), F.min("words").alias("words"))
    recurs = (F.col("prompts") >= PROMPTS) & (F.col("n_bare") >= BARE * F.col("n")) & (F.col("words") >= SHINGLE)
    return per.select("cluster", (recurs | (F.col("n_declines") >= 0.5 * F.col("n"))).alias("refusal"))


def refusing(judged: DataFrame) -> DataFrame:
    """rollout_row_id of the responses that consist of refusal templates and of their company."""
    said = cut(sentence_clusters(judged))
    marked = cut(said.join(refusal_templates(said), "cluster").select("rollout_row_id", "cluster", "refusal"))
    rows = marked.where("refusal").select("rollout_row_id").distinct()
    beside = marked.join(rows.withColumn("refuses", F.lit(1)), "rollout_row_id", "left")
    company = beside.groupBy("cluster").agg((F.bool_or("refusal") | (F.count("refuses") >= COMPANY * F.count("*"))).alias("company")).where("company")
    covered = beside.where("refuses = 1").join(company, "cluster").groupBy("rollout_row_id").agg(F.count("*").alias("covered"))
    whole = judged.where("NOT code").select("rollout_row_id", F.size("sentences").alias("said"))
    return covered.join(whole, "rollout_row_id").where("covered = said").select("rollout_row_id")


def defects(df: DataFrame) -> DataFrame:
    """(rollout_row_id, defect) of every defective pair, one defect each.

    In this order: empty, refusal, copied, truncated, other_language. A null
    response is empty; a null prompt can't be copied nor name a language.
    Repeated attempts count each; rollout_row_id has to be unique; an empty
    table gives an empty result; further columns are ignored.
    """
    judged = cut(pairs(df))
    refused = refusing(judged).withColumn("refused", F.lit(True))
    both = judged.select("rollout_row_id", "defect").join(refused, "rollout_row_id", "left")
    label = F.when(F.col("defect") == "empty", "empty").when(F.col("refused"), "refusal").otherwise(F.col("defect"))
    return both.select("rollout_row_id", label.alias("defect")).where("defect IS NOT NULL")
