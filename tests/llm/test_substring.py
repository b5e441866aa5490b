from __future__ import annotations

import random
import re

from citespark.llm.substring import LONG, MIN_WORDS, SENTENCES, without_repeats
from llmprose import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


FAR = "。！？।"


def weight(word):
    return max(1, sum(ord(c) >= 0x800 for c in word) // 2)


def cut(text):
    """(words, start, end, weight) of each sentence; end is where the next one starts."""
    out, now, held = [], [], 0
    for m in re.finditer(f"[^\x20\x09-\x0d{FAR}]*[{FAR}]|[^\x20\x09-\x0d{FAR}]+", text):
        ends = bool(now) and ((now[-1][0][-1] in ".!?" and m.start() > now[-1][2]) or "\n" in text[now[-1][2] : m.start()] or now[-1][0][-1] in FAR)
        part = 0 if ends else held // LONG
        if now and (ends or part != now[-1][3]):
            out.append(now)
            now = []
        held = 0 if ends else held
        now.append((m[0], m.start(), m.end(), part))
        held += weight(m[0])
    out += [now] if now else []
    starts = [s[0][1] for s in out] + [len(text)]
    return [(tuple(w[0].translate(LOWER) for w in s), starts[i], starts[i + 1], sum(weight(w[0]) for w in s)) for i, s in enumerate(out)]


def runs(s):
    """Every run of so many consecutive sentences, all of a shorter text, of enough words."""
    k = min(SENTENCES, len(s))
    return [(i, i + k) for i in range(len(s) - k + 1) if k and sum(x[3] for x in s[i : i + k]) >= MIN_WORDS]


def brute(docs):
    every: dict = {}
    cuts = [cut(t or "") for _, t in docs]
    for d, (i, _) in enumerate(docs):
        for a, b in runs(cuts[d]):
            every.setdefault(tuple(x[0] for x in cuts[d][a:b]), []).append(((i is None, i or 0), a, d))
    out = []
    for d, (i, t) in enumerate(docs):
        s, gone = cuts[d], set()
        for a, b in runs(s):
            at = every[tuple(x[0] for x in s[a:b])]
            if min(x[0] for x in at) < (i is None, i or 0) or any(x[2] == d and x[1] < a for x in at):
                gone |= set(range(a, b))
        left = None if t is None else (t[: s[0][1]] if s else t) + "".join(t[x[1] : x[2]] for k, x in enumerate(s) if k not in gone)
        out.append((i, len(s), len(gone), left))
    return sorted(out, key=str)


def test_matches_brute_force(spark, documents):
    r = random.Random(6)
    shared = [prose(r.randrange(20, 90), 100 + k) for k in range(8)]
    docs = []
    for i in range(50):
        parts = [prose(r.randrange(0, 60), 500 + i)] + [r.choice(shared) for _ in range(r.randrange(0, 3))] + [prose(r.randrange(0, 30), 900 + i)]
        docs.append((i, r.choice(["\n", " ", "\n\n"]).join(parts)))
    docs += [(60, None), (61, ""), (62, " \n "), (3, docs[3][1]), (None, shared[0]), (63, "No stop " * 60), (64, "no STOP " * 60), (65, "One. " * 80), (66, "漢字が並ぶ文です。次の文もここに並ぶ。三つ目の文がある！終わり" * 3), (67, "前。漢字が並ぶ文です。次の文もここに並ぶ。三つ目の文がある！終わり"), (68, "a b. c d."), (69, "a.b c. " * 9)]
    docs += [(None, f"{prose(30, 7)} {shared[1]}"), (None, shared[1])]
    got = sorted(((x.doc_id, x.n_sentences, x.n_removed, x.text) for x in without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute(docs)
    sample = [(x.doc_id, x.text) for x in documents.limit(120).collect()]
    got = sorted(((x.doc_id, x.n_sentences, x.n_removed, x.text) for x in without_repeats(spark.createDataFrame(sample, "doc_id long, text string")).collect()), key=str)
    assert got == brute(sample)


def test_long_passage_goes_from_all_but_the_first(spark):
    passage = prose(60, 1)
    docs = [(i, f"{prose(30, 50 + i)}\n{passage}\n{prose(30, 80 + i)}") for i in range(9)]
    got = {x.doc_id: x.text for x in without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and all(passage not in got[i] and prose(30, 50 + i) in got[i] and prose(30, 80 + i) in got[i] for i in range(1, 9))


def test_awkward_rows(awkward, no_docs):
    assert without_repeats(awkward).count() == awkward.count()
    assert without_repeats(no_docs).count() == 0


def test_parameters(spark):
    docs = spark.createDataFrame([(1, "One two. Three four. Five six."), (2, "Seven. One two. Three four. Eight.")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in without_repeats(docs, sentences=2, min_words=4).collect()}
    assert got == {1: "One two. Three four. Five six.", 2: "Seven. Eight."}
