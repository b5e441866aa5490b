from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from citespark.llm.quality import BITS, BLOCK, ORDER, Models, _gathered, arrays, base_counts, classes, good_documents, grams, judged, language_models, log_probabilities, scores
from citespark.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    wins: dict = {}
    for i in range(len(w) - 2):
        wins.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for at in wins.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)


def test_base_counts_match_brute_force(documents, awkward):
    texts = [r.text for r in documents.collect()] + [r.text for r in awkward.collect()] + ["a a a a a a", "x y z x y z", "l\nl\n\nl ", "#*$%&|<> é"]
    got = base_counts(pa.array(texts, pa.string()))
    assert list(zip(*(got[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [brute(t) for t in texts]


def test_query(spark, data, documents):
    got = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, data).collect()}
    for r in documents.collect():
        w, c, s, d, n = brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (w, c, s, d, n)
        assert g.base_failed == (w < 50 or 100 * n > 50 * w)
        assert not (g.kept and g.base_failed)


def test_separates_labelled_documents(spark):
    """Held against labels that the operator never sees, of the documents on which its bands weren't chosen."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id % 2 = 1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = judged(docs).join(labels, "doc_id").where("not base_failed").selectExpr("quality", "cast(kept as int) kept").groupBy("quality").avg("kept").collect()
    kept = {r.quality: r[1] for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.45


def plain_model(texts):
    """Modified Kneser-Ney in plain Python, by tuples of classes: p(tuple)."""
    cls, bounds = classes(texts)
    count: dict = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        padded = [0] * (ORDER - 1) + cls[a:b].tolist()
        for g in {tuple(padded[i : i + ORDER]) for i in range(b - a)}:
            count[g] = count.get(g, 0) + 1
    levels = {ORDER: count}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    d = {}
    for n, c in levels.items():
        k = [sum(x == i for x in c.values()) for i in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] and k[1] else None
        raw = [(i - (i + 1) * y * k[i] / k[i - 1] if k[i - 1] else i / 2) if y else (0.5, 0.75, 0.9)[i - 1] for i in (1, 2, 3)]
        d[n] = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), raw)] if y else raw
        if n == ORDER:
            d[n][0] = 1.0

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (1 << BITS)
        own = {h: c for h, c in levels[n].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = lambda c: d[n][min(c, 3) - 1]
        total = sum(own.values())
        return max(own.get(g, 0) - (cut(own[g]) if g in own else 0), 0) / total + sum(map(cut, own.values())) / total * p(g[1:])

    return p


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog sat", "каша и кот", "каша и пёс"]


def model_of(spark, texts):
    return arrays(language_models(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")).toArrow())["en"]


def test_model_matches_plain_python(spark):
    m, p = model_of(spark, TEXTS), plain_model(TEXTS)
    cls, bounds = classes([*TEXTS, "the cat sat", "зебра", "dog"])
    for key, got in zip(keys := grams(cls, bounds), log_probabilities(m, keys)):
        g = tuple(int(key) >> BITS * k & 4095 for k in range(ORDER - 1, -1, -1))
        assert abs(np.exp(got) - p(g)) < 1e-4 * p(g)
    text = TEXTS[0] * 40
    lp = log_probabilities(m, grams(*classes([text]))).astype(float)
    want = sum(-lp[i : i + BLOCK].sum() for i in range(0, len(lp), BLOCK)) / len(lp)
    assert abs(scores(Models({"en": m}, "", ["en"]), "en", [text])[0] - want) < 1e-6


def test_model_is_a_distribution(spark):
    m = model_of(spark, TEXTS)
    for context in ("the ", "at s", "zzzz", ""):
        cls, bounds = classes([context])
        packed = 0
        for c in cls.tolist():
            packed = packed << BITS | c
        every = np.int64(packed) << BITS | np.arange(1 << BITS)
        assert abs(np.exp(log_probabilities(m, every).astype(float)).sum() - 1) < 1e-3


def test_model_grows_with_the_corpus(spark):
    """Distinct n-grams of texts with new words: in proportion, not bounded by the classes."""
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4000)]
    size = lambda n: language_models(spark.createDataFrame([("en", " ".join(words[i : i + 20])) for i in range(0, n, 20) for _ in (0, 1)], "lang string, text string")).where(f"level = {ORDER}").count()
    assert size(4000) > 1.8 * size(2000)


def test_the_driver_gets_twelve_bytes_a_row(spark, documents, monkeypatch):
    """Neither the rows of the model table nor a plan of all its levels."""
    from pyspark.sql.classic.dataframe import DataFrame

    got, take = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: got.append(take(self)) or got[-1])
    docs = documents.select("lang", "text")
    rows = judged(documents).count() and language_models(docs).count()
    assert sum(t.nbytes for t in got) < 14 * rows
    assert not re.search("Join|Aggregate", language_models(docs)._jdf.queryExecution().optimizedPlan().toString())


def test_pieces_are_the_whole_model(spark):
    docs = spark.createDataFrame([(g, t) for t in TEXTS for g in ("en", "ru")], "lang string, text string")
    table = language_models(docs).repartition(3).cache()
    whole, models = arrays(table.toArrow()), Models({}, "", [], _gathered(table))
    for lang in ("en", "ru", "xx"):
        m = models.of(lang)
        assert m.keys() == whole.get(lang, {}).keys()
        assert all(np.array_equal(x, y) for at in m for x, y in zip(m[at], whole[lang][at]))


def test_awkward_rows(awkward, no_docs):
    got = judged(awkward)
    assert got.count() == awkward.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept and by[2].score is None
    assert judged(no_docs).count() == 0
    out = good_documents(awkward)
    assert out.columns == awkward.columns and {r.doc_id for r in out.collect()} <= {5}
