from __future__ import annotations

import random
import re

from compare import rows

from citespark.llm.decontam import contamination, without_contaminated
from citespark.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_query_matches_sql(spark, data, duck):
    got = QUERIES["op3_decontamination"](spark, data).toPandas()
    assert rows(got) == rows(duck.sql(ORACLE_SQL["op3_decontamination"]).df())
    assert got.contaminated.any()


def brute(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    wins = []
    for i, t in items:
        w = words(t)
        k = min(len(w), 10)
        wins += [(i, w[j : j + k]) for j in range(len(w) - k + 1)] if k else []
    out = []
    for d, t in docs:
        w = words(t)
        hit, got = set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    got.add(i)
        out.append((d, len(w), len(hit), sorted(str(i) for i in got if i is not None), bool(hit)))
    return sorted(out, key=str)


def test_short_items_repeats_and_nulls(spark, awkward):
    r = random.Random(8)
    voc = ["aa", "bb", "cc", "dd", "É", "é"]
    docs = [(i, " ".join(r.choice(voc) for _ in range(r.randrange(0, 60)))) for i in range(40)] + [(5, "AA bb, cc-dd"), (None, "aa bb aa bb cc cc dd dd aa aa bb"), (41, None)]
    items = [(1, "aa bb cc"), (2, "dd"), (3, " ".join(r.choice(voc[:3]) for _ in range(12))), (4, None), (5, "..."), (6, docs[3][1]), (6, docs[4][1]), (None, "cc cc dd dd aa"), (7, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(d, b).collect()), key=str)
    assert got == brute(docs, items)
    rows_ = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(awkward, b).collect()), key=str)
    assert got == brute(rows_, items)


def test_empty_tables_and_filter(spark, awkward, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, none).count() == 0
    assert contamination(awkward, none).where("contaminated").count() == 0
    item = spark.createDataFrame([(1, "foo BAR baz qux quux and five more words here"), (2, "a")], "item_id long, text string")
    out = without_contaminated(awkward, item)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    item = spark.createDataFrame([(1, awkward.where("doc_id = 5").first().text[200:400])], "item_id long, text string")
    assert without_contaminated(awkward, item).where("doc_id = 5").count() == 0


def test_filter_takes_short_items(spark):
    """Items of three to nine words take out the documents that hold them whole; those of one or two words don't."""
    texts = ["so Foo BAR, baz it is", "foo bar qux baz", "one two three four five six seven eight nine and more", "one two three four five six seven eight", "lone pair", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "foo bar baz"), (2, "one two three four five six seven eight nine"), (3, "lone pair"), (4, "qux"), (5, None)]
    out = without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_native_plan(spark, data):
    plan = QUERIES["op3_decontamination"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
