from __future__ import annotations

import random
import re

import numpy as np
import pytest

from citespark.llm.common import distinct_by_text
from citespark.llm.components import components
from citespark.llm.minhash import COORDINATES, MISS, banding, forest, near_duplicates, one_of_each, sketch

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(rows, k, percent):
    s = sets(rows, k)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def test_documents_match_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for k, th in ((3, 0.85), (5, 0.8)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents, k, th).collect()}
        assert got == brute(rows, k, round(100 * th))


def test_large_group_of_near_copies(spark):
    """More near copies than a bucket compares pair by pair: blocks, and links that only hold over some of the copies."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    want = brute(rows, 3, 85)
    assert got == want
    assert len({c for _, c in want.values()}) > 5


def test_awkward_rows(spark, awkward, no_docs):
    got = near_duplicates(awkward, 3, 0.85).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[4].component_id == 4
    assert by[8].n_shingles == by[7].n_shingles - 2 == 1 or by[8].n_shingles == 1
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert near_duplicates(no_docs).count() == 0


def test_one_of_each_keeps_columns(awkward):
    out = one_of_each(awkward)
    assert out.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, i) for i in range(1, 9)] + [(True, 0)]


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 800).astype(np.uint64))
    common, rest = a[:640], a[640:]
    x, y = np.sort(np.concatenate([common, rest[:80]])), np.sort(np.concatenate([common, rest[80:160]]))
    one = a[:1]
    values = np.concatenate([x, y, one])
    s = sketch(values, np.array([0, len(x), len(x) + len(y), len(values)]), 1024)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 640 / 800) < 0.06


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.85, 0.95])
def test_banding_keeps_links(threshold):
    bands, rows = banding(threshold)
    assert bands * rows <= COORDINATES and (1 - threshold**rows) ** bands <= MISS


def test_pairs_at_a_low_threshold(spark):
    """Planted pairs of similarity just over one half: all are found, whatever number of bands they share."""
    r = random.Random(8)
    rows = []
    for i in range(500):
        common = [f"c{i}x{j}" for j in range(70)]
        for side in (0, 1):
            rows.append((2 * i + side, " ".join(common + [f"u{r.randrange(10**9)}" for _ in range(34)])))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 0.5).collect()
    lost = sum(x.doc_id % 2 == 1 and x.component_id != x.doc_id - 1 for x in got)
    assert lost == 0 and len(got) == 1000


def test_texts_of_one_document(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five", "red green blue white black", "")
    rows = [(5, a), (5, b), (3, a), (9, b), (7, c), (7, d), (8, c), (None, a)]
    got = sorted((x.doc_id, x.component_id, x.kept) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect() if x.doc_id is not None)
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 3, False)]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
    assert sorted((x.doc_id or 0, x.text) for x in out) == [(0, a), (3, a), (7, d)]


def near_copies(n, seed, length=80, changes=4):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, changes)):
            w[r.randrange(length)] = f"x{r.randrange(10**6)}"
        yield i, " ".join(w)


def test_block_pairs_grow_with_the_blocks(spark, monkeypatch):
    """A large group of near copies and some that only resemble it: far fewer pairs of blocks than all."""
    import citespark.llm.minhash as m

    seen = []
    whole = m.materialize
    monkeypatch.setattr(m, "materialize", lambda df, name: seen.append((name, out := whole(df, name))) or out)
    rows = list(near_copies(3000, 3, 120, 3)) + [(10_000 + i, t) for i, t in near_copies(60, 3, 120, 30)]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.8).collect()
    placed = dict(seen)["placed"]
    alone = placed.where("pure is null").count()
    print("placed", placed.count(), alone, placed.select("block").distinct().count())
    assert alone < 0.1 * placed.count()
    labels = {x.doc_id: x.component_id for x in got}
    assert len({labels[i] for i in range(3000)}) < 3000
    s = sets(rows[:40] + rows[-60:], 3)
    for a in s:
        for b in s:
            both = len(s[a] & s[b])
            if a < b and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                assert labels[a] == labels[b]


def test_distinct_by_text():
    v, b = distinct_by_text(np.array([3, 1, 3, 9], np.uint64), np.array([0, 3, 3, 4]))
    assert v.tolist() == [1, 3, 9] and b.tolist() == [0, 2, 2, 3]


@pytest.mark.parametrize("half", [0, 4])
def test_forest_holds_the_same_classes(half):
    r = np.random.default_rng(7)
    pool = r.integers(0, 2**60, 40).astype(np.int64)
    group = [np.unique(np.concatenate([pool[: 30 + i % 4], pool[35 + i % 5 : 36 + i % 5]])) for i in range(9)]
    pairs = forest(group, 85, half)
    assert len(pairs) <= 8
    if half:
        assert all((a < half) != (b < half) for a, b in pairs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (160, 100), (100, 160)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    """No round only shows that the one before changed nothing."""
    from citespark.llm import components as c

    star, rounds = c._star, []
    monkeypatch.setattr(c, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    path = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(10, 11)], "a long, b long")
    got = sorted(map(tuple, c.components(path).collect()))
    assert got == [(i, 0) for i in range(7)] + [(10, 10), (11, 10)]
    assert sum(rounds) == 3


def test_meetings_of_a_block_that_meets_many(spark):
    """The block's meetings are dealt to several tasks, in few tasks altogether, and none is lost."""
    from citespark.llm.minhash import _meetings

    blocks = spark.createDataFrame([(i, [i], [[i, i]]) for i in range(200)], "block long, r array<long>, s array<array<long>>")
    want = {(i, 199) for i in range(199)} | {(3, 7), (3, 8)}
    got = _meetings(spark.createDataFrame(sorted(want), "block long, block2 long"), blocks)
    rows = got.collect()
    assert {(x.r[0], x.r2[0]) for x in rows} == want and len(rows) == len(want)
    assert all(x.s == [[x.r[0]] * 2] and x.s2 == [[x.r2[0]] * 2] for x in rows)
