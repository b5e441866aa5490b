from __future__ import annotations

from pyspark.sql import functions as F

from citespark.operators import cache, cascade, export, graph, match, paging


def test_coupling(spark):
    refs = spark.createDataFrame([(w, r) for w, rs in {1: "abcd", 2: "abcx", 3: "abyz", 4: "q"}.items() for r in rs] + [(1, "a"), (None, "a"), (2, None)], "work_id long, ref_id string")
    assert [tuple(r) for r in graph.coupling_edges(refs).collect()] == [(1, 2, 3)]
    assert {tuple(r) for r in graph.coupling_edges(refs, min_shared=2).collect()} == {(1, 2, 3), (1, 3, 2), (2, 3, 2)}
    assert [tuple(r) for r in graph.top_edges(graph.coupling_edges(refs, min_shared=2), 2).collect()] == [(1, 2, 3), (1, 3, 2)]


def test_nodes_kinds_caps_and_edges(spark):
    row = lambda *r: spark.createDataFrame(list(r), "origin_id long, work_id long, ord long")
    origins = spark.createDataFrame([(1,)], "origin_id long")
    works = spark.createDataFrame([(i, i) for i in range(1, 40)], "work_id long, citation_count long")
    n = graph.nodes(origins, row((1, 2, 0), (1, 3, 1), (1, 4, 2)), row((1, 2, 0), *((1, 10 + i, i) for i in range(20))), row((1, 3, 0), (1, 1, 1), (1, 30, 2)), works, 6)
    got = {r.work_id: (r.kind, r["rank"]) for r in n.collect()}
    assert got == {1: ("origin", 1), 30: ("related", 2), 23: ("citation", 3), 22: ("citation", 4), 21: ("citation", 5), 20: ("citation", 6)}
    kept = graph.nodes(origins, row((1, 2, 0), (1, 3, 1)), row(), row(), works)
    refs = spark.createDataFrame([(w, r) for w in (1, 2, 3) for r in "abc"], "work_id long, ref_id string")
    assert {tuple(r) for r in graph.edges(kept, refs).collect()} == {(1, 1, 2, 1, "direct"), (1, 1, 3, 1, "direct"), (1, 2, 3, 3, "cocite")}


def test_match_order_and_prefix(spark):
    lib = spark.createDataFrame(
        [(1, 10, "10.1/A", None, None, "First title here", "2001", 1), (1, 11, None, "https://arxiv.org/abs/2101.00001", None, "Second title", None, 2), (1, 12, None, None, "PMID: 123456", "Third title", "", 3),
         (1, 13, None, None, None, "A rather long title about small cell cancers", "2010", 4), (1, 14, "10.1/a", None, None, "Later item of equal DOI", "2002", 5)],
        "library_id long, item_id long, doi string, url string, extra string, title string, date string, ord long",
    )
    refs = spark.createDataFrame(
        [(1, 1, "10.1/a", None, None, "Second title", "", "2001"), (2, 1, "", "2101.00001", None, None, "x", None), (3, 1, None, None, "123456", "", "x", None), (4, 1, None, None, None, "", "SECOND, title!", None),
         (5, 1, None, None, None, "A rather long title about small cell cancers and more", "", "2011"), (6, 1, None, None, None, "A rather long title about small cell cancers and more", "", "2013"),
         (7, 1, None, None, None, "long title about small cell cancers", "", "2010"), (8, 1, None, None, None, "A rather long title about small cell can", "", None), (9, 2, "10.1/a", None, None, "", "zz", None)],
        "ref_id long, library_id long, doi string, arxiv string, pmid string, title string, text string, year string",
    )
    got = {r.ref_id: (r.item_id, r.key_type) for r in match.match_refs(refs, lib).collect()}
    assert got == {1: (14, "doi"), 2: (11, "arxiv"), 3: (12, "pmid"), 4: (11, "title"), 5: (13, "prefix"), 8: (13, "prefix")}
    filled = {r.ref_id: (r.lib_item_id, r.doi) for r in match.with_library_doi(refs, match.match_refs(refs, lib), lib).collect()}
    assert filled[1] == (14, "10.1/a") and filled[2] == (11, None) and filled[7] == (None, None)


def test_nearest_and_boxes(spark):
    anchors = spark.createDataFrame([(1, "d", 0, 0.0, 0.0, 1), (2, "d", 0, 0.0, 100.0, 2), (3, "d", 1, 0.0, 0.0, 3)], "anchor_id long, doc_id string, page int, x double, y double, ord long")
    points = spark.createDataFrame([(1, "d", 0, 0.0, 60.0), (2, "d", 0, 120.0, 0.0), (3, "d", 0, 120.3, 0.0), (4, "d", 2, 0.0, 0.0), (5, "d", 0, 0.0, 50.0)], "point_id long, doc_id string, page int, x double, y double")
    assert {r.point_id: (r.anchor_id, r.distance) for r in match.nearest(points, anchors).collect()} == {1: (2, 40.0), 2: (1, 60.0), 5: (1, 50.0)}
    box = "doc_id string, page int, left double, bottom double, right double, top double"
    a = spark.createDataFrame([("d", 0, 0.0, 0.0, 1.0, 1.0, 1), ("d", 0, 5.0, 5.0, 6.0, 6.0, 2)], box + ", box_id long")
    b = spark.createDataFrame([("d", 0, 1.0, 1.0, 2.0, 2.0, 1, "x"), ("d", 0, -1.0, 0.0, 0.0, 0.0, 2, "y"), ("d", 1, 0.0, 0.0, 9.0, 9.0, 3, "z")], box + ", seq long, url string")
    assert [tuple(r) for r in match.intersecting(a, b).collect()] == [(1, "y")]


def test_paging(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([(1, "10.1/A", "t"), (2, "10.1/a", "u"), (3, None, "T!"), (4, None, "t"), (5, "", ""), (6, None, None)], "i long, doi string, title string")
    keyed = df.withColumn("key", paging.identity_key(F.col("doi"), none, none, F.col("title")))
    assert [r.i for r in paging.dedupe_by_identity(keyed, [], "key", ["i"]).orderBy("i").collect()] == [1, 3]
    shown = spark.createDataFrame([(1, "A b", 1), (2, "A-b", 2), (3, "a b", 1), (4, "", 1), (5, "!", 1)], "i long, text string, n long")
    for numbered, want in ((False, [1, 3, 4, 5]), (True, [1, 2, 3, 4])):
        k = shown.withColumn("key", paging.display_key(F.col("text"), F.col("n"), numbered))
        assert [r.i for r in paging.dedupe_by_display(k, [], "key", ["i"]).orderBy("i").collect()] == want
    item = "array<struct<key:string,ref:long>>"
    pages = spark.createDataFrame(
        [(1, "s2", 0, 4, [("a", 1), ("b", 2)]), (1, "s2", 1, 4, [("b", 3), ("c", 4)]), (1, "s2", 2, 4, [("d", 5)]), (1, "oa", 1, 9, [("z", 9)]), (2, "oa", 0, None, [("a", 1)]), (2, "oa", 1, None, []), (2, "oa", 2, None, [("q", 1)])],
        f"list_id long, source string, page int, total long, items {item}",
    )
    assert sorted((r.list_id, r.key) for r in paging.shown_pages(pages).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
    s = spark.createDataFrame([(5, 9, False), (5, None, False), (5, None, True)], "n long, total long, done boolean")
    assert [r.s for r in s.select(paging.summary(F.col("n"), F.col("total"), F.col("done")).alias("s")).collect()] == ["5 / 9", "5+", "5"]


def test_cascades(spark):
    a = spark.createDataFrame([(1, "openalex", 1), (1, "semanticscholar", 2), (2, "openalex", 3), (3, "other", 4)], "item_id long, source string, ref long")
    assert {(r.item_id, r.ref) for r in cascade.first_answering(a, cascade.REFERENCES).collect()} == {(1, 2), (2, 3)}
    stages = [a.where("source = 'semanticscholar'"), a.where("source = 'openalex'")]
    assert {(r.item_id, r.ref) for r in cascade.staged(stages).collect()} == {(1, 2), (2, 3)}
    s = spark.createDataFrame([(1, "semanticscholar", True, 0), (1, "openalex", True, 0), (2, "semanticscholar", False, 0), (2, "openalex", False, 0), (3, "semanticscholar", True, 0), (3, "openalex", True, 4)], "item_id long, source string, answered boolean, n_items long")
    assert {r.item_id: (r.source, r.n_items, r.outcome) for r in cascade.empty_or_missing(s).collect()} == {1: ("openalex", 0, "empty"), 2: (None, 0, "failed"), 3: ("openalex", 4, "rows")}


def test_cache(spark, tmp_path):
    rows = [({"DOI": "x" * 299, "s2": "y" * 300, "k": None}, [f"a{i}" for i in range(60)] + [None], "file:///x", "http://ok", "", "t", None), ({}, [], None, None, "book", None, ""), ({}, None, None, None, "book", "", "text")]
    df = spark.createDataFrame(rows, "identifiers map<string,string>, authors array<string>, url string, oa_url string, type string, title string, text string").withColumn("abstract", F.lit("x"))
    got = cache.sanitize(df).collect()
    assert len(got) == 2 and set(got[0].identifiers) == {"DOI"} and len(got[0].authors) == 50 and got[0].url is None and got[0].oa_url == "http://ok" and got[0].type == "journalArticle" and "abstract" not in got[0]
    w = spark.createDataFrame([("k1", "API", 5, 1), ("k1", "API", 7, 2), ("k1", "PDF", 1, 3), ("k2", "API", 6, 4)], "item_key string, slot string, t long, v long")
    slots = cache.latest_slots(w)
    assert {(r.item_key, r.slot, r.v) for r in slots.collect()} == {("k1", "API", 2), ("k1", "PDF", 3), ("k2", "API", 4)}
    assert {(r.item_key, r.slot) for r in cache.evict(slots, 1).collect()} == {("k1", "API"), ("k1", "PDF")}
    cache.write_cache(slots, str(tmp_path / "c"))
    assert cache.read_cache(spark, str(tmp_path / "c")).count() == 3 and cache.read_cache(spark, str(tmp_path / "c"), 1).count() == 0
    e = spark.createDataFrame([("a", 0, "x"), ("b", 0, None), ("c", 500_000, None)], "key string, t long, body string")
    assert {r.key for r in cache.fresh(e, F.lit(700_000), 10**9).collect()} == {"a", "c"}


def test_exports(spark):
    df = spark.createDataFrame([(3, 'a "b"', ["A", "B", "C", "D"], "2001", None, "10.1/x")], "n long, title string, authors array<string>, year string, venue string, doi string")
    none = F.lit(None).cast("string")
    got = df.select(
        export.text_line(F.lit(None).cast("long"), F.col("n"), none, F.col("title")).alias("t"), export.markdown_line(F.col("n"), F.col("n"), none, F.col("title"), none, F.col("doi")).alias("m"),
        export.csv_line(F.col("n"), F.col("title"), F.array_join("authors", "; "), F.col("venue")).alias("c"), export.citation(F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("doi")).alias("s"),
    ).first()
    assert tuple(got) == ('[3] a "b"', '3. [a "b"](https://doi.org/10.1/x)', '3,"a ""b""","A; B; C; D",""', 'A, B, C et al. (2001). a "b". https://doi.org/10.1/x')
