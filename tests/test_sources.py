from __future__ import annotations

from citespark.sources import records as r
from citespark.sources import samples as s


def test_records(spark):
    got = {x.source: x for x in s.records(spark).collect()}
    assert len(got) == 9
    c = got["crossref"]
    assert (c.doi, c.title, c.authors, c.year, c.publish_date, c.venue, c.abstract, c.citation_count, c.type, c.tags) == ("10.1000/a1", "Growth of things & more", ["Ng", "Big Group"], "2020", "2020-1-5", "J. Growth", "One. Two.", 7, "preprint", ["7"])
    o = got["openalex"]
    assert (o.openalex, o.doi, o.pmid, o.authors, o.abstract, o.url, o.oa_url, o.type, o.retracted, o.tags) == ("W1", "10.1000/a1", "123456", ["A Ng"], "Growth of things Growth", "https://doi.org/10.1000/a1", "https://x.org/a.pdf", "thesis", True, [])
    p = got["semanticscholar"]
    assert (p.s2, p.arxiv, p.type, p.url, p.reference_count) == ("p1", "2101.00001", "preprint", "https://arxiv.org/abs/2101.00001", 2)
    a = got["arxiv"]
    assert (a.title, a.abstract, a.authors, a.year, a.venue, a.doi, a.tags) == ("Nets  for all", "We build  nets.", ["B Li", "C Wu"], "2021", "12 pages", "10.1/n", ["cs.LG", "stat.ML"])
    m = got["pubmed"]
    assert (m.pmid, m.doi, m.year, m.retracted, m.abstract) == ("123456", "10.1000/a1", "2020", True, "1. J Growth. 2020.\n\nGrowth is good.")
    u = got["unpaywall"]
    assert (u.authors, u.oa_url, u.type, u.tags) == (["A Ng", "Li"], "https://x.org/c", "bookSection", ["OA"])
    assert (got["readpaper"].title, got["readpaper"].authors, got["readpaper"].tags) == ("Growth", ["A & B"], ["Q1", "4"])
    assert (got["connectedpapers"].authors, got["connectedpapers"].tags) == (["A Ng"], ["0", "5"])
    k = got["cnki"]
    assert (k.title, k.authors, k.year, k.cnki, k.tags) == ("一种新的方法", ["王小明", "李雷"], "2015", "https://kns.cnki.net/kcms/a?filename=F1&dbname=CJFD2015", ["12"])


def test_crossref_references(spark):
    got = sorted(r.crossref_references(s.answers(spark, ("a", s.CROSSREF))).collect(), key=lambda x: x.number)
    assert [x.text for x in got[1:]] == ["Lee et al., 2011, On lines, Geo, 3, 9", "1999, Lectures", "doi:10.9/z", "k5", "[6]"]
    assert (got[0].title, got[0].doi, got[0].year, got[0].authors) == ("A study of things that happen often", "10.1234/x.1", "2019", ["Smith J."])
    assert got[3].url == "https://doi.org/10.9/z" and got[1].authors == ["Lee"]


def test_lists_and_hits(spark):
    lists = {(x.kind, x.pos, x.ref_id) for x in r.openalex_lists(s.answers(spark, ("W1", s.OPENALEX))).collect()}
    assert lists == {("reference", 0, "W2"), ("reference", 1, "W9"), ("related", 0, "W3")}
    e = sorted(r.s2_edges(s.answers(spark, ("p", s.S2_EDGES))).collect(), key=lambda x: x.number)
    assert [(x.key, x.number, x.title, x.description) for x in e] == [("p", 1, "One", "background: as in"), ("p", 2, "Two", None)]
    hits = spark.createDataFrame([("q", "A Title", 0, "Another", "journal-article"), ("q", "A Title", 1, "a title!", "journal-article"), ("q", "A Title", 2, "A Title", "dataset"), ("z", "x", 0, "y", "component"), ("z", "x", 1, "w", None)], "key string, query string, pos int, title string, type string")
    assert {(x.key, x.pos) for x in r.best_title_hit(hits).collect()} == {("q", 1), ("z", 1)}
    med = spark.createDataFrame([("q", 0, "Correction: x"), ("q", 1, "X"), ("z", 0, "Retracted: y"), ("z", 3, "Y")], "key string, pos int, title string")
    assert [(x.key, x.pos) for x in r.pubmed_title_hit(med).collect()] == [("q", 1)]


def test_cnki(spark):
    rows = r.cnki_page(r.cnki_rows(s.answers(spark, ("q", s.CNKI), ("none", "<p>nothing")))).collect()
    assert [(x.key, x.file_name, x.db_code, x.export_id, x.citation) for x in rows] == [("q", "F1", "CJFD", "E1", "12")]
    b = spark.createDataFrame([("k", 0, "[1]王. 新方法[J]. 2015"), ("k", 1, "[2]unknown"), ("j", 0, "新方法")], "key string, pos int, title string")
    f = spark.createDataFrame([("k", 0, "方法", "F0", "T", "D_x"), ("k", 1, "新方法", "F1", "T", "D_x")], "key string, pos int, title string, file string, table string, db string")
    got = {(x.key, x.number): (x.title, x.url) for x in r.cnki_references(b, f).collect()}
    assert got == {("k", 1): ("方法", "https://kns.cnki.net/kcms/detail/detail.aspx?FileName=F0&DbName=T&DbCode=D"), ("k", 2): ("unknown", None), ("j", 1): ("新方法", None)}


def test_html_to_text(spark):
    df = spark.createDataFrame([("<p>a &eacute; <b>b</b>\n\nc</p>",), (None,), ("",)], "h string")
    assert [x.t for x in df.select(r.html_to_text("h").alias("t")).collect()] == ["a é b c", None, ""]
