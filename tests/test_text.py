from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citespark.functions import text as tx


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "number"),
    [("12. Foo", 12), ("[12] Foo", 12), ("1 . Sung H", 1), ("10.1016/x", 0), ("2019 Foo", 0), ("41 , 1103", 0), ("12 Foo", 12), ("(3) Foo", 3), ("12 “Foo", 12), ("12", 0), (None, 0)],
)
def test_list_number(spark, text, number):
    assert one(spark, tx.list_number, text) == number


@pytest.mark.parametrize(
    ("text", "kind"),
    [("(1) A", 0), ("[10] Polygon", 1), ("［1］ 王", 2), ("1. Polygon", 3), ("1) Polygon", 4), ("[RCK + 20] X", 5), ("1 Polygon", 4), ("Smith et al", 7), ("a, b, c, d", 7), ("lower case", -1), ("[ 12 ] Foo", 1)],
)
def test_entry_class(spark, text, kind):
    assert one(spark, tx.entry_class, text) == kind


@pytest.mark.parametrize(("text", "yes"), [("References", True), ("R e f e r e n c e s", True), ("参考文献", True), ("References (160–200)", False), ("Reference list of this long work", False), ("", False), (None, False)])
def test_heading(spark, text, yes):
    assert one(spark, tx.is_heading, text) is yes


def test_identifiers(spark):
    assert one(spark, tx.doi, "doi: 10.1000/ab c.") == "10.1000/abc"
    assert one(spark, lambda c: tx.doi(c, strict=True), "doi: 10.1000/abc words") == "10.1000/abc"
    assert one(spark, tx.doi, "see 10.1000/ab\xa0c).") == "10.1000/abc)"
    assert one(spark, tx.arxiv, "arXiv: 2101.01234v2") == "2101.01234v2" and one(spark, tx.arxiv, "ARXIV.hep-th/9901001") == "hep-th/9901001"
    assert one(spark, tx.pmid, "PMID: 12345678") == "12345678" and one(spark, tx.pmid, "PMID: 12345") is None
    assert one(spark, tx.is_doi, "10.1000/abc") and not one(spark, tx.is_doi, "10.1000/cnki.1") and not one(spark, tx.is_doi, None) and not one(spark, tx.is_doi, "")
    assert one(spark, tx.is_http_url, "HTTPS://x.org/a") and not one(spark, tx.is_http_url, "http://x.org/a\n") and not one(spark, tx.is_http_url, "file:///x")
    h = one(spark, tx.host_identifiers, " ", "https://arxiv.org/pdf/2101.00001.pdf", "a: b\nDOI: 10.1/x\nPMID: 77")
    assert tuple(h) == ("10.1/x", "2101.00001", "77")


def test_titles(spark):
    assert one(spark, tx.normalize_title, "Café: A–B 2") == "cafab2" and one(spark, tx.normalize_title, None) == ""
    assert one(spark, tx.clean_text, "<i>ALK</i> -Positive") == "ALK-Positive"
    assert one(spark, tx.clean_text, "a &amp;amp; b ( x ) , y") == "a &amp; b (x), y" and one(spark, tx.clean_text, "plain , text") == "plain , text"
    assert one(spark, tx.is_chinese, "中文ab") is False and one(spark, tx.is_chinese, "中文字ab") is True and one(spark, tx.is_chinese, "") is False
    assert one(spark, tx.collapse, "x" * 36) == "x" * 35 + "…" and one(spark, tx.collapse, "中" * 16) == "中" * 15 + "…"
    assert one(spark, tx.joined_lines, "Poly-", "gon") == "Polygon" and one(spark, tx.joined_lines, "foo", "bar") == "foo bar"
    assert one(spark, tx.without_list_number, "[3]  Foo") == "Foo" and one(spark, tx.without_page_number, "Page 12 of 20") == "Pageof" and one(spark, tx.without_page_number, "IV") == ""
    assert one(spark, tx.encode_component, "a b/c+(d)~é") == "a%20b%2Fc%2B(d)~%C3%A9"
    assert tuple(one(spark, tx.cnki_url, "x?FileName=F1&DbName=CJFD2015")) == ("F1", "CJFD2015", "CJFD") and one(spark, tx.cnki_url, "x?filename=F1") is None


@pytest.mark.parametrize(("content", "words", "yes"), [("[1] Foo bar", "foo，BAR", True), ("[1] Foo", "foo，bar", False), ("x", "", True), ("x", None, True), (None, "a", False)])
def test_keyword_filter(spark, content, words, yes):
    assert one(spark, tx.keyword_match, content, words) is yes


@pytest.mark.parametrize(
    ("text", "title", "authors", "year", "venue"),
    [
        ("Smith J. A study of things that happen often. Journal of Studies. 2019; 12: 1-9.", "A study of things that happen often", ["Smith J."], "2019", "Journal of Studies."),
        ("[3] Foo B, Bar C. “Quoted title of a work,” Proc. of Things, 1998 pp", "Quoted title of a work", ["Foo B, Bar C."], "1998", "Proc. of Things"),
        ("no parts", "no parts", [], None, None),
        ("Lee K et al. with others. The long winding title of a good paper. Nature 1599, 5. x 9999 y 2020 z.", "The long winding title of a good paper", ["Lee K et al."], "2020", "Nature"),
        ("A b. One two three four five [J]. V 2019", "One two three four five", ["A b."], None, "V"),
        ("", "", [], None, None),
    ],
)
def test_parse_reference(spark, text, title, authors, year, venue):
    p = one(spark, lambda c: tx.parse_reference(c, 2026), text)
    assert (p.title, p.authors, p.year, p.venue) == (title, authors, year, venue)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalising_twice_changes_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.normalize_title("t").alias("a"))
    assert df.where(F.col("a") != tx.normalize_title("a")).count() == 0
