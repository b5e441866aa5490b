from __future__ import annotations

from pyspark.sql import functions as F

from citespark.operators import items


def test_creators(spark):
    df = spark.createDataFrame([([" Ada  King Byron ", "王小明", "Plato", "", None],)], "a array<string>")
    assert [tuple(c) for c in df.select(items.creators(F.col("a")).alias("c")).first().c] == [("Ada King", "Byron"), ("", "王小明"), ("", "Plato")]


def test_edited(spark):
    schema = "ref_id long, text string, title string, authors array<string>, year string, venue string, doi string, arxiv string, pmid string, url string, lib_item_id long"
    refs = spark.createDataFrame([(1, "t", "Old", ["A"], "1999", "V", "10.1/old", None, None, "u", 7), (2, "t", "Old", ["A"], "1999", "V", None, None, None, "u", 8)], schema)
    edits = spark.createDataFrame([(1, "Smith J. A study of things that happen often. J Stud. 2019; 12: 1. doi:10.1234/x.1")], "ref_id long, text string")
    got = {r.ref_id: r for r in items.edited(refs, edits, 2026).collect()}
    assert (got[1].title, got[1].year, got[1].doi, got[1].lib_item_id, got[1].url) == ("A study of things that happen often", "2019", "10.1234/x.1", None, "https://doi.org/10.1234/x.1")
    assert (got[2].title, got[2].lib_item_id) == ("Old", 8)


def test_luminance(spark):
    df = spark.createDataFrame([("#fff",), ("#000000",), ("red",), ("#12345",)], "c string")
    assert [r.v and round(r.v, 6) for r in df.select(items.luminance(F.col("c")).alias("v")).collect()] == [1.0, 0.0, None, None]
