from __future__ import annotations

from compare import rows

from citespark.llm.linededup import clean_lines, line_report
from citespark.llm.queries import ORACLE_SQL, QUERIES


def test_query_matches_sql(spark, data, duck):
    got = QUERIES["op4_line_dedup"](spark, data).toPandas()
    assert rows(got) == rows(duck.sql(ORACLE_SQL["op4_line_dedup"]).df())
    assert got.n_removed.sum() > 0


def test_threshold_first_document_and_spaces(spark):
    docs = [(10 + s, f"own {s}\n  shared line \n\nnear miss {s % 4}", f"site{s}") for s in range(12)]
    docs += [(3, "shared line\nshared line\nlast", "site0"), (99, "shared line", None), (None, "shared line\nx", "site1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_report(df, 5).collect()}
    assert got[3] == (3, 0, "shared line\nshared line\nlast")
    assert got[10] == (4, 1, "own 0\n\nnear miss 0")
    assert got[99] == (1, 1, "") and got[None] == (2, 1, "x")
    many = {r.doc_id: r.n_removed for r in line_report(df, 3).collect()}
    assert many[10] == 1 and many[14] == 2  # "near miss 0" has three sites


def test_awkward_rows(spark, awkward, no_docs):
    out = clean_lines(awkward, 1)
    assert out.columns == awkward.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, out.collect())) and out.count() == awkward.count()
    got = {r.doc_id: r for r in line_report(awkward, 2).collect()}
    assert got[2].n_lines == 0 and got[2].text is None and got[3].n_lines == 1 and got[3].text == ""
    assert line_report(no_docs).count() == clean_lines(no_docs).count() == 0


def test_native_plan(spark, data):
    plan = QUERIES["op4_line_dedup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "approx_count_distinct" in plan
