from __future__ import annotations

import corpus_pipeline as P

from citespark.llm.decontam import contamination
from citespark.llm.linededup import line_report
from citespark.llm.minhash import near_duplicates
from citespark.llm.quality import judged


def test_stages_take_effect(spark, data, documents):
    """Every stage against what its operator says of the rows that it got, row by row in plain Python."""
    docs = documents
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == documents.columns
        rows = {r.doc_id: r for r in docs.collect()}
        out = {r.doc_id: r for r in got.collect()}
        if name == "quality rules":
            assert set(out) == {r.doc_id for r in judged(docs).collect() if r.kept}
        elif name == "line dedup":
            said = {r.doc_id: r for r in line_report(docs).collect()}
            assert {i: r.text for i, r in out.items()} == {i: r.text for i, r in said.items()}
            assert all(r.n_chars == len(r.text) for r in out.values() if said[r.doc_id].n_removed)
        elif name == "minhash near-dedup":
            said = near_duplicates(docs).collect()
            assert set(out) == {r.doc_id for r in said if r.kept} and len(out) == len({r.component_id for r in said})
        else:
            bad = {r.doc_id for r in contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet"), 10).collect() if r.contaminated}
            assert bad and set(out) == set(rows) - bad
        docs = spark.createDataFrame(got.toPandas(), documents.schema)
    final = P.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in docs.collect()}
    whole = P.run(spark, data).collect()
    total = lambda rows: {(r.doc_id, r.doc_tokens) for r in rows}
    assert total(whole) == total(final)


def test_empty_table(spark, tmp_path, documents):
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
