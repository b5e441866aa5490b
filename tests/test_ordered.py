"""Neighbourhoods without pairs of works, against the general operators over all pairs."""

from __future__ import annotations

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from citespark.operators import graph, ordered

WORKS = "work_id long, group int, kin string, citation_count long"


def brute(works, max_nodes, max_citations, max_related):
    o = works.select(F.col("work_id").alias("origin_id"), F.col("group").alias("g"), F.col("kin").alias("k"))
    pairs = o.join(works, F.col("g") == F.col("group")).where("origin_id <> work_id")
    refs = pairs.where("work_id > origin_id").select("origin_id", "work_id", F.col("work_id").alias("ord"))
    cites = pairs.where("work_id < origin_id").select("origin_id", "work_id", (-F.col("work_id")).alias("ord"))
    related = o.join(works, F.col("k") == F.col("kin")).where("origin_id <> work_id").select("origin_id", "work_id", F.col("work_id").alias("ord"))
    return graph.nodes(o.select("origin_id"), refs, cites, related, works, max_nodes, max_citations, max_related)


def tables(spark, seed: int, n: int, groups: int, kins: int, most: int, suppliers: int):
    r = random.Random(seed)
    ids = r.sample(range(-n, 5 * n), n)
    rows = [(i, r.choice([*range(groups), None]), r.choice([*"abcdefgh"[:kins], None]), r.choice([None, *range(most)])) for i in ids]
    refs = [(i, x) for i in ids for x in r.sample(range(suppliers), r.randint(0, 6))] + [(i, None) for i in ids[:9]] + [(ids[0], 1)] * 3
    return spark.createDataFrame(rows, WORKS), spark.createDataFrame(refs, "work_id long, ref_id long")


@pytest.mark.parametrize("seed,n,groups,kins,most,suppliers,caps,shared,couplings", [(1, 300, 2, 3, 40, 12, (50, 15, 10), 2, 200), (2, 200, 1, 1, 3, 8, (12, 4, 3), 1, 9), (3, 150, 40, 8, 5, 8, (50, 15, 10), 1, 200), (4, 160, 1, 2, 2, 9, (5, 3, 4), 1, 2)])
def test_as_over_all_pairs(spark, seed, n, groups, kins, most, suppliers, caps, shared, couplings):
    works, refs = tables(spark, seed, n, groups, kins, most, suppliers)
    kept = brute(works, *caps).cache()
    got = [tuple(r) for r in ordered.nodes(ordered.neighbourhoods(works, *caps)).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in kept.collect()) and len(got) > n
    want = sorted(tuple(r) for r in graph.edges(kept, refs, shared, couplings).collect())
    assert sorted(tuple(r) for r in ordered.edges(works, refs, shared, couplings, *caps).collect()) == want
    assert any(r[4] == "cocite" for r in want)


@pytest.mark.parametrize("sign", [1, -1])
def test_most_cited_first_or_last(spark, sign):
    """Either every work enters the list of the later ones, or none after the first."""
    works = spark.range(200).selectExpr("id as work_id", "1 as group", "'a' as kin", f"{sign} * id + 200 as citation_count")
    refs = spark.range(200).selectExpr("id as work_id", "explode(sequence(id % 3, id % 3 + 4)) as ref_id")
    kept = brute(works, 50, 15, 10)
    want = sorted(tuple(r) for r in graph.edges(kept, refs, 2).collect())
    assert sorted(tuple(r) for r in ordered.edges(works, refs, 2).collect()) == want
    assert sorted(tuple(r) for r in ordered.nodes(ordered.neighbourhoods(works)).collect()) == sorted(tuple(r) for r in kept.collect())


def test_equal_works_are_refused(spark):
    works = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "a", 1)], WORKS)
    with pytest.raises(Exception, match="isn't unique"):
        ordered.nodes(ordered.neighbourhoods(works)).collect()


def within(spark, seconds: int, f):
    """f(), whose jobs are cancelled after so many seconds."""
    stop = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        return f()
    finally:
        stop.cancel()


@pytest.fixture(scope="module")
def one_size(spark, tmp_path_factory):
    """40,000 parts of one size and brand: over all pairs, 1.6 billion rows each way."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.range(40_000).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "7 as p_size").write.parquet(f"{d}/part.parquet")
    spark.range(40_000).selectExpr("id as o_orderkey", "id % 5000 as o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(120_000).selectExpr("id % 40000 as l_orderkey", "pmod(hash(id), 40000) as l_partkey", "pmod(hash(id, 1), 100) as l_suppkey").selectExpr("l_orderkey", "cast(l_partkey as long) l_partkey", "cast(l_suppkey as long) l_suppkey").write.parquet(f"{d}/lineitem.parquet")
    spark.range(100).selectExpr("id as s_suppkey").write.parquet(f"{d}/supplier.parquet")
    return d


def run_one_size(spark, d, name):
    from citespark.plans import queries

    began = time.time()
    got = within(spark, 90, lambda: queries.QUERIES[name](spark, d).groupBy("origin_id").count().agg(F.count("*"), F.sum("count"), F.max("count")).first())
    assert time.time() - began < 90
    return tuple(got)


#: Of all origins' rows, what must hold for (origins, rows, most rows of an origin). The last 24 origins have few later works.
ONE_SIZE = {
    "graph_edges": lambda o, n, most: o == 40_000 and n > 1_959_700 and 49 < most <= 249,
    "graph_nodes_multi_origin": lambda o, n, most: (o, n, most) == (40_000, 1_999_700, 50),
    "edge_force_params": lambda o, n, most: o == 40_000 and n > 1_959_700 and 49 < most <= 249,
    "graph_in_library": lambda o, n, most: (o, n, most) == (40_000, 1_999_700, 50),
    "graph_nodes": lambda o, n, most: (o, n, most) == (40_000, 800_000, 20),
    "graph_recentre": lambda o, n, most: o >= 1 and 26 * o <= n <= 50 * o,
    "label_top_k": lambda o, n, most: (o, n, most) == (40_000, 320_000, 8),
    "node_radius": lambda o, n, most: (o, n, most) == (40_000, 1_999_700, 50),
}


@pytest.mark.parametrize("name", ONE_SIZE)
def test_one_size(spark, one_size, name):
    got = run_one_size(spark, one_size, name)
    assert ONE_SIZE[name](*got), got
