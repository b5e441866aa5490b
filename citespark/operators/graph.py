"""Citation neighbourhoods: nodes, direct edges, and coupling edges between works that share references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Caps of a neighbourhood.
MAX_NODES, MAX_CITATIONS, MAX_RELATED, MAX_COUPLINGS, MIN_SHARED = 50, 15, 10, 200, 3

KINDS = ("origin", "reference", "citation", "related")


def distinct_references(refs: DataFrame, work: str = "work_id", ref: str = "ref_id") -> DataFrame:
    return refs.select(work, ref).where(F.col(work).isNotNull() & F.col(ref).isNotNull()).distinct()


def coupling_edges(refs: DataFrame, work: str = "work_id", ref: str = "ref_id", min_shared: int = MIN_SHARED, by: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, weight) of works that share min_shared references or more, source < target; with `by`, only
    within rows of equal by columns, which are returned too.

    References that one work alone has can't couple anything; they are dropped before the self join, so that the join
    grows with the shared references only. The join's rows are counted map-side; adaptive execution can split it where a
    reference is very popular."""
    keys = list(by)
    own = refs.select(*keys, F.col(work).alias("w"), F.col(ref).alias("r")).where("w is not null and r is not null").distinct()
    shared = own.groupBy(*keys, "r").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    own = own.join(shared, [*keys, "r"], "left_semi")
    pairs = own.withColumnRenamed("w", "source").join(own.withColumnRenamed("w", "target"), [*keys, "r"]).where("source < target")
    return pairs.groupBy(*keys, "source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_shared)


def coupling_by_sets(refs: DataFrame, pairs: DataFrame, work: str = "work_id", ref: str = "ref_id") -> DataFrame:
    """(source, target, weight) for given pairs of works, by the intersection of their reference sets."""
    sets = refs.groupBy(F.col(work).alias("w")).agg(F.collect_set(ref).alias("s"))
    return (
        pairs.join(sets.select(F.col("w").alias("source"), F.col("s").alias("a")), "source")
        .join(sets.select(F.col("w").alias("target"), F.col("s").alias("b")), "target")
        .select("source", "target", F.size(F.array_intersect("a", "b")).cast("long").alias("weight"))
    )


def top_edges(edges: DataFrame, n: int = MAX_COUPLINGS, by: tuple[str, ...] = ()) -> DataFrame:
    """The n heaviest edges, ties by source and target; with `by`, of each by group."""
    order = (F.col("weight").desc(), "source", "target")
    if not by:
        return edges.orderBy(*order).limit(n)
    return edges.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def citation_counts(refs: DataFrame, work: str = "work_id", ref: str = "ref_id") -> DataFrame:
    """(ref, citation_count): how many works refer to each."""
    return distinct_references(refs, work, ref).groupBy(ref).agg(F.count("*").alias("citation_count"))


def nodes(origins: DataFrame, refs: DataFrame, cites: DataFrame, related: DataFrame, works: DataFrame, max_nodes: int = MAX_NODES, max_citations: int = MAX_CITATIONS, max_related: int = MAX_RELATED) -> DataFrame:
    """Nodes of the neighbourhoods of many origins at once: origin_id, work_id, kind, citation_count, rank.

    origins(origin_id); refs and related(origin_id, work_id, ord); cites(origin_id, work_id, ord); works(work_id,
    citation_count). A work that is there in several ways has the first kind of KINDS. Of the citations and related works
    the first ones by ord are taken; then the origin and the max_nodes - 1 others with most citations stay, ties by kind
    and ord."""

    def limited(df: DataFrame, n: int) -> DataFrame:
        w = Window.partitionBy("origin_id").orderBy("ord", "work_id")
        return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")

    every = origins.select("origin_id", F.col("origin_id").alias("work_id"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("prio"))
    for prio, df in ((1, refs), (2, limited(cites, max_citations)), (3, limited(related, max_related))):
        every = every.unionByName(df.select("origin_id", "work_id", F.col("ord").cast("long").alias("ord"), F.lit(prio).alias("prio")))
    best = every.groupBy("origin_id", "work_id").agg(F.min(F.struct("prio", "ord")).alias("b"))
    best = best.select("origin_id", "work_id", F.col("b.prio").alias("prio"), F.col("b.ord").alias("ord"))
    best = best.join(works.select("work_id", "citation_count"), "work_id", "left")
    order = Window.partitionBy("origin_id").orderBy((F.col("prio") > 0).cast("int"), F.coalesce("citation_count", F.lit(0)).desc(), "prio", "ord", "work_id")
    kinds = F.element_at(F.array(*map(F.lit, KINDS)), F.col("prio") + 1)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_nodes).select("origin_id", "work_id", kinds.alias("kind"), "citation_count", "rank")


def edges(kept: DataFrame, work_refs: DataFrame, min_shared: int = MIN_SHARED, max_couplings: int = MAX_COUPLINGS) -> DataFrame:
    """Edges among kept nodes: origin_id, source, target, weight, kind. A direct edge goes from the origin to each other
    node; cocite edges tie reference nodes that share references."""
    direct = kept.where("kind <> 'origin'").select("origin_id", F.col("origin_id").alias("source"), F.col("work_id").alias("target"), F.lit(1).cast("long").alias("weight"), F.lit("direct").alias("kind"))
    lists = kept.where("kind = 'reference'").select("origin_id", "work_id").join(work_refs.select("work_id", "ref_id").distinct(), "work_id")
    coupled = top_edges(coupling_edges(lists, min_shared=min_shared, by=("origin_id",)), max_couplings, ("origin_id",))
    return direct.unionByName(coupled.withColumn("kind", F.lit("cocite")))


def in_library(kept: DataFrame, library: DataFrame, key: str = "work_id") -> DataFrame:
    """Adds in_library: whether the library has the node."""
    own = library.select(F.col(key).alias("_k")).distinct()
    return kept.join(own, F.col(key) == F.col("_k"), "left").withColumn("in_library", F.col("_k").isNotNull()).drop("_k")


def node_radius(citations: Column, is_origin: Column) -> Column:
    return F.least(4.5 + 2.2 * F.log10(1 + F.coalesce(citations, F.lit(0))), F.lit(13.0)) + F.when(is_origin, 4.0).otherwise(0.0)


def force_parameters(kind: Column, weight: Column) -> Column:
    """struct(distance, strength) of an edge's spring."""
    direct = kind == "direct"
    return F.struct(F.when(direct, 70.0).otherwise(46.0).alias("distance"), F.when(direct, 0.3).otherwise(F.least(F.lit(1.0), weight / 6)).alias("strength"))


def labelled(sized: DataFrame, width: int, by: str = "origin_id") -> DataFrame:
    """The nodes that get a label: by radius, as many as one for every 45 of the width, 4 to 12."""
    n = max(4, min(12, int(width / 45 + 0.5)))
    w = Window.partitionBy(by).orderBy(F.col("radius").desc(), "work_id")
    return sized.withColumn("label_rank", F.row_number().over(w)).where(F.col("label_rank") <= n)


def node_label(author: Column, year: Column, title: Column) -> Column:
    """Surname and year, or the beginning of the title."""
    surname = F.element_at(F.split(F.trim(author), r"\s+"), -1)
    return F.when(F.trim(author) != "", F.concat_ws(" ", surname, year)).otherwise(F.substring(title, 1, 18))


def recentred(origins: DataFrame, chosen: DataFrame) -> DataFrame:
    """Origins with the chosen node (origin_id, work_id) of each as the new origin."""
    return origins.join(chosen, "origin_id").select(F.col("work_id").alias("origin_id")).distinct()
