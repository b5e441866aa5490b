"""Citation neighbourhoods where works stand in an order: the later works of a group are an origin's references, the
earlier ones its citations, and works of the same kin are related to it. No pair of works is made: the most cited later
works follow from one pass over each group, and edges from one pass over those of its works that are ever among them."""

from __future__ import annotations

from bisect import insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.operators.graph import KINDS, MAX_CITATIONS, MAX_COUPLINGS, MAX_NODES, MAX_RELATED, MIN_SHARED

_ITEM = "struct<work_id:bigint,citation_count:bigint>"
_ITEMS = pa.list_(pa.struct([("work_id", pa.int64()), ("citation_count", pa.int64())]))
_EDGES = pa.list_(pa.struct([("source", pa.int64()), ("target", pa.int64()), ("weight", pa.int64()), ("pos", pa.int32())]))


class _Best:
    """The k most cited works of a group so far, ties by work_id. Works come with falling work_id."""

    def __init__(self, k: int):
        self.k, self.group = k, object()

    def begins(self, group) -> bool:
        if group == self.group:
            return False
        self.group, self.best, self.last, self.before = group, [], None, None
        return True

    def enter(self, work: int, count: int | None) -> bool:
        """Whether the work is among them now. Without a group no work is."""
        if self.group is None:
            return False
        if work == self.before:
            raise ValueError(f"work_id {work} isn't unique")
        self.before, key = work, (-(count or 0), work, count)
        if not self.k or (len(self.best) == self.k and key[:2] > self.best[-1][:2]):
            return False
        insort(self.best, key, key=lambda x: x[:2])
        self.last = work
        return True


def _lists(rows: list[list[tuple]]) -> pa.Array:
    flat = [x for r in rows for x in r]
    items = pa.StructArray.from_arrays([pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], fields=list(_ITEMS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), items)


def _columns(b: pa.RecordBatch, *names: str):
    return zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names))


def _later(k: int, lists: bool):
    """Adds epoch, the last work that entered the list of the k most cited later works (it stands for the list), and,
    if asked for, the list itself, refs."""

    def fold(batches):
        state = _Best(k)
        for b in batches:
            at, seen, epochs, changed = [], [], [], True
            for group, work, count in _columns(b, "group", "work_id", "citation_count"):
                changed |= state.begins(group)
                if changed:
                    seen.append(list(state.best))
                    epochs.append(state.last)
                at.append(len(seen) - 1)
                if changed := state.enter(work, count):
                    del state.best[k:]
            at = pa.array(at, pa.int32())
            b = b.append_column("epoch", pa.array(epochs, pa.int64()).take(at))
            yield b.append_column("refs", _lists(seen).take(at)) if lists else b

    return fold


def _entering(k: int):
    """Only the works that are among the k most cited later works of some origin."""

    def fold(batches):
        state = _Best(k)
        for b in batches:
            there = []
            for group, work, count in _columns(b, "group", "work_id", "citation_count"):
                state.begins(group)
                there.append(state.enter(work, count))
                del state.best[k:]
            yield b.filter(pa.array(there, pa.bool_()))

    return fold


@cache
def _above(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _coupled(k: int, floor: int, min_shared: int, max_couplings: int):
    """(epoch, refs, edges) of the entering works: the list after each, and the coupling edges in it, heaviest first. An
    edge's pos is the length of the shortest beginning of the list that has both ends. Any origin keeps a beginning of
    floor works or more (all, if the list has fewer); edges that aren't among the max_couplings heaviest of any such
    beginning are left out."""

    def edges(best: list[tuple], weights: np.ndarray, slots: dict[int, int]) -> tuple[np.ndarray, ...]:
        n, ids = len(best), np.array([x[1] for x in best], np.int64)
        order = np.array([slots[x[1]] for x in best], np.int64)
        i, j = _above(n)
        w = weights[order[i], order[j]]
        on = w >= max(min_shared, 1)
        i, j, w = i[on], j[on], w[on]
        source, target, pos = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), j + 1
        o = np.lexsort((target, source, -w))
        source, target, w, pos = source[o], target[o], w[o], pos[o]
        if len(w) > max_couplings:
            keep = np.zeros(len(w), bool)
            for m in range(max(0, min(n, floor)), n + 1):
                keep |= (pos <= m) & (np.cumsum(pos <= m) <= max_couplings)
            source, target, w, pos = source[keep], target[keep], w[keep], pos[keep]
        return source, target, w, pos

    def out(epochs: list[int], lists: list[list[tuple]], found: list[tuple]) -> pa.RecordBatch:
        flat = [np.concatenate(x) for x in zip(*found)]
        items = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, _EDGES.value_type)], fields=list(_EDGES.value_type))
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(epochs, pa.int64()), _lists(lists), pa.ListArray.from_arrays(bounds, items)], names=["epoch", "refs", "edges"])

    def fold(batches):
        state, epochs, lists, found = _Best(k), [], [], []
        for b in batches:
            for group, work, count, own in _columns(b, "group", "work_id", "citation_count", "own"):
                if state.begins(group):
                    weights, slots, sets, free = np.zeros((k + 1, k + 1), np.int64), {}, {}, list(range(k + 1))
                if not state.enter(work, count):
                    continue
                mine, at = frozenset(own or ()), free.pop()
                for other, s in slots.items():
                    weights[at, s] = weights[s, at] = len(mine & sets[other])
                slots[work], sets[work] = at, mine
                for x in state.best[k:]:
                    free.append(slots.pop(x[1]))
                    del sets[x[1]]
                del state.best[k:]
                epochs.append(work)
                lists.append(list(state.best))
                found.append(edges(state.best, weights, slots))
                if len(epochs) == 256:
                    yield out(epochs, lists, found)
                    epochs, lists, found = [], [], []
        if epochs:
            yield out(epochs, lists, found)

    return fold


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(works: DataFrame, max_related: int) -> DataFrame:
    """Works by group, each with the first works of its kin."""
    known = F.col("work_id").isNotNull()
    own = works.select("work_id", F.when(known, F.col("group")).alias("group"), F.when(known, F.col("kin")).alias("kin"), F.col("citation_count").cast("long").alias("citation_count"))
    kin = Window.partitionBy("kin").orderBy("work_id")
    own = own.withColumn("_i", F.row_number().over(kin))
    first = F.when((F.col("_i") <= max_related + 1) & F.col("kin").isNotNull(), F.struct("work_id", "citation_count", "group"))
    own = own.withColumn("related", F.collect_list(first).over(kin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return own.select("work_id", "group", "citation_count", "related").repartition(_parts(works), "group")


def _in_order(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("group", F.col("work_id").desc())


def _origins(placed: DataFrame, k: int, max_citations: int, lists: bool) -> DataFrame:
    """Each work as an origin, with its citations, the first of its kin and its epoch."""
    before = Window.partitionBy("group").orderBy(F.col("work_id").desc()).rowsBetween(1, max_citations)
    cites = F.when(F.col("group").isNotNull(), F.collect_list(F.struct("work_id", "citation_count")).over(before)).otherwise(F.array().cast(f"array<{_ITEM}>"))
    df = _in_order(placed.withColumn("cites", cites))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", epoch long" + f", refs array<{_ITEM}>" * lists
    return df.mapInArrow(_later(k, lists), schema).withColumnRenamed("work_id", "origin_id")


def _nodes(max_nodes: int, max_related: int) -> Column:
    """array<struct<neg, prio, ord, work_id, citation_count>> of an origin, the origin first, then by rank.

    A work of the same kin is a reference or a citation already if it is of the same group and no earlier than the last
    citation. A reference beyond the list of the max_nodes - 1 most cited ones can't be a node, in whatever way it is
    there: all of the list would come before it."""

    def node(x: Column, prio: int, ord: Column) -> Column:
        return F.struct((-F.coalesce(x["citation_count"], F.lit(0).cast("long"))).alias("neg"), F.lit(prio).alias("prio"), ord.alias("ord"), x["work_id"].alias("work_id"), x["citation_count"].alias("citation_count"))

    origin, last = F.col("origin_id"), F.col("last")
    related = F.slice(F.filter("related", lambda x: x["work_id"] != origin), 1, max_related)
    related = F.filter(related, lambda x: ~F.coalesce((x["group"] == F.col("group")) & (x["work_id"] >= last), F.lit(False)))
    others = F.concat(
        F.transform(F.coalesce("refs", F.array().cast(f"array<{_ITEM}>")), lambda x: node(x, 1, x["work_id"])),
        F.transform("cites", lambda x: node(x, 2, -x["work_id"])), F.transform(related, lambda x: node(x, 3, x["work_id"])),
    )
    own = F.struct(F.lit(0).cast("long").alias("neg"), F.lit(0).alias("prio"), F.lit(0).cast("long").alias("ord"), origin.alias("work_id"), F.col("citation_count").alias("citation_count"))
    return F.concat(F.array(own), F.slice(F.sort_array(others), 1, max_nodes - 1))


def _with_nodes(df: DataFrame, max_nodes: int, max_related: int, *more: str) -> DataFrame:
    df = df.withColumn("last", F.coalesce(F.try_element_at("cites", F.lit(-1))["work_id"], "origin_id"))
    return df.select("origin_id", _nodes(max_nodes, max_related).alias("nodes"), *more)


def neighbourhoods(works: DataFrame, max_nodes: int = MAX_NODES, max_citations: int = MAX_CITATIONS, max_related: int = MAX_RELATED) -> DataFrame:
    """(origin_id, nodes): a row for each work, its nodes in an array; see nodes().

    works(work_id, group, kin, citation_count), where work_id is unique. What graph.nodes gives for references of all
    later works of the same group with ord = work_id, citations of all earlier ones with ord = -work_id and related works
    of the same kin with ord = work_id, in rows that grow with the works, not with the pairs."""
    placed = _placed(works, max_related)
    return _with_nodes(_origins(placed, max_nodes - 1, max_citations, True).repartition(_parts(works), "origin_id"), max_nodes, max_related)


def nodes(hoods: DataFrame) -> DataFrame:
    """Rows of neighbourhoods: origin_id, work_id, kind, citation_count, rank."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("n.prio") + 1)
    return hoods.select("origin_id", F.posexplode("nodes").alias("_i", "n")).select("origin_id", "n.work_id", kind.alias("kind"), "n.citation_count", (F.col("_i") + 1).alias("rank"))


def edges(works: DataFrame, work_refs: DataFrame, min_shared: int = MIN_SHARED, max_couplings: int = MAX_COUPLINGS, max_nodes: int = MAX_NODES, max_citations: int = MAX_CITATIONS, max_related: int = MAX_RELATED) -> DataFrame:
    """What graph.edges gives for the nodes of all works: origin_id, source, target, weight, kind.

    The references that an origin keeps are a beginning of its list of most cited later works, so the edges are found
    once for each list, and each origin takes those of its beginning."""
    k, placed = max_nodes - 1, _placed(works, max_related)
    slim = placed.select("group", "work_id", "citation_count")
    entering = _in_order(slim).mapInArrow(_entering(k), slim.schema)
    own = work_refs.select("work_id", "ref_id").where("ref_id is not null").join(entering.select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(F.collect_set("ref_id").alias("own"))
    entering = _in_order(entering.join(own, "work_id", "left").repartition(_parts(works), "group"))
    lists = entering.mapInArrow(
        _coupled(k, k - max_citations - max_related, min_shared, max_couplings),
        f"epoch long, refs array<{_ITEM}>, edges array<struct<source:bigint,target:bigint,weight:bigint,pos:int>>",
    )
    df = _origins(placed, k, max_citations, False).join(lists, "epoch", "left")
    df = _with_nodes(df, max_nodes, max_related, "edges")
    df = df.select("origin_id", "nodes", "edges", F.size(F.filter("nodes", lambda x: x["prio"] == 1)).alias("kept"))
    direct = F.transform(F.slice("nodes", 2, max_nodes), lambda x: F.struct(F.col("origin_id").alias("source"), x["work_id"].alias("target"), F.lit(1).cast("long").alias("weight"), F.lit(0).alias("pos")))
    coupled = F.slice(F.filter(F.coalesce("edges", F.array().cast("array<struct<source:bigint,target:bigint,weight:bigint,pos:int>>")), lambda x: x["pos"] <= F.col("kept")), 1, max_couplings)
    rows = df.select("origin_id", F.explode(F.concat(direct, coupled)).alias("e"))
    return rows.select("origin_id", "e.source", "e.target", "e.weight", F.when(F.col("e.pos") == 0, "direct").otherwise("cocite").alias("kind"))
