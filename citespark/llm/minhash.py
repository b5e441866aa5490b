"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

The sketch has `bands * rows` coordinates. In round i every element of a document's shingle set goes to a hashed bin
with a hashed value; a bin keeps the least value of the first round that reaches it. In the rounds after the first
`coordinates` ones the bin is the round's own number, so all coordinates are filled after twice as many rounds at the
latest, whatever the set's size. Two sets agree in a coordinate with probability equal to their similarity, with
concentration as for independent MinHash values, but a document of many shingles needs one or two rounds only.

The number of rows and bands follows from the threshold: `banding` takes the most rows for which so many bands fit into
128 coordinates that two sets just as similar as the threshold share no band with probability below 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.common import batch, distinct_by_text, materialize, mix, runs, shingles, small_batches, tidy, whole_rows, word_hashes, words
from citespark.llm.components import components

#: Coordinates of a sketch at most, and the probability with which a link at the threshold may share no band.
COORDINATES, MISS = 128, 1e-7
#: A bucket of up to so many sets is compared pair by pair. The sets of larger ones are dealt into blocks of about so many
#: sets and shingles, and the blocks that meet in a bucket are compared with each other. Both ways find the same classes.
SMALL, BLOCK, BLOCK_SHINGLES = 24, 96, 400_000
#: Meetings of a block that are dealt together.
TURN = 16
#: Classes of at least so many rows, and of one row in HOT_SHARE, are joined by broadcast; so there are HOT_SHARE at most.
HOT_ROWS, HOT_SHARE = 1000, 10_000

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SKETCH_T = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows) for a similarity: see above. Below 0.13 there is one row a band, and the bands no longer suffice for MISS."""
    best = (COORDINATES, 1)
    for rows in range(1, 65):
        same = min(threshold**rows, 1 - 1e-9)
        bands = math.ceil(math.log(MISS) / math.log1p(-same))
        if bands * rows <= COORDINATES:
            best = (max(bands, 8), rows)
    return best


def sketch(values: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts, coordinates) minima for the sorted distinct shingle hashes of each text; rows of empty sets are zero."""
    n, t = len(bounds) - 1, coordinates
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    open_ = np.ones(n * t, bool)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    live, elements = np.flatnonzero(count), values
    seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(elements ^ seeds[i])
        key = doc * t + ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else doc * t + (i - t)
        new = open_[key]
        key, h = key[new], h[new]
        np.minimum.at(out, key, h)
        open_[key] = False
        left = open_.reshape(n, t)[live].any(1)
        if not left.all():
            live = live[left]
            keep = np.zeros(n, bool)
            keep[live] = True
            keep = keep[doc]
            doc, elements = doc[keep], elements[keep]
    out = out.reshape(n, t)
    out[count == 0] = 0
    return out


def _sets(texts: pa.Array, k: int):
    for at, buf, offsets in runs(texts):
        starts, ends, first = words(buf, offsets)
        values, bounds = shingles(word_hashes(buf, starts, ends), first, k)
        yield at, *distinct_by_text(values, bounds)


def _sketches(k: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at, values, bounds in _sets(texts, k):
                n = len(bounds) - 1
                s = sketch(values, bounds, bands * rows).reshape(n, bands, rows)
                with np.errstate(over="ignore"):
                    h = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        h = mix(h * np.uint64(31) + s[:, :, r])
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x1234567, 0xABCDEF987)]
                    s1, s2 = (x[bounds[1:]] - x[bounds[:-1]] for x in sums)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(h.view(np.int64).ravel()))
                yield batch({"doc_id": ids.slice(at, n), "n_shingles": np.diff(bounds), "s1": s1.view(np.int64), "s2": s2.view(np.int64), "bands": lists}, _SKETCH)

    return run


def _whole_sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for at, values, bounds in _sets(b.column(1), k):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield batch({"rep": b.column(0).slice(at, len(bounds) - 1), "shingles": lists}, schema)

    return run


def forest(sets: list[np.ndarray], percent: int, half: int = 0) -> list[tuple[int, int]]:
    """Pairs of indices whose links hold together what all links of similarity >= percent / 100 hold together. With half,
    the links within sets[:half] and within sets[half:] are taken for granted, and only those between them are returned."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(n), sizes)
    shared = np.zeros((n, n), np.int64)
    width = int(code.max()) + 1
    order = np.argsort(code, kind="stable")
    code, member = code[order], member[order]
    step = max(1, 4_000_000 // n)
    for low in range(0, width, step):
        a, b = np.searchsorted(code, [low, low + step])
        there = np.zeros((n, min(step, width - low)), np.float32)
        there[member[a:b], code[a:b] - low] = 1
        shared += np.rint(there @ there.T).astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None] - shared)
    label, out = list(range(n)), []

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    a, b = np.nonzero(np.triu(linked, 1))
    inside = (a >= half) | (b < half) if half else np.zeros(len(a), bool)
    for known in (True, False):
        for x, y in zip(a[inside == known].tolist(), b[inside == known].tolist()):
            x0, y0 = find(x), find(y)
            if x0 != y0:
                label[max(x0, y0)] = min(x0, y0)
                if not known:
                    out.append((x, y))
    return out


def _blocks(percent: int):
    def run(batches):
        for b in batches:
            a, c = [], []
            for row in zip(*(b.column(i) for i in range(4))):
                left, right, left_sets, right_sets = row
                ids = left.values.to_pylist() + (right.values.to_pylist() if right.is_valid else [])
                sets = [s.values.to_numpy(zero_copy_only=False) for s in left_sets]
                half = len(sets) if right.is_valid else 0
                sets += [s.values.to_numpy(zero_copy_only=False) for s in right_sets] if right.is_valid else []
                for x, y in forest(sets, percent, half):
                    if ids[x] != ids[y]:
                        a.append(ids[x])
                        c.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def _classes(sk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) of all rows, rep the smallest doc_id with the same set; and a sketch for each class."""
    counted = sk.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    least = max(HOT_ROWS, sk.count() // HOT_SHARE)
    counted = materialize(counted, "classes")
    hot = F.broadcast(counted.where(F.col("rows") >= least).select("s1", "s2", F.col("rep").alias("hot")))
    own = sk.drop("bands").join(hot, ["s1", "s2"], "left")
    cold = own.where("hot is null").join(counted.select("s1", "s2", "rep"), ["s1", "s2"], "left")
    columns = ["doc_id", "n_shingles", "s1", "s2", "rep"]
    classed = cold.select(columns).unionByName(own.where("hot is not null").withColumn("rep", F.col("hot")).select(columns))
    first = counted.select("rep", F.col("s1").alias("r1"), F.col("s2").alias("r2"))
    one = sk.join(first, (sk.doc_id == first.rep) & (sk.s1 == first.r1) & (sk.s2 == first.r2))
    return classed, one.dropDuplicates(["doc_id", "s1", "s2"])  # a hot set's rows stay apart


def _in_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, r, s): ids and sets of the members of each block, of placed(block, rep)."""
    got = placed.join(sets, "rep").groupBy("block").agg(F.collect_list("rep").alias("r"), F.collect_list("shingles").alias("s"))
    return materialize(got, "blocks")


def _alone(blocks: DataFrame) -> DataFrame:
    return blocks.select("r", F.lit(None).cast("array<long>").alias("r2"), "s", F.lit(None).cast("array<array<long>>").alias("s2"))


def _meetings(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(r, r2, s, s2): the members and sets of both blocks of pairs(block, block2).

    A block that meets many others is there once for each TURN of them, so that no task gets all of its meetings, and so
    that sets needn't be dealt anew one by one where adaptive execution takes such a block for skew."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = pairs.withColumn("turn", F.floor((F.row_number().over(Window.partitionBy("block2").orderBy("block")) - 1) / TURN))
    second = blocks.select(F.col("block").alias("block2"), F.col("r").alias("r2"), F.col("s").alias("s2"))
    second = turns.select("block2", "turn").distinct().join(second, "block2")
    first = turns.join(blocks, "block").repartition(n, "block2", "turn")
    return first.join(second, ["block2", "turn"]).select("r", "r2", "s", "s2")


def _large_buckets(large: DataFrame, sets: DataFrame, percent: int, links: DataFrame) -> DataFrame:
    """Links that with `links` hold the classes together that large(band, h, rep, n, size) gives candidates for.

    Each set has a home, the largest of its buckets, and a hashed block there; the home's first set is added to each of its
    blocks. Blocks are verified inside, which ties the copies of a hot group to one component. Then sets of the home's
    commonest component are dealt into blocks of their own, and the blocks that meet in a bucket are compared, but not two
    of the same component. So a group of near copies costs as many block pairs as it has blocks, for each block of others."""
    home = large.groupBy("rep").agg(F.max(F.struct("size", "band", "h")).alias("at"), F.max("n").alias("n"))
    home = home.select("rep", "n", F.col("at.band").alias("band"), F.col("at.h").alias("h"))
    parts = home.groupBy("band", "h").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"), F.min("rep").alias("leader"))
    parts = materialize(parts, "homes")
    home = materialize(home.join(parts, ["band", "h"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))), "home")
    block = F.xxhash64("band", "h", "part")
    leaders = parts.select("band", "h", F.col("leader").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    first = _in_blocks(home.select(block.alias("block"), "rep").unionByName(leaders.select(block.alias("block"), "rep")).distinct(), sets)
    inside = materialize(_alone(first).mapInArrow(tidy(_blocks(percent)), "a long, b long"), "links")
    links = links.unionByName(inside)

    label = components(links)
    named = home.join(label, home.rep == label.vertex, "left").withColumn("c", F.coalesce("component", "rep")).select("rep", "band", "h", "part", "c")
    most = named.groupBy("band", "h", "c").agg(F.count("*").alias("k")).groupBy("band", "h").agg(F.max_by("c", F.struct("k", "c")).alias("most"))
    own = named.join(most, ["band", "h"]).withColumn("pure", F.when(F.col("c") == F.col("most"), F.col("c")))
    placed = materialize(own.select("rep", "pure", F.xxhash64("band", "h", "part", "pure").alias("block")), "placed")
    blocks = _in_blocks(placed.select("block", "rep"), sets)
    met = large.select("band", "h", "rep").join(placed, "rep").groupBy("band", "h", "block", "pure").agg(F.count("*").alias("k"))
    met = materialize(met, "met")
    most = met.where("pure is not null").groupBy("band", "h", "pure").agg(F.sum("k").alias("k")).groupBy("band", "h").agg(F.max_by("pure", F.struct("k", "pure")).alias("most"))
    other = met.join(most, ["band", "h"], "left").where(~F.col("pure").eqNullSafe(F.col("most")) | F.col("most").isNull())
    pairs = other.select("band", "h", "block", "pure").join(met.select("band", "h", F.col("block").alias("block2"), F.col("pure").alias("pure2")), ["band", "h"])
    pairs = pairs.where("block <> block2 and (pure is null or pure2 is null or pure <> pure2)")
    pairs = pairs.select(F.least("block", "block2").alias("block"), F.greatest("block", "block2").alias("block2")).distinct()
    two = _meetings(pairs, blocks)
    mixed = placed.where("pure is null").select("block").distinct()
    one = _alone(blocks.join(mixed, "block", "left_semi"))
    between = one.unionByName(two).mapInArrow(tidy(_blocks(percent)), "a long, b long")
    return label.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(between)


@small_batches
def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    A document is the set of its distinct runs of `shingle` words (white-space separated, A-Z lower-cased); one of fewer
    words is the whole sequence as one. Documents of Jaccard similarity >= threshold are linked; component_id is the
    smallest doc_id that links reach, and kept says whether it is the document's own. Null, empty and blank texts have
    no shingles and are linked with nothing. Rows with one doc_id are one document, which has the links of all its texts.
    A null doc_id gives a null component_id and is kept. An empty table gives an empty result.

    Equal sets are one class from the start. Classes that share a band are candidates, and each candidate pair is either
    verified on both full sets or known to be of one component already, so that the only links that can be lost are those
    whose sets share no band (see banding). In buckets of up to SMALL classes the pairs are joined with both sets; the
    classes of larger buckets are compared in blocks, by matrix products that emit no more links than hold them together.
    Only the at most HOT_SHARE hottest classes are broadcast; nothing is collected."""
    percent = round(threshold * 100)
    if bands is None or rows is None:
        bands, rows = banding(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = materialize(docs.mapInArrow(tidy(_sketches(shingle, bands, rows)), _SKETCH_T), "sketches")
    classed, classes = _classes(sk)
    again = materialize(sk.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("rows > 1"), "again")
    spread = classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(spread.join(buckets, ["band", "h"]), "buckets")

    small = members.where(F.col("size") <= SMALL)
    x, y = (small.select("band", "h", F.col("rep").alias(r), F.col("n").alias(m)) for r, m in (("a", "na"), ("b", "nb")))
    pairs = x.join(y, ["band", "h"]).where(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    large = members.where(F.col("size") > SMALL)
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(large.select("rep")).distinct()
    sets = docs.join(needed, "doc_id", "left_semi").mapInArrow(tidy(_whole_sets(shingle)), "rep long, shingles array<long>")
    repeated = not again.isEmpty()
    sets = materialize(sets.distinct() if repeated else sets, "sets")

    links = (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .where(f"100 * both >= {percent} * (size(sa) + size(sb) - both)")
        .select("a", "b")
    )
    if repeated:  # a document of several texts ties their classes together
        several = again.where("x <> y").select("doc_id")
        links = links.unionByName(classed.where("rep is not null").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    if not large.isEmpty():
        links = _large_buckets(large, sets, percent, materialize(links, "links"))

    found = components(links)
    node = F.coalesce("rep", "doc_id")
    out = classed.withColumn("node", node).join(found, F.col("node") == found.vertex, "left")
    component = F.coalesce("component", "node")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. Of rows with one doc_id that of the least text
    stays, null before all; rows with a null doc_id stay."""
    kept = near_duplicates(docs, shingle, threshold).where("kept and doc_id is not null").select(F.col("doc_id").alias("_other")).distinct()
    kept = materialize(kept, "kept")
    rows = whole_rows(docs)
    text = F.col("row.text").cast("string")
    own = rows.join(kept, F.col("id") == F.col("_other"), "left_semi").groupBy("id").agg(F.min_by("row", F.struct(text.isNotNull(), text)).alias("row"))
    return own.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")
