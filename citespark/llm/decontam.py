"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the least 4-gram hashes of all runs of seven consecutive 4-grams, that is of all runs of ten
words. Two texts that share ten words in a row share that run's fingerprint, so no shared window is missed; a run of
ten words shares one in four hashes or so with its neighbours, so that far fewer values than words are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import let
from citespark.llm.common import ascii_lower, materialize, rows_of

WINDOW, GRAM = 10, 4
#: Words of the shortest benchmark item that takes documents out of the pipeline.
LEAST_WORDS = 3
#: Fingerprints of the benchmark up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """The words as they are written; only their hashes are of lower case, which spares a pass over the whole text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _NOT_WORD), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(ascii_lower(x)))


def _two(left: str, right: str, shift: int, less: int, how) -> Column:
    """how(left[i], right[i + shift]) for the first n - less places, n words."""
    n = F.greatest(F.col("_n") - less, F.lit(0))
    return F.zip_with(F.slice(F.col(left), F.lit(1), n), F.slice(F.col(right), F.lit(1 + shift), n), how)


def with_windows(df: DataFrame, full: bool) -> DataFrame:
    """Adds _m, the least 4-gram hash of each run of ten words of _h, and with full also _g, the run's own hash."""
    df = df.withColumn("_n", F.size("_h"))
    df = df.withColumn("_p2", _two("_h", "_h", 1, 1, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_p4", _two("_p2", "_p2", 2, 3, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_m2", _two("_p4", "_p4", 1, 4, lambda a, b: F.least(a, b)))
    df = df.withColumn("_m4", _two("_m2", "_m2", 2, 6, lambda a, b: F.least(a, b)))
    df = df.withColumn("_m", _two("_m4", "_m4", 3, 9, lambda a, b: F.least(a, b)))
    if full:
        df = df.withColumn("_p8", _two("_p4", "_p4", 4, 7, lambda a, b: F.xxhash64(a, b))).withColumn("_g", _two("_p8", "_p2", 8, 9, lambda a, b: F.xxhash64(a, b)))
    return df.drop("_p2", "_p4", "_p8", "_m2", "_m4")


def _short(length: int) -> Column:
    """Hashes of all runs of so many words, fewer than ten."""
    n = F.size("_h") - (length - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("_h", i, F.lit(length))))).otherwise(F.array().cast("array<bigint>"))


def _places(own: Column, grams: Column, k: int) -> Column:
    """(at, k, g) of the runs of k words that are among own. The wanted hashes are bound once for all places; as a column of
    their own they would be put into the inner function by the optimizer, and be computed anew for each place."""
    length = F.lit(k)
    wanted = F.transform(F.filter(own, lambda s: s["k"] == length), lambda s: s["g"])
    place = lambda w: lambda h, i: F.when(F.array_contains(w, h), F.struct(i.alias("at"), length.alias("k"), h.alias("g")))
    return let(wanted, lambda w: F.filter(F.transform(grams, place(w)), lambda s: s.isNotNull()))


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_words, n_hit, items (the item_ids found, as
    sorted distinct strings), contaminated.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Each run of ten words
    of an item is a window; an item of fewer words, but of min_words at least, is one window as a whole. A word inside an
    occurrence of a window is hit. Null and empty texts have no words and no hits; a null item_id is not listed, but its
    words count; repeated items and rows count as they stand; with no items nothing is hit. Equal 64-bit hashes of words
    and runs count as equal ones.

    The documents' fingerprints are joined with the benchmark's (broadcast only below BROADCAST_ROWS); those that share
    one get the windows of the items concerned, and the hits are extended to whole windows on the full text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_t", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_hashes(word_array(F.col("text").cast("string"))).alias("_h"))
    items = items.where(F.size("_h") >= max(1, min_words)).withColumn("k", F.least(F.size("_h"), F.lit(WINDOW)))
    whole = with_windows(items.where(F.col("k") == WINDOW), True).select("item", "k", F.array_distinct("_m").alias("f"), F.array_distinct("_g").alias("g"))
    few = items.where(F.col("k") < WINDOW).select("item", "k", F.array(F.xxhash64("_h")).alias("f"), F.array(F.xxhash64("_h")).alias("g"))
    table = materialize(whole.unionByName(few), "items")
    lengths = sorted(r.k for r in table.where(f"k < {WINDOW}").select("k").distinct().collect())  # nine at most

    prints = table.select("item", "k", F.explode("f").alias("f")).groupBy("k", "f").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nameless"))
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    worded = docs.select("_id", "_t", word_hashes(word_array(F.col("text"))).alias("_h"))
    own = with_windows(worded, False).select("_id", "_t", F.lit(WINDOW).alias("k"), F.explode(F.array_distinct("_m")).alias("f"))
    for k in lengths:
        own = own.unionByName(worded.select("_id", "_t", F.lit(k).alias("k"), F.explode(F.array_distinct(_short(k))).alias("f")))
    found = own.join(prints, ["k", "f"]).groupBy("_id", "_t").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("nameless").alias("nameless"))
    one = table.groupBy("item").agg(F.flatten(F.collect_list(F.transform("g", lambda g: F.struct(F.col("k").alias("k"), g.alias("g"))))).alias("g"))
    names = found.select("_id", "_t", F.explode(F.concat("items", F.when(F.col("nameless"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))).alias("item"))
    windows = (
        names.join(one.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item")))
        .groupBy("_id", "_t")
        .agg(F.collect_list(F.struct("item", "g")).alias("_items"))
    )

    out = docs.join(windows, ["_id", "_t"], "left").select("doc_id", "_items", word_array(F.col("text")).alias("_all"))
    out = out.withColumn("_h", F.when(F.col("_items").isNotNull(), word_hashes(F.col("_all"))))
    out = with_windows(out.withColumn("_n_words", F.size("_all").cast("long")), True)
    out = out.withColumn("_own", F.array_distinct(F.flatten(F.transform("_items", lambda t: t["g"]))))
    lists = [(WINDOW, F.col("_g"))] + [(k, _short(k)) for k in lengths]
    hits = let(F.col("_own"), lambda own: F.concat(*(_places(own, grams, k) for k, grams in lists)))
    out = out.withColumn("_hits", F.when(F.col("_items").isNotNull(), F.array_sort(hits)))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "_hits",
        zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["k"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["k"] - F.greatest(a["end"], s["at"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )
    seen = F.array_distinct(F.transform("_hits", lambda s: F.struct(s["k"].alias("k"), s["g"].alias("g"))))
    found_in = lambda seen: F.filter("_items", lambda t: t["item"].isNotNull() & F.arrays_overlap(t["g"], seen))
    named = F.transform(let(seen, found_in), lambda t: t["item"])
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(named), F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs, with all their columns: no run of ten words, and of
    items of fewer words not the whole item. Items of fewer than LEAST_WORDS words don't count here, since one or two words
    occur in clean documents too. Rows with one doc_id go together."""
    found = contamination(docs, benchmark, LEAST_WORDS).where("contaminated").select("doc_id").distinct()
    return rows_of(docs, found, "left_anti")
