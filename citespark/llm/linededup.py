"""Lines that many sites share, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import whole_rows

#: Relative error of the sketches: 64 registers in seven longs.
ERROR = 0.15
SITES = 5


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(line, first): hash of each line that `sites` distinct sources or more have, and the smallest doc_id with it.

    A HyperLogLog sketch of the sources is aggregated for each line, with the least and the greatest hash of a source, which
    are equal where there is one source only. Of lines of several sources the distinct ones are counted exactly where the
    estimate is up to twice the threshold; a larger one is decided as it is, since `sites - 1` sources fill no more registers
    than that, which can't give it."""
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "")
    lines = lines.select("doc_id", "source", line_hash(F.col("l")).alias("line"))
    site = F.xxhash64("source")
    site = F.when(F.col("source").isNotNull(), site)
    spread = lines.groupBy("line").agg(F.approx_count_distinct("source", ERROR).alias("n"), F.min("doc_id").alias("first"), F.min(site).alias("low"), F.max(site).alias("high"))
    spread = spread.where("low <> high" if sites > 1 else "low is not null").select("line", "n", "first")
    near = spread.where(F.col("n") <= 2 * sites)
    pairs = lines.select("line", "source").where("source is not null").distinct()  # before the join, which a hot line would skew
    exact = pairs.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact"))
    return (
        spread.join(exact, "line", "left")
        .where(F.when(F.col("n") <= 2 * sites, F.col("exact") >= sites).otherwise(F.lit(True)))
        .select("line", "first")
    )


def _cleaned(docs: DataFrame, sites: int) -> DataFrame:
    """(row, id, text, n_lines, n_removed): the rows as they are, and their texts without shared lines."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    shared = boilerplate(own, sites)
    sub = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id stay apart
    lines = own.select("doc_id", sub.alias("sub"), F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "").select("doc_id", "sub", line_hash(F.col("l")).alias("line"))
    gone = (
        lines.join(shared, "line")
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("sub").alias("_sub"))
        .agg(F.collect_set("line").alias("gone"))
    )
    rows = whole_rows(docs).withColumn("sub", F.when(F.col("id").isNull(), F.xxhash64(F.col("row.text").cast("string"))))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & F.col("sub").eqNullSafe(F.col("_sub")), "left").drop("_id", "_sub", "sub")
    out = out.withColumn("text", F.col("row.text").cast("string")).withColumn("lines", F.split("text", "\n"))
    kept = F.filter("lines", lambda l: (F.trim(l) == "") | ~F.array_contains("gone", line_hash(l)))
    out = out.withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long"))
    return out.select(
        "row",
        "id",
        F.when(F.col("gone").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"),
        "n_lines",
        F.when(F.col("gone").isNotNull(), F.col("n_lines") - F.size("kept")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )


def line_report(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Per row of docs (doc_id, text, source; other columns are ignored): doc_id, n_lines, n_removed, and text without the
    lines that `sites` distinct sources or more share.

    Lines are split at \\n and compared without outer spaces; blank ones stay. The document of the smallest doc_id keeps
    a shared line, so that one copy of each remains. A null source is no site. Null texts stay null with no lines; an
    empty text is one blank line. Rows with one doc_id count as one document, null doc_ids as one too, after all others.
    An empty table gives an empty result. The hot lines are aggregated map-side, and the join that finds their rows can
    be split by adaptive execution."""
    return _cleaned(docs, sites).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "text")


def clean_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with all its columns, text as line_report has it, and n_chars, if docs has it, anew where lines went."""
    out = _cleaned(docs, sites)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")
