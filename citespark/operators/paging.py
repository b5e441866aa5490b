"""Pages of references: duplicates out, first page by first page, with what is known of the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions.text import missing, normalize_title
from citespark.operators.match import keep_first


def identity_key(doi: Column, s2: Column, openalex: Column, title: Column) -> Column:
    """What tells two listed works apart: the DOI in lower case, else another identifier, else the normalised title; null
    for none."""
    return F.coalesce(F.lower(missing(doi)), missing(s2), missing(openalex), missing(normalize_title(title)))


def display_key(text: Column, number: Column, numbered: bool) -> Column:
    """What tells two shown rows apart: ASCII letters, digits and Han characters as shown; with numbers in front where
    those are shown, so that equal texts of different numbers are both kept."""
    shown = F.concat(F.lit("["), number.cast("string"), F.lit("] "), text) if numbered else text
    return F.regexp_replace(shown, "[^0-9A-Za-z一-龥]", "")


def dedupe_by_identity(rows: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """First row of each key within by; rows without a key are dropped."""
    return keep_first(rows.where(F.col(key).isNotNull()), [*by, key], order)


def dedupe_by_display(rows: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """First row of each key within by; rows with an empty key are all kept."""
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    return keep_first(rows.where(~empty), [*by, key], order).unionByName(rows.where(empty))


def page(rows: DataFrame, offset: int, limit: int, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """Rows offset to offset + limit, of each by group or of all."""
    if not by:
        return rows.orderBy(*order).offset(offset).limit(limit)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).where((F.col("_i") > offset) & (F.col("_i") <= offset + limit)).drop("_i")


def shown_pages(pages: DataFrame) -> DataFrame:
    """From pages(list_id, source, page, total, items array<struct<ord, key, ...>>) the rows that paging shows: the first
    page's source only; pages until one is empty or the rows so far, duplicates counted, reach the total; each key once."""
    first = pages.groupBy("list_id").agg(F.min_by("source", F.struct("page", "source")).alias("source"))
    own = pages.join(first, ["list_id", "source"])
    w = Window.partitionBy("list_id").orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_seen", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0))).withColumn("_ended", F.coalesce(F.max((F.size("items") == 0).cast("int")).over(before), F.lit(0)))
    own = own.withColumn("_total", F.max("total").over(before))
    own = own.where((F.col("_ended") == 0) & (F.col("_total").isNull() | (F.col("_seen") < F.col("_total"))))
    rows = own.select("list_id", "source", "page", F.posexplode("items").alias("pos", "item")).select("list_id", "source", "page", "pos", "item.*")
    return dedupe_by_identity(rows, ["list_id"], "key", ["page", "pos"])


def summary(shown: Column, total: Column, exhausted: Column) -> Column:
    """`shown / total`, or `shown+` while the total is unknown and there may be more."""
    return F.when(total.isNotNull(), F.concat(shown.cast("string"), F.lit(" / "), total.cast("string"))).otherwise(F.concat(shown.cast("string"), F.when(exhausted, F.lit("")).otherwise(F.lit("+"))))


def without_titles_of(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose title, in lower case, no row of others has; rows are not compared among themselves."""
    own = others.select(F.lower(F.coalesce("title", F.lit(""))).alias("_t")).distinct()
    return rows.join(own, F.lower(F.coalesce(rows.title, F.lit(""))) == F.col("_t"), "left_anti")
