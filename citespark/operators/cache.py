"""Stored reference lists: what is kept of a record, which lists stay, and how long an answer is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import is_http_url, missing

# Limits of stored records and of the cache.
ID_CHARS, AUTHORS, ITEMS, VERSION = 300, 50, 400, 2
NEGATIVE_MS = 10 * 60 * 1000
DEFAULT_TYPE = "journalArticle"
DROPPED = ("abstract", "description", "tags", "lib_item_id", "reference_count")


def sanitize(refs: DataFrame) -> DataFrame:
    """Records fit to be stored: identifiers shorter than ID_CHARS, the first AUTHORS authors that are there, http(s)
    addresses only, a default type; rows without text and title go, and the columns DROPPED."""
    out = refs.withColumn("identifiers", F.map_filter("identifiers", lambda k, v: v.isNotNull() & (F.length(v) < ID_CHARS)))
    out = out.withColumn("authors", F.slice(F.filter("authors", lambda a: a.isNotNull()), 1, AUTHORS))
    for c in ("url", "oa_url"):
        out = out.withColumn(c, F.when(is_http_url(c), F.col(c)))
    out = out.withColumn("type", F.coalesce(missing("type"), F.lit(DEFAULT_TYPE)))
    return out.where(missing("text").isNotNull() | missing("title").isNotNull()).drop(*DROPPED)


def latest_slots(writes: DataFrame) -> DataFrame:
    """Of writes(item_key, slot, t, ...) the last of each item and slot."""
    rest = [c for c in writes.columns if c not in ("item_key", "slot")]
    return writes.groupBy("item_key", "slot").agg(F.max_by(F.struct(*rest), "t").alias("_r")).select("item_key", "slot", "_r.*")


def evict(cache: DataFrame, items: int = ITEMS) -> DataFrame:
    """Slots of the items written last: the greatest time of an item's slots counts, ties by key."""
    stay = cache.groupBy("item_key").agg(F.max("t").alias("_t")).orderBy(F.col("_t").desc(), "item_key").limit(items)
    return cache.join(stay.select("item_key"), "item_key", "left_semi")


def fresh(entries: DataFrame, now: Column, ttl_ms: int) -> DataFrame:
    """Entries(key, t, body) that are still good: answers for ttl_ms, failures (a null body) for ten minutes."""
    return entries.where(now - F.col("t") <= F.when(F.col("body").isNull(), NEGATIVE_MS).otherwise(ttl_ms))


def cached_first(items: DataFrame, cache: DataFrame) -> DataFrame:
    """(item_key, source) for items: the API slot, else the PDF slot, else to be fetched."""
    have = cache.where(F.size("refs") > 0).groupBy("item_key").agg(F.max((F.col("slot") == "API").cast("int")).alias("api"), F.max((F.col("slot") == "PDF").cast("int")).alias("pdf"))
    out = items.join(have, "item_key", "left")
    return out.select("item_key", F.when(F.col("api") == 1, "API").when(F.col("pdf") == 1, "PDF").otherwise("fetch").alias("source"))


def read_cache(spark, path: str, version: int = VERSION) -> DataFrame:
    """A stored cache (Parquet with a version column); rows of another version are ignored."""
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")


def write_cache(cache: DataFrame, path: str, version: int = VERSION) -> None:
    cache.withColumn("version", F.lit(version)).write.mode("overwrite").partitionBy("slot").parquet(path)
