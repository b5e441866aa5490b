"""Change feeds of a library: the latest state of each item, index upkeep, caches with a time to live, correlated clicks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETES = ("delete", "trash")


def latest_items(events: DataFrame) -> DataFrame:
    """Of events(item_id, seq, event, ...) the last of each item, without items whose last event deletes them."""
    rest = [c for c in events.columns if c != "item_id"]
    last = events.groupBy("item_id").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("item_id", "_r.*")
    return last.where(~F.col("event").isin(*DELETES))


def upsert_keys(index: DataFrame, batch: DataFrame, keys_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The match index after a batch of change events(item_id, seq, event, and an item's columns): all keys of a touched
    item go, those of its last state come, and none of a deleted one. So no stale key of an earlier title stays."""
    touched = batch.select("item_id").distinct()
    return index.join(touched, "item_id", "left_anti").unionByName(keys_of(latest_items(batch)), allowMissingColumns=True)


def maintain(stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], keys_of: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Starts a query that applies each micro-batch with upsert_keys. `store` gets the batch's number, so that it can
    leave out one that it has stored before."""
    return stream.writeStream.foreachBatch(lambda df, n: store(upsert_keys(load(), df, keys_of), n)).option("checkpointLocation", checkpoint).start()


def correlate(ups: DataFrame, navs: DataFrame, within: str = "INTERVAL 300 MILLISECONDS") -> DataFrame:
    """Pairs of ups(ts, reader, ...) and navs(ts, reader, ...) of one reader, the second no later than `within` after the
    first. Works on tables and, with watermarks on both, on streams."""
    a, b = ups.withColumnRenamed("ts", "up_ts"), navs.withColumnRenamed("ts", "nav_ts").withColumnRenamed("reader", "_reader")
    near = (F.col("reader") == F.col("_reader")) & (F.col("nav_ts") >= F.col("up_ts")) & (F.col("nav_ts") <= F.col("up_ts") + F.expr(within))
    return a.join(b, near).drop("_reader")


def correlate_streams(ups: DataFrame, navs: DataFrame, within: str = "INTERVAL 300 MILLISECONDS", late: str = "10 seconds") -> DataFrame:
    return correlate(ups.withWatermark("ts", late), navs.withWatermark("ts", late), within)


def once(requests: DataFrame, key: str = "key", late: str | None = None) -> DataFrame:
    """One row a key; on a stream with `late`, within the watermark."""
    if late and requests.isStreaming:
        return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return requests.dropDuplicates([key])


def invalidated(cache: DataFrame, events: DataFrame) -> DataFrame:
    """Cached rows of items that no event deletes."""
    return cache.join(events.where(F.col("event").isin(*DELETES)).select("item_id").distinct(), "item_id", "left_anti")


def newest_sessions(sessions: DataFrame, n: int = 150) -> DataFrame:
    """The n sessions inserted last."""
    return sessions.orderBy(F.col("inserted").desc(), "session_id").limit(n)
