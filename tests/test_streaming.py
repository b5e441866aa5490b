from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from citespark.streaming.feed import correlate_streams, invalidated, latest_items, maintain, newest_sessions, once, upsert_keys

EVENT = "seq long, item_id long, event string, title string"


def test_latest_and_upsert(spark):
    e = spark.createDataFrame([(1, 1, "add", "a"), (2, 1, "modify", "b"), (3, 2, "add", "c"), (4, 2, "trash", None), (5, 3, "add", "d")], EVENT)
    assert {(r.item_id, r.title) for r in latest_items(e).collect()} == {(1, "b"), (3, "d")}
    index = spark.createDataFrame([(1, "a"), (2, "c"), (9, "z")], "item_id long, key string")
    keys = lambda df: df.select("item_id", F.col("title").alias("key"))
    assert {tuple(r) for r in upsert_keys(index, e, keys).collect()} == {(1, "b"), (3, "d"), (9, "z")}
    assert {r.item_id for r in invalidated(index, e).collect()} == {1, 9}


def test_maintained_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src, state = tmp_path / "in", {"df": spark.createDataFrame([], "item_id long, key string"), "seen": []}
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))
    spark.createDataFrame([(1, 1, "add", "a"), (2, 2, "add", "b")], EVENT).coalesce(1).write.mode("append").parquet(str(src))

    def store(df, n):
        df.write.mode("overwrite").parquet(str(tmp_path / f"v{n}"))
        state["df"] = spark.read.parquet(str(tmp_path / f"v{n}"))

    q = maintain(stream, lambda: state["df"], store, lambda df: df.select("item_id", F.col("title").alias("key")), str(tmp_path / "ck"))
    q.processAllAvailable()
    spark.createDataFrame([(3, 1, "modify", "c"), (4, 2, "delete", None)], EVENT).coalesce(1).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in state["df"].collect()} == {(1, "c")}


def test_correlated_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    schema = "ts timestamp, reader string, id long"
    spark.createDataFrame([(at(0), "a", 1), (at(1000), "b", 2)], schema).write.parquet(str(tmp_path / "u"))
    spark.createDataFrame([(at(300), "a", 1), (at(301), "a", 2), (at(999), "b", 3)], schema).write.parquet(str(tmp_path / "n"))
    read = lambda d: spark.readStream.schema(schema).parquet(str(tmp_path / d))
    out = correlate_streams(read("u").withColumnRenamed("id", "up"), read("n").withColumnRenamed("id", "nav"))
    q = out.writeStream.format("memory").queryName("pairs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.up, r.nav) for r in spark.table("pairs").collect()] == [(1, 1)]


def test_once_and_sessions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, v long")
    assert once(df).count() == 2
    s = spark.createDataFrame([(i, i % 3) for i in range(9)], "session_id long, inserted long")
    assert [r.session_id for r in newest_sessions(s, 4).collect()] == [2, 5, 8, 1]
