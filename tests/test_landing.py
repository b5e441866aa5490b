from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from citespark.sources import landing


def test_landed_answers(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("s", "work", "a", 200, "old", at(0)), ("s", "work", "a", 200, "new", at(5)), ("s", "work", "a", 500, None, at(9)), ("s", "refs", "a", 200, "r", at(1)), ("s", "work", "b", 404, None, at(1)), ("t", "work", "a", 200, "x", at(1))]
    df = spark.createDataFrame(rows, landing.PAYLOADS)
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j"))
    for fmt, folder in (("parquet", "p"), ("json", "j")):
        p = landing.read_payloads(spark, str(tmp_path / folder), fmt)
        assert {tuple(r) for r in landing.answers(p, "s", "work").collect()} == {("a", "new")}
    now = F.lit(int(at(30).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    asked = spark.createDataFrame([("s", "work", k) for k in ("a", "b", "c", "c")], "source string, endpoint string, key string")
    assert {r.key for r in landing.due(asked, df, now, 26 * 60_000).collect()} == {"b", "c"}
    assert {r.key for r in landing.due(asked, df, now, 20 * 60_000).collect()} == {"a", "b", "c"}


def test_requests(spark):
    df = spark.createDataFrame([("http://x/y", "http://x/y?a=b", "m e@x.org", 503, 1, None), ("u", "u", "m", 404, 0, "7")], "a string, b string, mail string, status int, tried int, later string")
    got = df.select(landing.with_contact(F.col("a"), F.col("mail")).alias("a"), landing.with_contact(F.col("b"), F.col("mail")).alias("b"), landing.is_retried(F.col("status"), F.col("tried")).alias("again"), landing.retry_delay(F.col("tried"), F.col("later")).alias("s")).collect()
    assert tuple(got[0]) == ("http://x/y?mailto=m%20e%40x.org", "http://x/y?a=b&mailto=m%20e%40x.org", True, 2.0) and (got[1].again, got[1].s) == (False, 7.0)
    q = spark.range(1).select(landing.search_expression(F.lit(" a 'b' “c” ")).alias("q"), landing.search_expression(F.lit("方法"), F.lit("O'Li")).alias("r")).first()
    assert tuple(q) == ("(TI %= 'a b c')", "TI %= '方法' AND AU='OLi'")
