"""Answers of services as they were landed: one table of requests, read instead of the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions.text import encode_component, missing, squeeze, strip
from citespark.operators.cache import fresh

PAYLOADS = "source string, endpoint string, key string, status int, body string, fetched_at timestamp"
# Requests that are tried again, how often, and the first delay in seconds.
AGAIN, RETRIES, DELAY = 429, 2, 1.0


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """PAYLOADS of a folder of Parquet or JSON files."""
    return spark.read.schema(PAYLOADS).format(fmt).load(path)


def answers(payloads: DataFrame, source: str, endpoint: str | None = None) -> DataFrame:
    """(key, body) of a source's last successful answer for each key; requests that were sent twice count once."""
    own = payloads.where((F.col("source") == source) & F.col("status").between(200, 299) & F.col("body").isNotNull())
    if endpoint is not None:
        own = own.where(F.col("endpoint") == endpoint)
    return own.groupBy("key").agg(F.max_by("body", "fetched_at").alias("body"))


def due(requests: DataFrame, payloads: DataFrame, now: Column, ttl_ms: int) -> DataFrame:
    """requests(source, endpoint, key) without those that a landed answer or failure still covers."""
    at = ["source", "endpoint", "key"]
    landed = payloads.select(*at, F.unix_millis("fetched_at").alias("t"), F.when(F.col("status").between(200, 299), F.col("body")).alias("body"))
    return requests.distinct().join(fresh(landed, now, ttl_ms).select(*at), at, "left_anti")


def is_retried(status: Column, tried: Column) -> Column:
    return ((status == AGAIN) | (status >= 500)) & (tried < RETRIES)


def retry_delay(tried: Column, retry_after: Column) -> Column:
    """Seconds until the next try: what the service says, else twice as long each time."""
    return F.coalesce(retry_after.cast("double"), DELAY * F.pow(F.lit(2.0), tried))


def with_contact(url: Column, mail: Column) -> Column:
    """A request's address with the contact that polite pools ask for."""
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("mailto="), encode_component(mail))


def search_expression(title: Column, author: Column | None = None) -> Column:
    """An expert search for a title and, where given, an author; quotes, which would end the literal, go."""
    t = strip(squeeze(F.regexp_replace(title, "['\"‘’“”]", " "), " "))
    by_title = F.concat(F.lit("TI %= '"), t, F.lit("'"))
    out = F.when(t.contains(" "), F.concat(F.lit("("), by_title, F.lit(")"))).otherwise(by_title)
    if author is None:
        return out
    return F.concat(out, F.coalesce(F.concat(F.lit(" AND AU='"), F.regexp_replace(missing(author), "['\"]", ""), F.lit("'")), F.lit("")))
