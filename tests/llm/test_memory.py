"""What the Python workers are sent at once, and what they hold after a task."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citespark.llm import minhash, quality

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    return [r.n for r in docs.mapInArrow(run, "n long").collect()]


@pytest.fixture
def large(spark):
    """15 MB of texts for one task."""
    text = F.concat_ws(" ", F.col("id"), F.repeat(F.lit("some words "), 450))
    return spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))


def test_quality_sends_small_batches(spark, large, monkeypatch):
    seen, models = [], quality.language_models
    monkeypatch.setattr(quality, "language_models", lambda docs: (seen.extend(_sizes(docs)), models(docs))[1])
    assert quality.judged(large).count() == 3000
    assert sum(seen) > 14_000_000 and max(seen) < 5_000_000
    assert spark.conf.get(SETTING, None) is None


def test_minhash_sends_small_batches(spark, large, monkeypatch):
    seen, write = {}, minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: (seen.setdefault(name, _sizes(large)), write(df, name))[1])
    assert minhash.near_duplicates(large).count() == 3000
    assert {"sketches", "sets"} <= set(seen) and max(map(max, seen.values())) < 5_000_000
    assert spark.conf.get(SETTING, None) is None


def test_setting_of_the_session_holds(spark, large, monkeypatch):
    seen, models = [], quality.language_models
    monkeypatch.setattr(quality, "language_models", lambda docs: (seen.extend(_sizes(docs)), models(docs))[1])
    spark.conf.set(SETTING, "1000000")
    try:
        quality.judged(large).count()
        assert max(seen) < 1_500_000 and spark.conf.get(SETTING) == "1000000"
    finally:
        spark.conf.unset(SETTING)


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_goes_back():
    """200 MB that a task frees below a block that stays: without tidy() the process keeps them."""
    code = """
import re
from citespark.llm.common import tidy
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
stays = []
def run(batches):
    some = [bytearray(50_000) for _ in range(4000)]
    stays.append(bytearray(50_000))
    yield held()
print(*tidy(run)([]), held())
"""
    most, after = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split())
    assert most > 200 and after < most - 150
