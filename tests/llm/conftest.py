"""Small awkward tables for the training-data operators."""

from __future__ import annotations

import pytest
from llmprose import prose

AWKWARD = [
    (1, "Foo bar baz qux quux", "en", "s1"),
    (1, "Foo bar baz qux quux", "en", "s1"),  # a repeated row
    (2, None, None, None),
    (3, "", "en", "s2"),
    (4, " \n\t ", "en", None),
    (5, prose(3000, 5), "en", "s1"),
    (6, "x" * 50_000, "de", "s3"),
    (None, "Foo bar baz qux quux", "en", "s1"),
    (7, "öä üß 漢字 😀 é", None, "s4"),
    (8, "a", "en", "s1"),
]
#: Names that operators give to columns of their own.
CLASHES = "id row kept rep band h size n component_id component vertex n_words n_hit items line first gone n_lines n_removed lower upper score row_lang _other _id _kept _w _all _items url payload block shingles sequence_id".split()


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *["clash"] * len(CLASHES)) for i, t, g, s in AWKWARD], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
