from __future__ import annotations

import gzip
import hashlib
import io
import os
import random

from compare import rows

from citespark.llm import warc
from citespark.llm.common import materialize
from citespark.llm.queries import ORACLE_SQL, QUERIES


def test_query_matches_sql(spark, data, duck):
    got = QUERIES["op2_warc"](spark, data).toPandas()
    assert rows(got) == rows(duck.sql(ORACLE_SQL["op2_warc"]).df())


def _round_trip(spark, pages, size=2000):
    folder = warc.folder_for(spark)
    archives = materialize(warc.write_warc(pages, folder), "archives")
    return folder, warc.read_warc(archives, folder, size).collect()


def test_round_trip_of_awkward_pages(spark):
    r = random.Random(2)
    big = "".join(chr(r.randrange(32, 0x2FF)) for _ in range(30_000))
    same = "<p>" + "same " * 40
    rows = [
        (1, "http://a.b/c\r\nX: y%", "<html>é\r\n\r\n</html>"), (2, None, None), (3, "", ""), (4, "u", big), (5, "u", same), (6, "u", same), (6, "u", same), (0, "u", same), (None, "u", same),
        (7, "v", "short"), (8, "v", "short"), (9, "w", "WARC/1.1\r\n\r\n" + "x" * 99), (10, "w", "\x1f\x8b\x08" * 50),
    ]
    pages = spark.createDataFrame([(*x, "z", "z") for x in rows], "page_id long, url string, html string, digest string, payload string").repartition(3)
    folder, got = _round_trip(spark, pages)
    assert len(got) == len(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted(((g.page_id, g.url) for g in got), key=key) == sorted(((i, u) for i, u, _ in rows), key=key)
    text = {i: (h or "").encode() for i, _, h in rows}
    for g in got:
        own = text[g.page_id]
        assert g.payload_bytes == len(own) and g.payload_digest == hashlib.sha256(own).hexdigest()
        assert g.payload == (None if g.record_type == "revisit" else own)
        assert (g.record_type, g.refers_to) == (("revisit", 0) if own == same.encode() and g.page_id != 0 else ("response", None))
    path = folder.removeprefix("file://")
    for name in os.listdir(path):  # other tools read the archives too
        if name.endswith(".gz"):
            assert gzip.open(f"{path}/{name}").read().count(b"WARC-Record-ID") >= 1


def test_empty_table(spark):
    _, got = _round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got == []


def test_every_range_owns_its_records():
    """Any cut into ranges gives each record once, whatever bytes lie between and whatever looks like a member."""
    r = random.Random(5)
    noise = bytes(r.randrange(256) for _ in range(300))
    members = [warc.record(i, "u", noise * r.randrange(0, 4) + b"\x1f\x8b\x08\x00", "d", None, False) for i in range(12)]
    data = b"\x1f\x8b\x08junk" + members[0] + gzip.compress(b"no record") + b"".join(members[1:]) + b"\x1f\x8b"
    for step in (1, 7, 64, 500, len(data)):
        got = [warc.parse(x)[1] for a in range(0, len(data), step) for x in warc.members(io.BytesIO(data), a, a + step, 50)]
        assert got == list(range(12))


def stored(payload: bytes) -> bytes:
    """A record as a gzip member that isn't compressed, so that its payload's bytes stand in the file."""
    import zlib

    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: " + str(len(block)).encode()
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    return c.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def test_record_inside_a_stored_payload_is_none():
    inner = warc.record(99, "u", b"inner", "d", None, False)
    data = stored(b"x" * 200 + inner + b"y" * 200) + warc.record(2, "u", b"z" * 300, "d", None, False)
    for step in (40, 50, 333, len(data)):
        got = [warc.parse(x)[1] for a in range(0, len(data), step) for x in warc.members(io.BytesIO(data), a, a + step, 64)]
        assert got == [1, 2]


def test_record_without_a_length_is_none():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %s\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"
    for bad in (b"many", b"-5", b"", b"1e3"):
        assert warc.parse(head % bad) is None
    assert warc.parse(head % b"23")[1] == 1


def test_folders_without_a_scheme(spark, tmp_path):
    """A path is the same place for Spark and for the writing and reading tasks, whether it names its scheme or not."""
    pages = spark.createDataFrame([(1, "u", "<p>one</p>")], "page_id long, url string, html string")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/full"):
        archives = materialize(warc.write_warc(pages, folder), "archives")
        assert [x.page_id for x in warc.read_warc(archives, folder).collect()] == [1]
        assert spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").count() == 1
