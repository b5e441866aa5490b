"""WARC archives: a deduplicating writer and a splittable reader of record-wise compressed files."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import qualified, shared_folder

MAGIC = b"\x1f\x8b\x08"
#: Bytes of archive that one reading task owns, and that are read at a time.
RANGE, READ = 8 << 20, 1 << 20
#: Payloads below this size are never revisits.
LEAST = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("refers_to", pa.int64())])
_READ_T = "record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_READ = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(text: str) -> str:
    """For a header line: line breaks, % and control characters as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unline(text: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += ([] if url is None else [f"WARC-Target-URI: {_line(url)}"]) + [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] * revisit
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parse(raw: bytes) -> tuple | None:
    """The columns of a reading, or None for a record that is neither a response nor a revisit, or says no length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    length = fields.get("content-length", "0")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return None
    block = rest[: int(length)]
    http, _, body = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", fields.get(name, ""))) else None
    url = fields.get("warc-target-uri")
    return (kind, number("warc-record-id"), None if url is None else _unline(url), fields.get("warc-payload-digest", "").rpartition(":")[2], int(size[1]) if size else len(body), number("warc-refers-to"), body if kind == "response" else None)


def _write(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        path, own = f"{root}/part-{part:06d}.warc.gz", f"{root}/.{uuid.uuid4().hex}.tmp"  # another attempt writes another file, and renames it to the same name
        records = size = 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(own) as f:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    f.write(data := record(*row))
                    records += 1
                    size += len(data)
        if records:
            try:
                fs.move(own, path)
            except OSError:  # some stores don't rename over the file of an attempt whose answer was lost
                fs.delete_file(path)
                fs.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.warc.gz"]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])
        else:
            fs.delete_file(own)

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are ignored) to archives in folder, one a
    task, and returns path, bytes, records of each archive.

    The payload is html in UTF-8, null as empty. Of the rows whose equal payload has LEAST bytes or more, those of the
    smallest page_id are responses, and the others are revisits that refer to it, null page_ids too (if all are null, all
    are responses). An empty table writes nothing. A task that runs again writes its archive anew and renames it over the
    old one. A payload that many pages share is aggregated map-side, and its join can be split."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    first = own.where(F.length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = own.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")
    return rows.mapInArrow(_write(qualified(pages.sparkSession, folder)), "path string, bytes long, records long")


def members(f, start: int, end: int, read: int = READ):
    """Decompressed gzip members of WARC records that start in bytes start to end of a seekable file.

    Candidates are found by the gzip magic; one whose first bytes do not decompress to a WARC header is none. After a
    record the next one is taken to start where it ends. A candidate that was searched for, not reached in that way, must
    itself be followed by another member or the end of the file, which a record inside a stored payload is not."""
    at, buf, pos = start, b"", 0  # buf[pos] is byte `at` of the file
    f.seek(start)

    def fill() -> bool:
        nonlocal buf, pos
        got = f.read(read)
        buf, pos = buf[pos:] + got, 0
        return bool(got)

    chained = start == 0
    while at < end:
        while (k := buf.find(MAGIC, pos)) < 0:
            cut = max(pos, len(buf) - 2)
            at, pos = at + cut - pos, cut
            if at >= end or not fill():
                return
        chained &= k == pos
        at, pos = at + k - pos, k
        if at >= end:
            return
        z, out, done, head, step = zlib.decompressobj(31), [], 0, b"", 4096
        try:
            while not z.eof:
                if pos + done == len(buf) and not fill():
                    break
                part = buf[pos + done : pos + done + step]
                out.append(z.decompress(part))
                done, step = done + len(part), min(2 * step, 1 << 16)
                if len(head) < 7:
                    head += out[-1][:7]
                    if not b"WARC/1.".startswith(head[:7]):
                        raise zlib.error
            good = z.eof and head.startswith(b"WARC/1.")
        except zlib.error:
            good = False
        size = done - len(z.unused_data)
        if good and not chained:
            while len(buf) - pos - size < 3 and fill():
                pass
            good = MAGIC.startswith(buf[pos + size : pos + size + 3])
        if good:
            yield b"".join(out)
        chained = good
        step = size if good else 1
        at, pos = at + step, pos + step


def _read(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{path}") as f:
                    for raw in members(f, start, end):
                        if (row := parse(raw)) is not None:
                            rows.append(row)
                            held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)

    return run


def read_warc(archives: DataFrame, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """The response and revisit records of archives (path below folder, bytes): record_type, page_id, url,
    payload_digest and payload_bytes as their headers have them, refers_to, payload (null for revisits).

    Archives are cut into byte ranges; the task of a range reads the records that start in it to their ends. A record
    needs to be a gzip member of its own. Files with no records and an empty table give no rows."""
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + range_bytes).alias("end"))
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(_read(qualified(archives.sparkSession, folder)), _READ_T)


def folder_for(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
