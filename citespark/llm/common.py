"""What the training-data operators share: text scanning with numpy, shared tables, native text expressions."""

from __future__ import annotations

import atexit
import functools
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte classes of the separators of `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_HASH = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are scanned in runs of about so many bytes, so that memory doesn't follow the batch.
RUN_BYTES = 1_000_000
#: Batches of so many bytes go to Python workers, and Spark's setting for it.
BATCH_BYTES, BATCH_SETTING = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


# ---------------------------------------------------------------- shared tables


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir; where the cluster names none, below /tmp/checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/citespark-{spark.sparkContext.applicationId}"
    _clean_at_exit(spark.sparkContext, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full address of the file system that Spark takes it to be on, for readers other than Spark's."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("s3a://", "s3://", 1) if full.startswith("s3a://") else full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


@functools.cache
def _clean_at_exit(context, path: str) -> None:
    def clean():
        if context._jsc is not None:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(clean)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: no lineage, no second computation, and any
    executor can be lost afterwards."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(operator):
    """The operator (docs, ...), whose own runs send batches of BATCH_BYTES to Python workers, if the session doesn't say
    how large they are. By default a batch has up to 64 MB, which the JVM holds off its heap and the worker once more, for
    each task. What the operator returns is run with the session's setting, as it is after it."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named):
        conf = docs.sparkSession.conf
        if conf.get(BATCH_SETTING, None) is not None:
            return operator(docs, *args, **named)
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
        try:
            return operator(docs, *args, **named)
        finally:
            conf.unset(BATCH_SETTING)

    return run


def whole_rows(df: DataFrame) -> DataFrame:
    """(row, id): each row as one struct, so that no name of an operator's own clashes with its columns, and its doc_id."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))


def rows_of(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df with (left_semi) or without (left_anti) a doc_id of the single column of ids; nulls match nulls."""
    ids = ids.toDF("_other")
    return whole_rows(df).join(ids, F.col("id").eqNullSafe(F.col("_other")), how).select("row.*")


# ---------------------------------------------------------------- native expressions


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that where every character is ASCII, and is much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


# ---------------------------------------------------------------- numpy


@functools.cache
def one_thread() -> None:
    """Keeps numpy's matrix products to one thread, since every core has a task of its own; where the library has no such
    switch, they stay as they are."""
    import ctypes
    import glob
    import os

    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


@functools.cache
def _trim():
    """The C library's function that returns freed memory to the system, if it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run):
    """run, a function of batches, which returns freed memory to the system when it ends: workers stay after their tasks,
    and would keep the most that any task had, beside the JVM's memory in later stages."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]), dtype=np.uint64)


def runs(texts: pa.Array, most: int = RUN_BYTES):
    """Cuts a string array into slices (start, bytes, offsets) of about `most` bytes of whole texts; null counts as empty.
    offsets has one element more than the slice has texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = WHITE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and first[i], the index of text i's first word (one more for the end). Words
    also end at the places of cuts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets, "left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    before = np.cumsum(size) - size
    total = int(before[-1] + size[-1])
    shift = np.repeat(starts - before, size)
    at = np.arange(total, dtype=np.int64)
    got = buf[at + shift]
    with np.errstate(over="ignore"):
        h = _BYTE_HASH[_LOWER[got] if lower else got] * powers(max(64, 1 << int(size.max() - 1).bit_length()))[at - np.repeat(before, size)]
        return mix(np.add.reduceat(h, before) + size.astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (texts of fewer words: of the whole text as one), and bounds[i], where text i's begin."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    end = np.repeat(first[1:], count)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = at + j < end
            out = mix(out * _BASE + np.where(there, hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(j + 1)))
    return out, bounds


def distinct_by_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
