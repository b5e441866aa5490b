"""Passages that repeat across documents: hashed runs of consecutive sentences, joined globally."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import WHITE, mix, powers, runs, word_hashes, words

#: Consecutive sentences of a run, and the words that they have together at least: three sentences of a word or two
#: each repeat without being copied.
SENTENCES, MIN_WORDS = 3, 12
#: A sentence of more words is cut after so many, from its beginning on, so that a long one is a run of several.
LONG = 12

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
#: Full stops after which no white space is written.
_FAR_STOPS = tuple(c.encode() for c in "。！？।")


def _far_stops(buf: np.ndarray) -> np.ndarray:
    """Places right after the stops of _FAR_STOPS, all of three bytes."""
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    found = np.zeros(len(buf) - 2, bool)
    for a, b, c in _FAR_STOPS:
        found |= (buf[:-2] == a) & (buf[1:-1] == b) & (buf[2:] == c)
    return np.flatnonzero(found) + 3


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hash, number of words and first byte of each sentence, and first[i], where text i's sentences begin.
    A sentence ends at a line break, at . ! or ? before white space, or at a stop of _FAR_STOPS, and after LONG words; it has
    a word at least. Two characters of a script of three bytes each count as a word."""
    far = _far_stops(buf)
    starts, ends, first = words(buf, offsets, WHITE, far)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, np.zeros(len(offsets), np.int64)
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    new = np.ones(len(starts), bool)
    new[1:] = (_STOP[buf[ends[:-1] - 1]] & (starts[1:] > ends[:-1])) | (lines[starts[1:]] > lines[ends[:-1]]) | np.isin(ends[:-1], far)
    new[first[:-1][first[:-1] < first[1:]]] = True
    wide = np.concatenate([[0], np.cumsum(buf >= 0xE0)])
    weight = np.maximum(1, (wide[ends] - wide[starts]) // 2)
    before = np.cumsum(weight) - weight
    at = np.flatnonzero(new)
    part = (before - np.repeat(before[at], np.diff(np.append(at, len(starts))))) // LONG
    new[1:] |= part[1:] != part[:-1]
    at = np.flatnonzero(new)
    n_words = np.diff(np.append(at, len(starts)))
    with np.errstate(over="ignore"):
        place = np.arange(len(starts)) - np.repeat(at, n_words)
        h = mix(np.add.reduceat(word_hashes(buf, starts, ends) * powers(max(64, 1 << int(n_words.max()).bit_length()))[place], at) + n_words.astype(np.uint64))
    return h, np.add.reduceat(weight, at), starts[at], np.searchsorted(at, first, "left")


def spans(h: np.ndarray, size: np.ndarray, first: np.ndarray, k: int = SENTENCES, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, hash) of every run of k consecutive sentences that has `least` words; a text of fewer sentences is one run."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    count = np.concatenate([[0], np.cumsum(size)])
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    a = np.arange(n)
    b = np.minimum(a + k, end)
    ok = ((b - a == k) | (a == begin)) & (count[b] - count[a] >= least)
    a, b = a[ok], b[ok]
    with np.errstate(over="ignore"):
        out = (b - a).astype(np.uint64)
        for i in range(k):
            out = np.where(a + i < b, mix(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(a + i, n - 1)]), out)
    return a, b, out


def _first_in_text(a: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether no earlier run of the same text has the hash."""
    doc = np.searchsorted(first, a, "right") - 1
    order = np.lexsort((a, h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.ones(len(a), bool)
    out[order[1:][same]] = False
    return out


_RUN = pa.schema([("doc_id", pa.int64()), ("sub", pa.int64()), ("span", pa.int64())])


def _spans(k: int, least: int):
    def run(batches):
        for b in batches:
            ids, subs = b.column(0), b.column(1)
            for at, buf, offsets in runs(b.column(2)):
                h, size, _, first = sentences(buf, offsets)
                a, _, s = spans(h, size, first, k, least)
                keep = _first_in_text(a, s, first)
                doc = pa.array(at + np.searchsorted(first, a[keep], "right") - 1)
                yield pa.RecordBatch.from_arrays([ids.take(doc), subs.take(doc), pa.array(s[keep].view(np.int64))], schema=_RUN)

    return run


_CLEAN = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _clean(k: int, least: int):
    return lambda batches: _cleaned(batches, k, least)


def _cleaned(batches, k: int, least: int):
    for b in batches:
        texts, gone = b.column(1), b.column(2)
        ids = b.column(0)
        for at, buf, offsets in runs(texts):
            n = len(offsets) - 1
            h, size, starts, first = sentences(buf, offsets)
            a, e, s = spans(h, size, first, k, least)
            bad = ~_first_in_text(a, s, first)
            doc = np.searchsorted(first, a, "right") - 1
            begin = np.searchsorted(a, first, "left")
            for d in range(n):
                if gone[at + d].is_valid and begin[d] < begin[d + 1]:
                    bad[begin[d] : begin[d + 1]] |= np.isin(s[begin[d] : begin[d + 1]].view(np.int64), gone[at + d].values.to_numpy(zero_copy_only=False))
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, a[bad], 1)
            np.add.at(change, e[bad], -1)
            covered = np.cumsum(change)[:-1] > 0
            removed = np.bincount(np.repeat(np.arange(n), np.diff(first))[covered], minlength=n) if len(h) else np.zeros(n, np.int64)
            out = []
            for d in range(n):
                if not texts[at + d].is_valid:
                    out.append(None)
                elif not removed[d]:
                    out.append(buf[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
                else:
                    i, j = first[d], first[d + 1]
                    edges = np.append(starts[i:j], offsets[d + 1])
                    left = [buf[offsets[d] : edges[0]].tobytes()]
                    left += [buf[edges[m] : edges[m + 1]].tobytes() for m in range(j - i) if not covered[i + m]]
                    out.append(b"".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(np.diff(first)), pa.array(removed.astype(np.int64)), pa.array(out, pa.string())], schema=_CLEAN)


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_sentences, n_removed, text without the
    sentences that a non-first repeated run covers.

    A run is any `sentences` consecutive sentences that have min_words words; they are compared by their words, A-Z
    lower-cased. Within a text the earliest run is first, across texts the one of the smallest doc_id; rows with one doc_id
    count as one document, null doc_ids as the last one. Null texts stay null; texts of fewer than min_words words stay as
    they are; very long texts are hashed in runs, with memory for their sentences; an empty table gives an empty result. A
    hot run is counted map-side, and the join that finds its documents can be split by adaptive execution."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("sub", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))  # rows without an id stay apart
    own = docs.select("doc_id", "sub", "text").mapInArrow(_spans(sentences, min_words), "doc_id long, sub long, span long")
    shared = own.groupBy("span").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = (
        own.join(shared, "span")
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("sub").alias("_sub"))
        .agg(F.collect_set("span").alias("gone"))
    )
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("sub").eqNullSafe(F.col("_sub")), "left").select("doc_id", "text", "gone")
    return both.mapInArrow(_clean(sentences, min_words), "doc_id long, n_sentences long, n_removed long, text string")
