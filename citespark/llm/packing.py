"""Packing of tokenized documents into fixed windows: best-fit decreasing with a segment tree over remaining capacity."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import tidy

#: Documents are packed together until they hold so many tokens; this bounds a task's memory.
GROUP_TOKENS = 16_000_000
#: Texts are encoded together until they hold so many bytes.
CHUNK = 2_000_000
#: Entries of a worker's table from words or pieces to ids; a full table is emptied.
WORDS = 700_000
#: New words are encoded in texts of so many, with a word of this control character between them.
TOGETHER, MARK = 500, "\x01"
#: What stands after the ids of a word.
_NO_ID = 0xFFFFFFFF
_END = _NO_ID.to_bytes(4, "little")


def pack_ids(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


#: Characters of words that are taken apart here: letters with one lower-case form that composes with no other letter, digits, signs.
LETTERS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and c not in "İŉ")
_PLAIN = r"!-~" + LETTERS
_LOWER = "a-z" + LETTERS
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^{_LOWER}0-9\n]+|\n")
#: What a tokenizer does before its merges, if _PIECES may do it instead.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Pieces:
    """Ids of words of plain characters by the tokenizer's merges alone. Words are put in lower case and taken apart at signs
    and digits here, many at once, and each piece goes to the tokenizer once, so that forms of a word share their work."""

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer

        model = spec["model"]
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "CharDelimiterSplit", "delimiter": " "}, _BYTES]}}))
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)  # by id: a piece's last token
        self.last[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        self.other = re.compile("|".join([rf"[^{_PLAIN}\n]", *(re.escape(t["content"]) for t in spec["added_tokens"])])).search
        self.known: dict[str, bytes] = {"\n": _END}

    @staticmethod
    def fit(spec: dict) -> bool:
        """Whether the tokenizer takes texts apart as _PIECES does, and marks the ends of pieces."""
        model = spec["model"]
        return (
            spec.get("normalizer") == _NORMALIZER
            and spec.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
            and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and model["type"] == "BPE"
            and bool(model.get("end_of_word_suffix"))
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        )

    def _encode(self, pieces: list[str]) -> list[bytes]:
        some = [" ".join(pieces[at : at + TOGETHER]) for at in range(0, len(pieces), TOGETHER)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, lines: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, each of which has a line break after it and no other characters; where each word's begin, and
        how many they are."""
        pieces = _PIECES.findall(lines.lower())
        different = set(pieces)
        new = list(different.difference(self.known))
        if len(self.known) + len(new) > WORDS:
            self.known = {"\n": _END}
            new = list(different.difference(self.known))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.known.update(zip(some, self._encode(some)))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")
        ends = np.flatnonzero(ids == _NO_ID)
        start = np.concatenate([[0], ends + 1])[:-1]
        return ids, start, ends - start


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes. The tokenizer never joins characters across white space, so
    that each white-space separated word of the texts is looked up once. Words that Pieces doesn't take are encoded
    many as one text, and told apart by a mark between them: a call for each word takes longer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.pieces = Pieces(spec) if Pieces.fit(spec) else None
        self.known: dict[bytes, bytes] = {}
        alone = self._one_by_one([MARK])[0]
        self.mark = int.from_bytes(alone, "little") if len(alone) == 4 else None

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is None or any(MARK in t for t in texts):
            return self._one_by_one(texts)
        some = [f" {MARK} ".join([*texts[at : at + TOGETHER], ""]) for at in range(0, len(texts), TOGETHER)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False) for i in e.ids], "<u4")
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(texts):  # a word has the mark's id
            return self._one_by_one(texts)
        data, marks = ids.tobytes(), (4 * marks).tolist()
        return [data[a:b] for a, b in zip([0, *(m + 4 for m in marks)], marks)]

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words by the whole tokenizer, as Pieces.ids() gives them."""
        found = [*map(self.known.get, words)]
        if None in found:
            new = [w for w, x in zip(words, found) if x is None]
            if len(self.known) + len(new) > WORDS:
                self.known.clear()
                new = words
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                self.known.update(zip(some, self._ids(some)))
            found = [*map(self.known.__getitem__, words)]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n, n

    def _words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, each with a line break after it, as Pieces.ids() gives them."""
        words = joined.split(b"\n")[:-1]
        if self.pieces is None:
            return self._whole(words)
        lines = joined.decode("utf-8", "replace")
        if not self.pieces.other(lines):
            return self.pieces.ids(lines)
        texts = lines.split("\n")[:-1]
        other = [*map(self.pieces.other, texts)]
        ids, plain_start, plain_n = self.pieces.ids("".join([t + "\n" for t, x in zip(texts, other) if not x]))
        more, more_start, more_n = self._whole([w for w, x in zip(words, other) if x])
        start, n, rest = np.empty(len(words), np.int64), np.empty(len(words), np.int64), np.array(other, bool)
        start[~rest], n[~rest] = plain_start, plain_n
        start[rest], n[rest] = len(ids) + more_start, more_n
        return np.concatenate([ids, more]), start, n

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.binary()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string or binary array; null has none."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        plain = pa.Array.from_buffers(pa.large_utf8(), len(texts), texts.buffers(), offset=texts.offset)  # split as bytes, nothing is decoded
        parts = pc.ascii_split_whitespace(plain)
        words = parts.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        different = words.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different), pa.scalar("\n", different.type))[0].as_buffer().to_pybytes() + b"\n"
        ids, start, n = self._words(joined)
        word = words.indices.to_numpy()
        n = n[word]
        ends = np.concatenate([[0], np.cumsum(n)])  # by word: its first id among those of all texts
        data = ids[np.repeat(start[word] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


class Windows:
    """Open windows by remaining capacity. Leaf c of the segment tree counts the windows with c tokens left; the tightest
    window for a piece is the first non-empty leaf at or after its length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, c: int, n: int) -> None:
        c += self.leaves
        while c:
            self.tree[c] += n
            c >>= 1

    def put(self, c: int, window: int) -> None:
        if c:
            self.open[c].append(window)
            self._add(c, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest fit, which is no longer open."""
        c = need + self.leaves
        while not self.tree[c]:
            while c & 1:  # a right child: what is right of it begins at the parent's right neighbour
                c >>= 1
            if not c:
                return None
            c += 1
            if c & (c - 1) == 0:  # past the last leaf of its level
                return None
        while c < self.leaves:
            c = 2 * c if self.tree[2 * c] else 2 * c + 1
        c -= self.leaves
        self._add(c, -1)
        return c, self.open[c].pop()


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length), for documents of lengths > 0.

    Overlong documents are first cut into full windows; the rests go, longest first, into the tightest open window. What
    is then still open is closed without padding: the emptiest windows are cut to fill up the others, and the last one
    is cut at powers of two, which need no padding."""
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        full = n // size
        out.extend([(d, k * size, size)] for k in range(full))
        if n % size:
            rest.append((n % size, d, full * size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    windows, made, room = Windows(size), [], []
    for n, d, start in rest:
        if found := windows.take(n):
            c, w = found
            made[w].append((d, start, n))
        else:
            c, w = size, len(made)
            made.append([(d, start, n)])
            room.append(size)
        room[w] = c - n
        windows.put(c - n, w)
    order = sorted((w for w in range(len(made)) if room[w]), key=lambda w: -room[w])  # emptiest first
    low, high = 0, len(order) - 1
    while low < high:
        a, b = order[low], order[high]
        while room[b] and made[a]:
            d, s, n = made[a].pop()
            take = min(n, room[b])
            if take < n:
                made[a].append((d, s, n - take))
            made[b].append((d, s + n - take, take))
            room[b] -= take
        if not room[b]:
            high -= 1
        if not made[a]:
            low += 1
    if low == high and room[w := order[low]] and made[w]:
        left, made[w] = made[w][::-1], []
        total = sum(n for _, _, n in left)
        for bit in range(total.bit_length() - 1, -1, -1):
            if need := total & 1 << bit:
                part = []
                while need:
                    d, s, n = left.pop()
                    take = min(n, need)
                    if take < n:
                        left.append((d, s + take, n - take))
                    part.append((d, s, take))
                    need -= take
                made.append(part)
    return out + [m for m in made if m]


_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _chunks(b: pa.RecordBatch):
    """Slices of rows (doc_id, text), of CHUNK bytes of text or of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        yield b.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def _pack(path: str, end: int, size: int):
    def run(batches):
        ids: list = []
        texts: list[bytes] = []
        held = 0
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        stop = pack_ids([end])

        def flush():
            nonlocal ids, texts, held, sequence
            columns: dict[str, list] = {n: [] for n in _PIECE.names}
            size_now = 0
            for pieces in pack([len(t) // 4 for t in texts], size):
                offset = 0
                for d, s, n in pieces:
                    for c, v in zip(_PIECE.names, (ids[d], s, n, len(texts[d]) // 4, sequence, offset, texts[d][4 * s : 4 * (s + n)])):
                        columns[c].append(v)
                    offset += n
                sequence += 1
                size_now += offset
                if size_now > 1_000_000:
                    yield pa.RecordBatch.from_pydict(columns, _PIECE)
                    columns, size_now = {n: [] for n in _PIECE.names}, 0
            if columns["start"]:
                yield pa.RecordBatch.from_pydict(columns, _PIECE)
            ids, texts, held = [], [], 0

        for b in batches:
            for part in _chunks(b):
                got = [t + stop for t in tokens(path).encode_array(part.column(1))]
                ids += part.column(0).to_pylist()
                texts += got
                held += sum(map(len, got)) // 4
                if held >= GROUP_TOKENS:
                    yield from flush()
        if texts:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """Pieces of docs (doc_id, text; other columns are ignored): doc_id, start (ids of its row before it), length, ids
    (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every row's ids, with end_id after them, lie in exactly one piece each; null and empty texts are end_id alone. Rows
    with one doc_id, or a null one, are packed one by one. An empty table gives no pieces. A sequence holds at most `size`
    ids, and every sequence is full or a power of two long, so that none needs padding. Each task packs its own rows, in
    groups of GROUP_TOKENS: no shuffle, and memory doesn't follow the input. Sequence ids follow from the partition's
    number and are unique."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(_pack(tokenizer, end_id, size)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
