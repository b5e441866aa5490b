from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citespark.llm import packing
from citespark.llm.packing import Tokens, Windows, pack, pack_documents, pack_ids
from citespark.llm.queries import QUERIES, tokenizer_path


def check_pieces(rows, texts, size=4096):
    """Each row's ids lie in exactly one piece each; sequences are gapless, full or a power of two."""
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted(((i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in texts), key=str)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    return want


def test_query(spark, data, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    got = QUERIES["op5_packing"](spark, data).collect()
    want = dict(check_pieces(got, texts))
    seen = {i: 0 for i in want}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids)
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert seen == {i: len(x) for i, x in want.items()}


def test_awkward_rows(spark, awkward, no_docs):
    got = pack_documents(awkward, tokenizer_path()).collect()
    want = check_pieces(got, [(r.doc_id, r.text) for r in awkward.collect()])
    total = {}
    for i, x in want:
        total[i] = total.get(i, 0) + len(x)
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in total} == total
    assert [r.doc_tokens for r in got if r.doc_id == 2] == [1]
    assert pack_documents(no_docs, tokenizer_path()).count() == 0


def test_tokens_are_those_of_whole_texts():
    t = Tokenizer.from_file(tokenizer_path())
    texts = ["", "  ", "<|endoftext|>a b\x1cc", "é e\u0301 \u0301x 'S don't we'LL", "A\tB\u3000C\xa0D\u2028E", "1234 a1b2", "日本語 テキスト", "x" * 5000, "😀 \u200d👩"]
    got = Tokens(tokenizer_path()).encode([x.encode() for x in texts])
    for x, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 2, 7, 16, 100, 4096])
def test_pack_covers_everything_without_padding(size):
    r = random.Random(size)
    for _ in range(60):
        lengths = [r.randint(1, r.choice([3, size, 3 * size])) for _ in range(r.randint(0, 60))]
        seen = [0] * len(lengths)
        places: list[set] = [set() for _ in lengths]
        for q in pack(lengths, size):
            n = sum(p[2] for p in q)
            assert n == size or (0 < n < size and n & (n - 1) == 0)
            for d, a, n in q:
                seen[d] += n
                assert not places[d] & set(range(a, a + n))
                places[d] |= set(range(a, a + n))
        assert seen == lengths


def test_windows_find_the_tightest():
    r, w, have = random.Random(3), Windows(50), []
    for k in range(4000):
        if r.random() < 0.5:
            c = r.randint(1, 50)
            w.put(c, k)
            have.append(c)
        else:
            need = r.randint(1, 50)
            best = min((c for c in have if c >= need), default=None)
            got = w.take(need)
            assert (got[0] if got else None) == best
            if best:
                have.remove(best)


def test_new_words_are_encoded_in_few_texts():
    """Words that are encoded together have the ids that each has alone, whatever characters they have."""
    t = Tokens(tokenizer_path())
    own, seen = t.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return own.encode_batch_fast(texts, **more)

    t.tokenizer = Counting()
    r = random.Random(5)
    chars = [chr(i) for i in range(33, 0x250)] + list("\'\'\'\'ssttmdl<|>İßſẞΣς\u0338\u0301…")
    words = ["".join(r.choices(chars, k=r.randint(1, 9))) for _ in range(20_000)] + ["<|endoftext|>", "a<|startoftext|>b", "\u0301a"]
    words = [w for w in words if w.encode().split() == [w.encode()]]
    marked = ["\x01", "a\x01b", "\x01\x01", "c"]
    for some, most in ((words, len(words) / 100), (marked, len(marked))):
        seen.clear()
        assert t.encode([w.encode() for w in some]) == [pack_ids(e.ids) for e in own.encode_batch_fast(some, add_special_tokens=False)]
        assert len(seen) <= most


def test_forms_of_a_word_are_encoded_once():
    """Capitals and signs at a word make no new work for the tokenizer."""
    seen = []

    class Counting:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.own.encode_batch_fast(texts, **more)

    t = Tokens(tokenizer_path())
    own = t.tokenizer
    for x in (t, getattr(t, "pieces", None)):
        if x is not None:
            x.tokenizer = Counting(x.tokenizer)
    r = random.Random(8)
    stems = ["".join(r.choices("abcdeilnorstuéèäöüßñł", k=12)) for _ in range(500)]
    words = [form(s) + sign for s in stems for form in (str, str.title, str.swapcase) for sign in ("", ".", ",", "!!", "%%%") if len(form(s)) == 12]
    assert t.encode([w.encode() for w in words]) == [pack_ids(e.ids) for e in own.encode_batch_fast(words, add_special_tokens=False)]
    assert sum(map(len, seen)) < 2 * sum(map(len, stems))


def test_words_taken_apart_have_the_tokenizers_ids(tmp_path):
    """Contractions, digits, signs and letters in any order, in texts among other characters, in a full table, and by a
    tokenizer that takes texts apart in another way."""
    r = random.Random(9)
    plain = [chr(i) for i in (*range(33, 127), *range(0xC0, 0x180))] + list("\'\'\'\'\'\'\'\'sstmdlrevLLSTMDREVE!<|>0123")
    rare = list("\x01\x1c\x7f\x85\xa0\xad²¼×÷İŉſΣς\u0301漢😀")
    words = ["".join(r.choices(plain, k=r.randint(1, 8))) for _ in range(20_000)] + ["".join(r.choices(plain * 2 + rare * 20, k=r.randint(1, 6))) for _ in range(5_000)]
    words += ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "a</w>", "</w>", "we'll've", "!'s", "'S", "x" * 5_000]
    r.shuffle(words)
    texts = [r.choice(["", " ", "\n\t"]) + " ".join(words[i : i + 40]) + r.choice(["", "\r\n "]) for i in range(0, len(words), 40)] + ["", " "]
    spec = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    spec["normalizer"]["normalizers"].pop()  # capitals stay
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    for path in (tokenizer_path(), str(other)):
        whole = Tokenizer.from_file(path)
        want = [pack_ids(whole.encode(x, add_special_tokens=False).ids) for x in texts]
        t = Tokens(path)
        assert t.encode([x.encode() for x in texts]) == want
        assert t.encode([x.encode() for x in texts[::-1]]) == want[::-1]
        assert [y for i in range(len(texts)) for y in t.encode([texts[i].encode()])] == want


def test_chunks_and_full_tables(monkeypatch):
    """Texts of any number of chunks, with nulls and bytes that are no UTF-8, and tables that are emptied on the way."""
    monkeypatch.setattr(packing, "CHUNK", 50)
    monkeypatch.setattr(packing, "WORDS", 20)
    texts = [b"one two 3", None, b"", b"Two, three's 4!", b"bad \xff\xfe \xc3 end\xe6\xbc", "漢字 é two".encode()] + [b"w%dx y%d \xc3\xa9%d" % (i, i, i) for i in range(60)] + [b"z " * 100, None]
    raw = pa.array(texts, pa.binary())
    text = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())  # unchecked, as Spark's strings are
    b = pa.record_batch([pa.array(range(len(texts))), text], ["doc_id", "text"])
    t, whole = Tokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    want = [pack_ids(whole.encode((x or b"").decode("utf-8", "replace"), add_special_tokens=False).ids) for x in texts]
    chunks = list(packing._chunks(b))
    assert len(chunks) > 10 and [i for c in chunks for i in c.column(0).to_pylist()] == list(range(len(texts)))
    assert [x for c in chunks for x in t.encode_array(c.column(1))] == want
    assert t.encode_array(b.slice(3, 0).column(1)) == [] and t.encode([b" "]) == [b""]
    assert all(c.num_rows == 1 or sum(len(texts[i] or b"") for i in c.column(0).to_pylist()) <= 50 for c in chunks)
