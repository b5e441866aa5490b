from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from citespark.llm.pii import KINDS, STRIDE, TAGGED, WINDOW, Tagger, _digits, base_spans, char_classes, find_all, labelled_text, luhn, personal_data, spans_of, tag_texts, trained, trained_on, training_windows
from citespark.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    t = t or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))]
    return sorted(out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15])


def test_base_spans_match_the_patterns(documents):
    r = random.Random(3)
    texts = ["".join(r.choice("aZ@@..-+0123456789 ()%é\n") for _ in range(r.randint(0, 60))) for _ in range(8000)]
    texts += [x.text for x in documents.collect()] + ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (2) 3-4-5-6-7-8", "4111 1111-1111 1111"]
    for t in texts:
        assert sorted(base_spans(t)) == brute(t)


def test_patterns_stay_linear():
    for t in ("1" * 200_000, "a" * 200_000, "+1" + "(" * 200_000, "@" * 100_000, "1." * 100_000, "a." * 100_000 + "@x"):
        base_spans(t)


def test_query(spark, data, documents):
    got = {r.doc_id: r for r in QUERIES["op7_personal_data"](spark, data).collect()}
    for r in documents.collect():
        b = brute(r.text)
        written = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in b)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x[0] == k for x in b) for k in range(4)]
        assert set(written.split(",")) - {""} <= set(g.spans.split(","))


def test_held_out_accuracy():
    m, r = trained(), random.Random(123)
    hits = found = real = 0
    for _ in range(300):
        text, spans = labelled_text(r)
        ((_, every),) = find_all(m, [text])
        hits, found, real = hits + len(set(every) & set(spans)), found + len(every), real + len(spans)
    assert hits / found > 0.85 and hits / real > 0.75
    text = "call (555) 123-4567 now, or pay 12.50 for 3 of 2019-2021"
    ((_, every),) = find_all(m, [text])
    assert [(k, text[a:b]) for k, a, b in every] == [(3, "(555) 123-4567")]


def test_clean_prose_has_no_spans():
    text = "The garden was open from May to June 2019, and 1,250 people came at noon. Chapter 12, p. 34-35, costs $9.50 (about 8 euros).\n" * 40
    ((base, every),) = find_all(trained(), [text])
    assert not base and len(every) <= 2


def test_gradient():
    t = Tagger(4, 3)
    codes, tags = training_windows(3, 1)
    _, grad = t.gradient(codes, tags)
    for name in ("E", "fU", "bW", "O", "T"):
        at = tuple(int(i) for i in np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape))
        keep, eps = float(t.p[name][at]), 1e-2
        losses = []
        for v in (keep + eps, keep - eps):
            t.p[name][at] = v
            losses.append(t.gradient(codes, tags)[0])
        t.p[name][at] = keep
        assert abs((losses[0] - losses[1]) / (2 * eps) - grad[name][at]) < 0.05 * abs(grad[name][at]) + 0.02


def best_path(t, e):
    """Plain Viterbi over a whole text."""
    score, back = e[0].astype(float), []
    for x in e[1:]:
        every = score[:, None] + t.p["T"]
        back.append(every.argmax(0))
        score = every.max(0) + x
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def test_viterbi_against_all_paths():
    t = Tagger(4, 3)
    r, k = np.random.default_rng(2), 1 + 2 * len(TAGGED)
    t.p["T"] = r.standard_normal(t.p["T"].shape).astype(np.float32)
    e = r.standard_normal((1, 4, k)).astype(np.float32)
    import itertools

    best = max(itertools.product(range(k), repeat=4), key=lambda p: sum(e[0, i, x] for i, x in enumerate(p)) + sum(t.p["T"][a, b] for a, b in zip(p, p[1:])))
    whole = np.ones(1, bool)
    assert t.viterbi(e, np.array([4]), whole, whole)[0].tolist() == list(best) == best_path(t, e[0])
    inner = t.viterbi(e, np.array([4]), ~whole, ~whole)[0].tolist()
    zero = np.zeros((1, k), np.float32) - 1e6
    zero[0, 0] = 0
    assert inner == best_path(t, np.concatenate([zero, e[0], zero]))[1:-1]


def test_stretches_give_the_best_path_of_the_text():
    """What is decoded in stretches is what one pass over the whole text gives."""
    m, r = trained(), random.Random(5)
    texts = [labelled_text(r)[0] for _ in range(60)]
    got: dict = {}
    for i, start, tags in tag_texts(m, texts):
        got.setdefault(i, []).extend(spans_of(tags, start))
    for i, text in enumerate(texts):
        if len(text) > WINDOW:
            continue
        codes = np.zeros((1, WINDOW), np.int16)
        codes[0, : len(text)] = char_classes(text)
        assert sorted(got.get(i, [])) == sorted(spans_of(np.array(best_path(m, m.emissions(codes)[0, : len(text)])), 0))


def test_windows_are_joined():
    m = trained()
    text = "pay 12 or 345 then 99 " * 30 + "write to jo.do7 [at] mail [dot] org today 5 times " + "and 7 more 88 " * 30
    ((_, every),) = find_all(m, [text])
    a = text.index("jo.do7")
    assert len(text) > 4 * WINDOW and any(k == 0 and s < a + 10 and e > a + 20 for k, s, e in every)


def test_very_long_table_of_numbers():
    """Memory is that of the characters and spans, whatever the text holds."""
    import tracemalloc

    r = random.Random(1)
    text = "\n".join(" ".join(str(r.randrange(10**6)) for _ in range(12)) for _ in range(20_000))
    m = trained()
    tracemalloc.start()
    find_all(m, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 1_500_000 and peak < 300e6


def test_trained_on_given_labels(spark):
    """Another form of phone, learned from the caller's labels."""
    r = random.Random(2)
    rows = []
    for _ in range(400):
        a = " ".join(r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(r.randrange(1, 6)))
        p = f"T{r.randrange(10**5):05d}/{r.randrange(10**3):03d}"
        rows.append((f"{a} {p} {a}", [("phone", len(a) + 1, len(a) + 1 + len(p)), ("other", 0, 1)]))
    rows.append((None, None))
    labelled = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")
    m = trained_on(labelled)
    ((_, every),) = find_all(m, ["sit dolor T12345/678 ipsum"])
    assert every == [(3, 10, 20)]
    assert find_all(trained_on(labelled.limit(0)), ["x"])[0][0] == []


def test_awkward_rows(awkward, no_docs):
    got = personal_data(awkward).collect()
    assert len(got) == awkward.count() and all(r.spans == "" for r in got if r.doc_id in (2, 3, 4, 7, 8))
    assert personal_data(no_docs).count() == 0


def test_long_texts_give_the_best_path():
    """Texts of many windows: the spans of one pass over the joined scores of their windows."""
    m, r = trained(), random.Random(11)
    texts = [" ".join(labelled_text(r)[0] for _ in range(r.randrange(1, 9))) for _ in range(25)] + ["", "x"]
    got: dict = {}
    for i, start, tags in tag_texts(m, texts):
        got.setdefault(i, []).extend(spans_of(tags, start))
    edge = (WINDOW - STRIDE) // 2
    for i, text in enumerate(texts):
        own, e = char_classes(text), []
        for at in range(0, max(len(own) - 2 * edge, 1) if len(own) else 0, STRIDE):
            codes = np.zeros((1, WINDOW), np.int16)
            codes[0, : len(own[at : at + WINDOW])] = own[at : at + WINDOW]
            ends = len(own) - at if at + WINDOW >= len(own) else WINDOW - edge
            e.extend(m.emissions(codes)[0, edge if at else 0 : ends])
        want = spans_of(np.array(best_path(m, np.array(e))), 0) if e else []
        assert len(e) == len(text) and sorted(got.get(i, [])) == sorted(want)


def test_repeated_words_are_no_addresses():
    text = "Edble. " * 30 + "of " * 40 + "dieverbepf, " * 9
    assert find_all(trained(), [text]) == [([], [])]


def test_scores_are_those_of_training_without_costly_functions(monkeypatch):
    """The states that the gradient is taken of, without a tanh or exp, which made up most of the time of scoring."""
    t = Tagger(6, 4)
    codes, _ = training_windows(20, 2)
    t.p["C"] += 0.5
    x = t.embedded(codes)
    want = np.concatenate([t._lstm(x, d, False)[0] for d in "fb"], 2) @ t.p["O"] + t.p["o"]

    def costly(*_, **__):
        raise AssertionError("a costly function of every character")

    for name in ("tanh", "exp", "exp2", "log"):
        monkeypatch.setattr(np, name, costly)
    assert np.abs(t.emissions(codes) - want).max() < 1e-4


def test_closing_quotes_are_no_part_of_a_key(monkeypatch):
    text = "token = \"9f14a7029c85\" here"
    a, b = text.index("9"), text.index(" here")
    tags = np.array([9] + [10] * (b - a - 1))
    monkeypatch.setattr("citespark.llm.pii.tag_texts", lambda *_: [(0, a, tags)])
    assert find_all(Tagger(4, 3), [text]) == [([], [(4, a, b - 1)])]
