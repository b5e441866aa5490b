"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger reads every character of every text, in overlapping windows. It is trained in numpy on labelled spans: those of
a table that the caller gives, or of made-up texts. A character takes its scores from the window in which it is farthest
from the ends, and the tags are decoded over whole texts: stretches between characters that no best path can tag are
decoded by themselves, which gives the same tags. Only at a batch of windows that ends inside a text, and in stretches of
over LONGEST characters, an O is set where it leads most.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import one_thread

KINDS = ("email", "ip", "card", "phone")
#: What the tagger finds: the kinds of the fixed patterns in other forms too, and keys, tokens and passwords.
TAGGED = (*KINDS, "secret")
#: Characters of a window, and of its way to the next one; windows scored at a time.
WINDOW, STRIDE, BATCH = 256, 224, 384
#: A stretch that stays undecided for so many characters is cut where O leads most in its second half.
LONGEST = 384
#: Rows of a table of labelled texts that are used for training, at most.
MOST_LABELLED = 4000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, since one from the run's first digit would do as well; this keeps it linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an address holds in any form: the sign, or its name between signs or spaces.
_AT = re.compile(r"@|(?<![a-z])at(?![a-z])", re.I)
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping for each kind; matches that fail their
    check are dropped."""
    out = []
    at, p = 0, text.find("@")
    while p >= 0:
        j = p
        while j > at and text[j - 1] in _LOCAL:
            j -= 1
        if j < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((0, j, m.end()))
            at = m.end()
        p = text.find("@", p + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------- labelled texts

_PARTS = "th er on an in re nd he ou ti ea en st it is or te ver ung sch ein que eau ent ion aux ció ado os ar la der ü é ñ".split()
_FAR = ("中文字天地人大小", "абвгдежзик", "αβγδεζηθ", "あいうえおかき", "مرحباسلام")


def labelled_text(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text of words and numbers with the spans in it."""
    pick, below = r.choice, r.randrange
    num = lambda n: "".join(r.choices("0123456789", k=n))
    drawn = lambda chars, n: "".join(r.choices(chars, k=n))
    parts = _PARTS if r.random() < 0.4 else ["".join(r.choices("bcdfghjklmnprstvwz", k=below(3)) + r.choices("aeiouy", k=1 + below(2)) + r.choices("lmnrst", k=below(3))) for _ in range(24)]
    lower, alnum, hexa = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"

    loud = r.random() < 0.1

    def word():
        w = "".join(pick(parts) for _ in range(below(1, 6)))
        x = r.random()
        return w.upper() + "!" * below(3) if loud else w.capitalize() if x < 0.12 else w.upper() if x < 0.15 else f"{w.upper()}-{pick(parts).upper()}" if x < 0.16 else w + pick(("***", "###", "%%", "&&")) if x < 0.17 else drawn(pick(_FAR), below(1, 9)) if x < 0.19 else w

    plain = lambda: re.sub(r"[^a-z]", "x", "".join(pick(parts) for _ in range(below(1, 4))))

    def email():
        a, b, c = plain(), plain(), pick("com org net de fr es io".split())
        a += pick([f".{plain()}", f"{below(1, 99)}", f".{below(1, 99)}", f"_{plain()}", "", ""])
        b += (str(below(9)) if r.random() < 0.3 else "") + (".example" if r.random() < 0.4 else "")
        return pick([f"{a}@{b}.{c}", f"{a}@{b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a} @ {b}.{c}"])

    def ip():
        return pick([".".join(str(below(256)) for _ in range(4))] * 3 + [":".join(drawn(hexa, 4) for _ in range(8))])

    def card():
        n = pick([15, 16, 16, 16, 19])
        d = num(n - 1)
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        sep = pick(["", " ", "-"])
        cuts = [4, 10] if n == 15 else [4, 8, 12, 16]
        return sep.join(d[a:b] for a, b in zip([0, *cuts], [*cuts, n]) if a < n)

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {num(3)} {num(7)}", f"00{below(30, 60)} {num(2)} {num(4)} {num(4)}", f"+{below(30, 60)} {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+1-{a}-{b}-{c}"])

    def secret():
        a = lambda n: drawn(alnum, n)
        return pick([f"AKIA{drawn(alnum[26:], 16)}", f"sk-{a(below(24, 49))}", f"ghp_{a(36)}", f"xoxb-{num(11)}-{a(24)}", drawn(hexa, pick([32, 40, 64])), a(40), f"eyJ{a(30)}.{a(40)}.{a(30)}", a(below(20, 33))])

    def other():
        y = below(1850, 2030)
        return pick([str(y), f"({pick(('about', 'a', 'at', 'as', 'all', 'do', 'not'))} {num(1)} {plain()})", f"({plain()} {plain()})", f"[{plain()}] {plain()}", f"({plain()}", f"{y}-{below(10, 13)}-{below(10, 29)}", f"{below(1, 29)}.{below(1, 13)}.{y}", f"{num(2)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"${num(3)}", f"{num(2)}%", f"no. {num(3)}", f"{num(1)},{num(3)},{num(3)}", f"{num(2)}:{num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{y}-{y + 9}", f"p. {num(3)}-{num(3)}", num(5), num(8), f"({y})", f"@{plain()}", f"{num(4)} {num(2)}", f"https://{plain()}.{plain()}.org/{plain()}/{num(4)}", f"#{drawn(hexa, 6)}", f"{plain()} at {plain()}", "x" * below(3, 40), "=" * below(3, 30), f"{plain()}_{plain()}({num(1)})", " ".join(num(below(1, 6)) for _ in range(6)), num(below(20, 60)), "|".join(num(3) for _ in range(4)), f"{num(2)} {num(3)} {num(3)}", f"{plain()}-{plain()}-{plain()}-{plain()}", f"<{plain()} {plain()}=\"{plain()}\">", (plain() + pick((". ", ". ", ", ", " ", "! "))) * below(3, 24), (pick(parts) + pick((".", "-", "_", "/"))) * below(3, 24)])

    kinds = (email, ip, card, phone, secret)
    lead = (("mail: ", "write to ", "<"), ("host ", "from "), ("card ", "pay with "), ("call ", "tel. ", "Tel: "), ("key=", "api_key: ", "password: ", "token ", "secret = \""))
    text, spans = "", []
    rare = r.random() < 0.5
    for _ in range(below(10, 36)):
        x = r.random()
        if x < (0.02 if rare else 0.14):
            k = below(len(kinds))
            if r.random() < 0.3:
                text += pick(lead[k])
            made = kinds[k]()
            spans.append((k, len(text), len(text) + len(made)))
            text += made
        elif x < 0.45:
            text += other()
        else:
            text += word()
        text += pick([" ", " ", " ", " ", " ", ", ", ". ", "\n", "; "])
    return text, spans


# ---------------------------------------------------------------- the tagger

_SIGNS = " \n.@-+()_%/:,[]=\"'<>#$*|;!?&~"
#: 0 stands before and after a text, 1 to 26 are letters, 27 digits, then the signs, other ASCII, other scripts.
_CLASS = np.full(128, 28 + len(_SIGNS), np.int16)
for _c in range(26):
    _CLASS[97 + _c] = _CLASS[65 + _c] = 1 + _c
_CLASS[48:58] = 27
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 28 + _i
_N_CLASS, _N_TAGS = 30 + len(_SIGNS), 1 + 2 * len(TAGGED)


def char_classes(text: str) -> np.ndarray:
    """Class of each character; capitals are _N_CLASS more than their letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.where(points < 128, _CLASS[np.minimum(points, 127)], np.int16(_N_CLASS - 1))
    return out + np.int16(_N_CLASS) * ((points >= 65) & (points <= 90))


def _log_product(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """log(exp(x) @ factor), row by row."""
    most = x.max(1, keepdims=True)
    return most + np.log(np.exp(x - most) @ factor)


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """Embedding, one LSTM each way, a linear layer to the tags' scores, and CRF transitions; tags are O, B and I. A capital
    has the embedding of its letter plus one for all capitals. The LSTM's gates are hard sigmoids and its other functions
    softsigns, in training too: numpy's tanh took six to eight times as long on a processor without AVX-512."""

    def __init__(self, hidden: int = 14, embed: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        u = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"E": u(_N_CLASS, embed), "C": np.zeros(embed, np.float32), "O": u(2 * hidden, _N_TAGS), "o": np.zeros(_N_TAGS, np.float32), "T": np.zeros((_N_TAGS, _N_TAGS), np.float32)}
        for d in "fb":
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1
            self.p |= {f"{d}W": u(embed, 4 * hidden), f"{d}U": u(hidden, 4 * hidden), f"{d}b": b}

    def embedded(self, codes: np.ndarray) -> np.ndarray:
        high = codes >= _N_CLASS
        return self.p["E"][np.where(high, codes - _N_CLASS, codes)] + high[..., None] * self.p["C"]

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        z = x @ self.p[f"{d}W"] + self.p[f"{d}b"]
        out, kept = np.zeros((n, t, self.h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[:, i] + h @ self.p[f"{d}U"]
            s = np.clip(0.25 * a[:, : 3 * self.h] + 0.5, 0, 1)
            g = _softsign(a[:, 3 * self.h :])
            before, prev = c, h
            c = s[:, self.h : 2 * self.h] * c + s[:, : self.h] * g
            tc = _softsign(c)
            h = s[:, 2 * self.h :] * tc
            out[:, i] = h
            if keep:
                kept.append((i, s, g, before, prev, tc))
        return out, kept

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        n, h = len(x), self.h
        dx = np.zeros_like(x)
        dh = dc = np.zeros((n, h), np.float32)
        for i, s, g, before, prev, tc in reversed(kept):
            dh = dh + dout[:, i]
            a, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dc = dc + dh * o * (1 - np.abs(tc)) ** 2
            da = np.concatenate([dc * g, dc * before, dh * tc, dc * a * (1 - np.abs(g)) ** 2], 1)
            da[:, : 3 * h] *= 0.25 * ((s > 0) & (s < 1))
            grad[f"{d}W"] += x[:, i].T @ da
            grad[f"{d}U"] += prev.T @ da
            grad[f"{d}b"] += da.sum(0)
            dx[:, i] = da @ self.p[f"{d}W"].T
            dh, dc = da @ self.p[f"{d}U"].T, dc * f
        return dx

    def _scan(self, codes: np.ndarray, d: str, out: np.ndarray) -> None:
        """Sets out to the states (step, h, window) of one direction; codes are (step, window). The state and the input are
        multiplied at once; the gates' slope is taken into the weights, and the bias into the input."""
        h, (t, n) = self.h, codes.shape
        table = np.concatenate([self.embedded(np.arange(2 * _N_CLASS)), np.ones((2 * _N_CLASS, 1), np.float32)], 1).T.copy()
        weights = np.concatenate([self.p[f"{d}U"], self.p[f"{d}W"], self.p[f"{d}b"][None]])
        weights[:, : 3 * h] *= 0.25
        weights[-1, : 3 * h] += 0.5
        weights = weights.T.copy()
        both, cell = np.zeros((weights.shape[1], n), np.float32), np.zeros((h, n), np.float32)
        a, below = np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
        state, gates, new = both[:h], a[: 3 * h], a[3 * h :]
        enter, stay, leave = gates[:h], gates[h : 2 * h], gates[2 * h :]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            table.take(codes[i], 1, both[h:], "clip")
            np.matmul(weights, both, out=a)
            np.clip(gates, 0, 1, out=gates)
            np.abs(new, out=below)
            below += 1
            new /= below
            cell *= stay
            enter *= new
            cell += enter
            np.abs(cell, out=below)
            below += 1
            np.divide(cell, below, out=below)
            np.multiply(below, leave, out=state)
            out[i] = state

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores (window, character, tag) of the windows' characters."""
        return self.scores(codes).transpose(2, 0, 1)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Scores (character, tag, window)."""
        steps, h = np.ascontiguousarray(codes.T, np.intp), self.h
        both = np.empty((steps.shape[0], 2 * h, steps.shape[1]), np.float32)
        self._scan(steps, "f", both[:, :h])
        self._scan(steps, "b", both[:, h:])
        out = np.matmul(self.p["O"].T.copy(), both)
        out += self.p["o"][:, None]
        return out

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        p, (n, t) = self.p, codes.shape
        x = self.embedded(codes)
        (hf, kf), (hb, kb) = self._lstm(x, "f", True), self._lstm(x, "b", True)
        both = np.concatenate([hf, hb], 2)
        e = (both @ p["O"] + p["o"]).astype(np.float64)
        trans = p["T"].astype(np.float64)
        factor = np.exp(trans)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = _log_product(alpha[:, i - 1], factor) + e[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = _log_product(beta[:, i + 1] + e[:, i + 1], factor.T)
        most = alpha[:, -1].max(1)
        z = most + np.log(np.exp(alpha[:, -1] - most[:, None]).sum(1))
        rows = np.arange(n)
        gold = e[rows[:, None], np.arange(t), tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows[:, None], np.arange(t), tags] -= 1
        shift = alpha[:, :-1].max(2, keepdims=True)
        left, right = np.exp(alpha[:, :-1] - shift), np.exp((beta + e)[:, 1:] + shift - z[:, None, None])
        pair = (left.reshape(-1, _N_TAGS).T @ right.reshape(-1, _N_TAGS)) * factor
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        de = (de / n).astype(np.float32)
        grad["T"] += (pair / n).astype(np.float32)
        grad["O"] += np.einsum("nth,ntk->hk", both, de)
        grad["o"] += de.sum((0, 1))
        dboth = de @ p["O"].T
        dx = self._lstm_back(x, "f", kf, dboth[:, :, : self.h], grad) + self._lstm_back(x, "b", kb, dboth[:, :, self.h :], grad)
        high = codes >= _N_CLASS
        np.add.at(grad["E"], np.where(high, codes - _N_CLASS, codes), dx)
        grad["C"] += dx[high].sum(0)
        return float((z - gold).mean()), grad

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 6, size: int = 96, rate: float = 0.022, seed: int = 3) -> float:
        r = np.random.default_rng(seed)
        m, v, step, loss = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0, 0.0
        total = epochs * (len(codes) // size)
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for a in range(0, len(codes) - size + 1, size):
                loss, grad = self.gradient(codes[order[a : a + size]], tags[order[a : a + size]])
                norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))) / 5)
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in grad.items():
                    g = g / norm
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.98 * v[k] + 0.02 * g**2
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
        return loss

    def undecided(self, lead: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which characters may be of another tag than O in a best path, from the lead of each one's best other tag over O.

        A run of other tags is worth no more than its leads, the best transition between others, and the best ones from and
        to O. A best path has no run worth less than O's, so that a character in no run of at least that bound is O; the best
        bound of the runs through a character comes from running sums. first and last are places where texts begin and
        end, which need no transition from or to O."""
        t = self.p["T"].astype(np.float64)
        stay, enter, leave = t[1:, 1:].max() - t[0, 0], t[0, 1:].max() - t[0, 0], t[1:, 0].max() - t[0, 0]
        worth = lead + stay
        worth[first] -= min(enter, 0)
        worth[last] -= min(leave, 0)
        sums = np.concatenate([[0], np.cumsum(worth)])
        most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        return most >= stay - enter - leave - 1e-3

    def viterbi(self, e: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best tags of padded rows of scores; what is past a row's length is O. first and last say whether a row begins or
        ends its text; else an O stands before or after it."""
        (n, t, k), trans, rows = e.shape, self.p["T"], np.arange(len(e))
        steps = np.ascontiguousarray(e.transpose(1, 2, 0))
        scores = np.empty((t, k, n), np.float32)
        scores[0] = steps[0] + np.where(first, 0, trans[0][:, None])
        for i in range(1, t):
            scores[i] = (scores[i - 1][:, None] + trans[:, :, None]).max(0)
            scores[i] += steps[i]
        out = np.zeros((n, t), np.int64)
        tag, closing = np.zeros(n, np.int64), trans[:, :1] * ~last
        for i in range(t - 1, -1, -1):
            ends, goes = i == lengths - 1, i < lengths - 1
            got = (scores[i] + np.where(ends, closing, trans[:, tag])).argmax(0)
            tag = np.where(ends | goes, got, 0)
            out[rows, i] = tag
        return out


def windows_of(texts: list[tuple[str, list[tuple[int, int, int]]]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of one window of each labelled text, at a place drawn at random."""
    r = np.random.default_rng(seed)
    codes, tags = np.zeros((len(texts), _TRAIN), np.int64), np.zeros((len(texts), _TRAIN), np.int64)
    for i, (text, spans) in enumerate(texts):
        tag = np.zeros(len(text), np.int64)
        for k, a, b in spans:
            tag[a:b] = 2 + 2 * k
            tag[a : a + 1] = 1 + 2 * k
        at = int(r.integers(0, max(1, len(text) - _TRAIN // 2)))
        c = char_classes(text)[at : at + _TRAIN]
        codes[i, : len(c)], tags[i, : len(c)] = c, tag[at : at + _TRAIN]
    return codes, tags


#: Characters of a training window.
_TRAIN = 80


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    return windows_of([labelled_text(r) for _ in range(n)], seed)


@functools.cache
def trained(windows: int = 4096, seed: int = 21) -> Tagger:
    """Trained once a process on a fixed number of made-up windows."""
    t = Tagger()
    t.fit(*training_windows(windows, seed), epochs=8)
    return t


def trained_on(labelled: DataFrame, most: int = MOST_LABELLED, seed: int = 21) -> Tagger:
    """A tagger trained on labelled(text, spans: array of (kind, start, end) in code points): `most` rows at most, those of the
    least hashes of their texts. Spans of kinds other than TAGGED's are passed over."""
    rows = labelled.where("text is not null").orderBy(F.xxhash64("text"), "text").limit(most).select("text", "spans").collect()
    texts = [(r.text, [(TAGGED.index(s[0]), s[1], s[2]) for s in r.spans or [] if s[0] in TAGGED]) for r in rows]
    t = Tagger()
    if texts:
        codes, tags = windows_of(texts, seed)
        t.fit(codes, tags, epochs=max(9, 24 * 128 * 9 // max(len(texts), 1) if len(texts) < 3072 else 9), size=min(128, len(texts)))
    return t


# ---------------------------------------------------------------- texts to spans


#: Lead of the place between two texts, which no run crosses.
_APART = -1e5


def _cut(start: int, lead: np.ndarray) -> list[tuple[int, int]]:
    """Parts of an undecided stretch; one of over LONGEST characters is cut where O leads most."""
    out, at = [], 0
    while len(lead) - at > LONGEST:
        where = at + LONGEST // 2 + int(lead[at + LONGEST // 2 : at + LONGEST].argmin())
        out.append((start + at, start + where))
        at = where + 1
    return [*out, (start + at, start + len(lead))]


class _Batch:
    """Undecided stretches of the windows scored so far. Of a text that goes on the last characters, from one where O leads
    most, are kept for the next windows."""

    def __init__(self, tagger: Tagger, sizes: list[int]):
        self.tagger, self.sizes = tagger, sizes
        self.ready: list[tuple[int, int, np.ndarray, bool, bool]] = []
        self.kept: tuple[int, int, np.ndarray] | None = None

    def add(self, e: np.ndarray, jobs: list[tuple[int, int, int, int]]) -> None:
        """Scores (character, tag, window) of windows (text, start, first own character, end of the own ones)."""
        lead = e[:, 1].copy()
        for k in range(2, _N_TAGS):
            np.maximum(lead, e[:, k], out=lead)
        lead = np.ascontiguousarray((lead - e[:, 0]).T)
        # flat: the kept characters, then each window's own ones, with a place before every text
        flat, where, texts = [], [], []  # leads; window and character of each; (text, its start in flat, start in the text)
        size, text = 0, -1
        if self.kept:
            text, start, scores = self.kept
            flat, where, size = [scores[:, 1:].max(1) - scores[:, 0]], [np.full(len(scores), -1)], len(scores)
            texts.append((text, 0, start))
        for j, (i, at, a, b) in enumerate(jobs):
            if i != text:
                flat.append(np.float32([_APART]))
                where.append(np.int64([-1]))
                size, text = size + 1, i
                texts.append((i, size, at + a))
            flat.append(lead[j, a:b])
            where.append(np.arange(j * WINDOW + a, j * WINDOW + b))
            size += b - a
        flat, where = np.concatenate(flat).astype(np.float64), np.concatenate(where)
        starts = np.array([t[1] for t in texts])
        ends = np.append(starts[1:] - 1, size)
        begins = np.array([t[2] == 0 for t in texts])
        whole = np.array([t[2] + z - a == self.sizes[t[0]] for t, a, z in zip(texts, starts, ends)])

        def scores(a: int, b: int) -> np.ndarray:
            w = where[a:b]
            out = e[w % WINDOW, :, w // WINDOW]
            if self.kept and a < len(self.kept[2]):
                out[w < 0] = self.kept[2][a:b]
            return out

        new, stop = None, size
        if not whole[-1]:  # the last text goes on
            a = max(int(starts[-1]), size - LONGEST)
            stop = a + int(flat[a : a + max((size - a) // 2, 1)].argmin())
            new = (text, texts[-1][2] + stop + 1 - int(starts[-1]), scores(stop + 1, size))
        unsure = self.tagger.undecided(flat[:stop], starts[begins & (starts < stop)], ends[whole] - 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], unsure.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            t = int(np.searchsorted(starts, a, "right")) - 1
            shift = texts[t][2] - int(starts[t])
            for x, y in _cut(a, flat[a:b]):
                if y > x:
                    self.ready.append((texts[t][0], x + shift, scores(x, y), x + shift == 0, y + shift == self.sizes[texts[t][0]]))
        self.kept = new


def tag_texts(tagger: Tagger, texts: list[str]):
    """(text, start, tags) of the stretches of all texts that aren't certainly O, in no fixed order."""
    edge, codes = (WINDOW - STRIDE) // 2, np.zeros((BATCH, WINDOW), np.int16)
    held, jobs = _Batch(tagger, [len(t) for t in texts]), []
    for i, t in enumerate(texts):
        own = char_classes(t)
        for at in range(0, max(len(own) - (WINDOW - STRIDE), 1) if len(own) else 0, STRIDE):
            part = own[at : at + WINDOW]
            codes[len(jobs), : len(part)], codes[len(jobs), len(part) :] = part, 0
            jobs.append((i, at, edge if at else 0, len(part) if at + WINDOW >= len(own) else WINDOW - edge))
            if len(jobs) == BATCH:
                held.add(tagger.scores(codes), jobs)
                jobs.clear()
                if len(held.ready) > 2000:
                    yield from _decoded(tagger, held)
    if jobs:
        held.add(tagger.scores(codes[: len(jobs)]), jobs)
    yield from _decoded(tagger, held)


def _decoded(tagger: Tagger, held: _Batch):
    some, held.ready = sorted(held.ready, key=lambda s: len(s[2])), []
    at = 0
    while at < len(some):
        rows = some[at : at + max(1, min(512, 200_000 // len(some[min(at + 511, len(some) - 1)][2])))]
        at += len(rows)
        lengths = np.array([len(r[2]) for r in rows])
        e = np.zeros((len(rows), int(lengths.max()), _N_TAGS), np.float32)
        for j, r in enumerate(rows):
            e[j, : lengths[j]] = r[2]
        for r, tags in zip(rows, tagger.viterbi(e, lengths, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]))):
            yield r[0], r[1], tags[: len(r[2])]


def spans_of(tags: np.ndarray, start: int) -> list[tuple[int, int, int]]:
    """(kind, start, end): a B and the I of its kind that follow."""
    if not tags.any():
        return []
    out, at = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        if at is not None and (t == 0 or t % 2 == 1 or t != at[1] + 1):
            out.append(((at[1] - 1) // 2, start + at[0], start + i))
            at = None
        if t and t % 2 == 1:
            at = (i, t)
    return out


def find_all(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """For each text the spans of the fixed patterns and all spans, by kind and start. A span of the tagger is left out if
    it overlaps one of a pattern, since that stays, or if a check shows that it isn't of its kind: a card's number passes Luhn,
    an address holds an @ or the word at. Outer white space, closing punctuation and quotes aren't part of it."""
    known = [sorted(base_spans(t)) if _TRIGGER.search(t) else [] for t in texts]
    taken = [_union([(a, b) for _, a, b in k]) for k in known]
    every = [list(k) for k in known]
    for i, start, tags in tag_texts(tagger, texts):
        for k, s, e in spans_of(tags, start):
            own = texts[i][s:e]
            s += len(own) - len(own.lstrip())
            e -= len(own) - len(own.rstrip(" .,;\"'\n\t\r"))
            before = bisect.bisect_left(taken[i], (e,)) - 1
            if k == 2 and not luhn(_digits(texts[i][s:e])) or k == 0 and not _AT.search(texts[i], s, e):
                continue
            if s < e and not (before >= 0 and taken[i][before][1] > s):
                every[i].append((k, s, e))
    return [(k, sorted(e)) for k, e in zip(known, every)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("n_added", pa.int64()), ("base", pa.string()), ("spans", pa.string())])
_OUT_T = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base string, spans string"


def _find(shared):
    def run(batches):
        one_thread()
        tagger = shared.value
        written = lambda s: ",".join(f"{TAGGED[k]}:{a}:{b}" for k, a, b in s)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = find_all(tagger, [t or "" for t in part.column(1).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, added, pa.array([written(x) for x, _ in found]), pa.array([written(x) for _, x in found])], schema=_OUT)

    return run


def personal_data(docs: DataFrame, labelled: DataFrame | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_email, n_ip, n_card, n_phone (of the fixed
    patterns), n_added (spans of the tagger), base (the patterns' spans) and spans (those and the tagger's), written
    kind:start:end by kind and start, joined by commas; places are code points, ends exclusive.

    With labelled(text, spans) the tagger is trained on most_labelled of its rows at most (see trained_on), else on a fixed
    number of made-up texts. It reads all texts whole. A null text is empty and has no spans. Of a text only the undecided
    stretches are held, and those of over LONGEST characters are cut, so that very long texts take memory for their
    characters and their spans, and time in proportion. A span of the tagger that overlaps one of a pattern is left out. Rows are
    judged one by one, repeated ones and null doc_ids too; an empty table gives an empty result."""
    tagger = trained() if labelled is None else trained_on(labelled, most_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_find(shared), _OUT_T)
