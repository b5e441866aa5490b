"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path) and what becomes of URLs on the host or a subdomain whose path starts so; the longest rule wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "longest_label", "upper_ratio", "escapes", "suffix_rate", "address")

#: Rows of a table of labelled URLs that are used for training, at most.
MOST_LABELLED = 20_000

#: Suffixes of made-up URLs and their shares, of wanted and of unwanted ones.
_SUFFIX = {0: ("com org net edu de fr es io".split(), (30, 20, 12, 8, 8, 7, 7, 8)), 1: ("com net org info xyz top biz click".split(), (26, 14, 10, 12, 12, 10, 8, 8))}


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule, as host and path in one string, that fits; null for none."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def labelled_urls(n: int = 4000, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Made-up URLs with labels, 1 for unwanted ones; all their names are random syllables, so that only their form can be
    learned: unwanted hosts are longer, with more hyphens, digits and odd suffixes, unwanted queries have more parameters."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[r.integers(len(x))]
    name = lambda: "".join(pick("bcdfghjklmnprstvwz") + pick("aeiou") + (pick("lmnrst") if r.random() < 0.4 else "") for _ in range(r.integers(1, 4)))
    urls, labels = [], []
    for i in range(n):
        bad = int(i % 3 == 0)
        if bad:
            parts = [name() for _ in range(r.integers(2, 4))]
            if r.random() < 0.3:
                parts[-1] += str(r.integers(10, 9999))
            domain = ("-" if r.random() < 0.75 else "").join(parts)
        else:
            domain = name() + (name() if r.random() < 0.4 else "")
            if r.random() < 0.06:
                domain += "-" + name()
        host = [] if r.random() < 0.4 else [pick(["www", "m", "blog"] if r.random() < 0.8 or not bad else [name()])]
        host += [domain] + (["example"] if r.random() < 0.4 else []) + [str(r.choice(_SUFFIX[bad][0], p=np.array(_SUFFIX[bad][1]) / sum(_SUFFIX[bad][1])))]
        if bad and r.random() < 0.04:
            host = [str(x) for x in r.integers(1, 255, 4)]
        path = "/" + pick("en fr de es".split()) if r.random() < 0.5 else ""
        for _ in range(r.integers(0, 4)):
            path += "/" + (str(r.integers(1, 99999)) if r.random() < 0.5 else name() + ("-" + name() if r.random() < (0.5 if bad else 0.2) else ""))
        path += pick(["", "/", ".html"])
        query = ""
        if r.random() < (0.5 if bad else 0.3):
            query = "?" + "&".join(f"{name()}={r.integers(1, 10 ** r.integers(1, 8)) if r.random() < 0.6 else name()}" for _ in range(r.integers(1, 6 if bad else 3)))
        urls.append(f"{pick(['http', 'https'])}://{'.'.join(host)}{path}{query}{'#' + name() if r.random() < 0.15 else ''}")
        labels.append(bad)
    return urls, np.array(labels)


class Rates:
    """Smoothed share of unwanted training URLs by host suffix."""

    def __init__(self, urls: list[str], labels: np.ndarray, weight: float = 8.0):
        self.mean = float(labels.mean()) if len(labels) else 0.0
        seen: dict[str, list[float]] = {}
        for u, y in zip(urls, labels):
            s = seen.setdefault(self.suffix(u), [0.0, 0.0])
            s[0] += y
            s[1] += 1
        self.table = {k: (a + weight * self.mean) / (b + weight) for k, (a, b) in seen.items() if b >= 3}

    @staticmethod
    def suffix(url: str) -> str:
        return re.match(r"[^/?#]*", url.partition("://")[2])[0].rpartition(".")[2].lower()

    def of(self, url: str) -> float:
        return self.table.get(self.suffix(url), self.mean)


def features(urls: list[str], rates: Rates) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)))
    for i, u in enumerate(urls):
        rest = u.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path, _, query = rest[len(host) :].partition("?")
        labels = host.split(".")
        n = max(len(rest), 1)
        _, counts = np.unique(np.frombuffer(rest.encode("utf-32-le", "replace"), "<u4"), return_counts=True) if rest else (0, np.ones(1))
        p = counts / counts.sum()
        out[i] = (len(rest), len(host), path.strip("/").count("/") + bool(path.strip("/")), sum(map(str.isdigit, rest)) / n, -(p * np.log2(p)).sum(), query.count("=") + query.count("&") if query else 0, len(labels), host.count("-"), max(map(len, labels)), sum(map(str.isupper, rest)) / n, rest.count("%"), rates.of(u), bool(re.fullmatch(r"[\d.]+", host)))
    return out


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss, split at quantiles of the training values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.depth, self.cuts = depth, [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        code = self._code(x)
        base = np.clip(y.mean() if len(y) else 0, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(base / (1 - base))), []
        score = np.full(len(y), self.base)
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), int), []
            for level in range(depth):
                for k in range(1 << level):
                    at = (1 << level) - 1 + k
                    rows = np.flatnonzero(node == at)
                    best, split = 1e-6, (0, bins)  # all to the left
                    for f in range(x.shape[1]):
                        gs, hs = (np.cumsum(np.bincount(code[rows, f], w[rows], bins)) for w in (g, h))
                        if len(rows):
                            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                            if gain.max() > best:
                                best, split = gain.max(), (f, int(gain.argmax()))
                    splits.append(split)
                    node[rows] = 2 * at + 1 + (code[rows, split[0]] > split[1])
            leaf = node - ((1 << depth) - 1)
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
            self.trees.append((splits, value))
            score += value[leaf]

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        code, rows = self._code(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for splits, value in self.trees:
            f, t = (np.array(s) for s in zip(*splits))
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (code[rows, f[node]] > t[node])
            score += value[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-score))


def fitted(urls: list[str], y: np.ndarray) -> tuple[Rates, Trees]:
    """The suffixes' rates come from other rows than the trees', or the trees would trust the rates too much."""
    rates = Rates(urls[::2], y[::2])
    return rates, Trees(features(urls[1::2], rates), y[1::2].astype(float))


@functools.cache
def model(n: int = 4000, seed: int = 11) -> tuple[Rates, Trees]:
    """Trained once a process, on a fixed number of made-up labelled URLs; its size doesn't follow the data."""
    return fitted(*labelled_urls(n, seed))


def model_of(labelled: DataFrame, most: int = MOST_LABELLED) -> tuple[Rates, Trees]:
    """Trained on labelled(url, label: 1 or true for unwanted ones): `most` rows at most, those of the least hashes of their
    URLs. Rows without a url or label don't count; of fewer than two rows nothing is learned, and all URLs are allowed."""
    rows = labelled.select("url", F.col("label").cast("int").alias("label")).where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()
    return fitted([r.url for r in rows], np.array([int(r.label > 0) for r in rows]))


def _judge(shared):
    def run(batches):
        rates, trees = shared.value
        for b in batches:
            fits = b.column("rule").is_null().to_numpy(zero_copy_only=False)
            score = np.zeros(b.num_rows)
            if fits.any():
                urls = b.column("url").filter(pa.array(fits)).to_pylist()
                score[fits] = trees.probability(features([u or "" for u in urls], rates))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("page_id", "host", "path", "rule")), pa.array(score, mask=~fits)], names=["page_id", "host", "path", "rule", "score"])

    return run


def judged_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, labelled: DataFrame | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Per row of pages (page_id, url; other columns are ignored): page_id, host, path, rule, score, verdict.

    verdict is the rule's, or by the trees' score block from the threshold on; score is null where a rule fits. The trees are
    trained on labelled(url, label), most_labelled of its rows at most, or else on made-up URLs. A null url,
    or one without ://, has an empty host and path, no rule, and is judged by the score of an empty text. Rows are judged
    one by one; an empty table gives an empty result."""
    trained = model() if labelled is None else model_of(labelled, most_labelled)
    shared = pages.sparkSession.sparkContext.broadcast(trained)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = own.mapInArrow(_judge(shared), "page_id long, host string, path string, rule string, score double")
    says = F.lit(None).cast("string")
    for h, p, verdict in rules:
        says = F.when(F.col("rule") == h + p, F.lit(verdict)).otherwise(says)
    return out.withColumn("verdict", F.coalesce(says, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
