"""URL filter: listed rules first, gradient-boosted trees for the rest.

A rule is a host with a path prefix; it fits the host and its subdomains where
the path starts with the prefix, and the longest fitting rule decides.  Other
URLs are judged by boosted trees on lexical features, trained on labelled URLs:
lengths, depth, digit ratios, entropy, counts of parameters, hyphens and
labels, and the smoothed rate of blocked URLs under the host's suffix.

Labels come as a table (``fit_on``: url, label) or, where there is none, from a
list of host words as in public blocklists (``word_label``).  The sample is
bounded and as large for either label; whole sites are held out of the fit
(``HELD_OUT`` of 10, by a hash of the site's name), so ``agreement`` tells how
the trees do on sites that they have never seen.

The trees are fitted in numpy; rules and trees are parameters of one pass over
the table, without a shuffle.

Edge cases: a null URL or one without "://" has an empty host and path, fits no
rule and is judged by its features; null labels are left out; ties between equal
features share a leaf; repeated rows are judged alike; further columns are
ignored, whatever their names; with no labelled URL, or labels of one kind only,
everything else is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import seeded_sample

OUT = "page_id long, host string, path string, rule string, verdict string, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Parts of host names that mark a URL as labelled "block".
BLOCKED_WORDS = frozenset("ads adult advert adserver bet bets betting casino cheap doubleclick farm gambling loans pills poker porn sex spam spammer track tracker viagra warez xxx".split())
#: So many tenths of the sites are held out of the fit.
HELD_OUT = 2


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


class Rules:
    """Rules as "host/path" with "block" or "allow"."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest that fits."""
        best: tuple[str, str] | None = None
        suffix = host
        while suffix:
            for prefix, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            suffix = suffix.partition(".")[2]
        return best


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffix_of(host: str) -> str:
    return host.rpartition(".")[2]


def features(url: str | None, suffixes: dict[str, float], prior: float) -> list[float]:
    host, path = split_url(url)
    query = (url or "").partition("?")[2].partition("#")[0]
    labels = host.split(".")
    digits = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
    return [
        len(url or ""),
        len(host),
        len(path),
        len([p for p in path.split("/") if p]),
        digits(host),
        digits(path),
        entropy(host),
        entropy(path),
        len([p for p in query.split("&") if p]),
        host.count("-"),
        len(labels),
        max(map(len, labels)),
        suffixes.get(suffix_of(host), prior),
    ]


@dataclass
class Trees:
    """Boosted trees as flat arrays; a leaf has feature -1."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    suffixes: dict[str, float]
    prior: float

    def score(self, urls: list[str | None]) -> np.ndarray:
        z = np.full(len(urls), self.base)
        if self.trees and urls:
            x = np.array([features(u, self.suffixes, self.prior) for u in urls])
            for feature, cut, left, right, value in self.trees:
                node = np.zeros(len(urls), dtype=np.int64)
                while (inner := feature[node] >= 0).any():
                    low = x[np.arange(len(urls)), np.maximum(feature[node], 0)] <= cut[node]
                    node = np.where(inner, np.where(low, left[node], right[node]), node)
                z += value[node]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_trees(urls: list[str | None], labels: list[int], *, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 3) -> Trees:
    """Gradient boosting with the logistic loss on binned features."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Trees(-5.0, [], {}, 0.0)
    prior = float(y.mean())
    sums: dict[str, list[float]] = {}
    for u, label in zip(urls, labels, strict=True):
        s = sums.setdefault(suffix_of(split_url(u)[0]), [0.0, 0.0])
        s[0] += label
        s[1] += 1
    suffixes = {k: (a + 20 * prior) / (n + 20) for k, (a, n) in sums.items()}
    x = np.array([features(u, suffixes, prior) for u in urls])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = math.log(prior / (1 - prior))
    z = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, left_depth: int, g=g, h=h, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, rate * g[rows].sum() / (h[rows].sum() + 1)])
            best = (1e-6, -1, -1)
            if left_depth and len(rows) >= 2 * least:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    size = len(c) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(b, weights=v, minlength=size))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                    gain[(ns < least) | (len(rows) - ns < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                low = binned[rows, best[1]] <= best[2]
                nodes[at][:2] = [best[1], float(cuts[best[1]][best[2]])]
                nodes[at][2] = grow(rows[low], left_depth - 1)
                nodes[at][3] = grow(rows[~low], left_depth - 1)
            return at

        grow(np.arange(len(y)), depth)
        t = np.array(nodes)
        tree = (t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4])
        trees.append(tree)
        z = z + _walk(tree, x)
    return Trees(base, trees, suffixes, prior)


def _walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = tree
    node = np.zeros(len(x), dtype=np.int64)
    while (inner := feature[node] >= 0).any():
        low = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
        node = np.where(inner, np.where(low, left[node], right[node]), node)
    return value[node]


def word_label(url: Column) -> Column:
    """Distant label of a URL: 1 if a part of its host is a blocked word."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.when(at > 0, F.substr(url, at + 3)).otherwise(""), r"^[^/?#]*", 0)
    return F.coalesce(F.arrays_overlap(F.split(F.lower(host), "[.-]"), F.array(*map(F.lit, sorted(BLOCKED_WORDS)))).cast("int"), F.lit(0))


def site_of(url: str | None) -> str:
    """The registered name that a URL's host belongs to: its last three labels, as in name.example.com."""
    return ".".join(split_url(url)[0].split(".")[-3:])


def held_out(url: str | None) -> bool:
    return zlib.crc32(site_of(url).encode()) % 10 < HELD_OUT


def labelled_urls(urls: DataFrame, *, sample: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """At most ``sample`` different (url, label) of each label, the first in the order of a seeded hash."""
    known = urls.filter(F.col("label").isin(0, 1) & F.col("url").isNotNull()).groupBy("url").agg(F.max("label").cast("int").alias("label"))
    return sorted((r["url"], r["label"]) for r in seeded_sample(known, "label", ["url"], sample, seed).collect())


def fit_on(urls: DataFrame, **options) -> Trees:
    """Trees for labelled URLs (url, label), without those of held-out sites."""
    known = [(u, y) for u, y in labelled_urls(urls, **options) if not held_out(u)]
    return fit_trees([u for u, _ in known], [y for _, y in known])


def agreement(urls: DataFrame, trees: Trees, **options) -> dict[int, tuple[int, int]]:
    """By label: (URLs judged as labelled, all), on the sites held out of the fit."""
    known = [(u, y) for u, y in labelled_urls(urls, **options) if held_out(u)]
    said = trees.score([u for u, _ in known]) >= 0.5
    return {label: (sum(int(s) == y for s, (_, y) in zip(said, known, strict=True) if y == label), sum(y == label for _, y in known)) for label in (0, 1)}


def judge(pages: DataFrame, rules: list[tuple[str, str]], trees: Trees, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row."""
    listed = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            scores = trees.score(urls)
            parts = [split_url(u) for u in urls]
            found = [listed.match(*p) for p in parts]
            verdicts = [m[1] if m else "block" if s >= 0.5 else "allow" for m, s in zip(found, scores, strict=True)]
            text = lambda values: pa.array(values, pa.string())
            columns = [batch.column(0), text([h for h, _ in parts]), text([p for _, p in parts]), text([m[0] if m else None for m in found]), text(verdicts), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, OUT)
