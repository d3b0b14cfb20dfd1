"""Toxicity classifier with a counterfactual penalty.

A logistic model over the distinct words of a text and their first letters (four
to six of them, so that endings don't hide a stem).  Beside the labelled loss
it is charged for every change of score between a labelled sentence and the
same sentence with an identity term put in another's place (or, where the
sentence names no group, with and without a mention).  Terms that only name a
group thus end with equal weights near zero, and neutral mentions pass.

Terms are a fixed list and, as the list knows one language and texts any, words
that the labelled texts themselves show to be exchangeable: words that stand
between the same two neighbours and are spread evenly over the labels.  What
fills one place as well as another, in harmless and toxic sentences alike, must
not move a score.  ``pair_change`` reports the mean change over such pairs.

The fit uses a bounded sample of labelled rows (``sample`` for each class, in
seeded order) and runs in numpy on the driver; executors send it words, not
texts.  Scoring reads every whole text once, without a shuffle.

Edge cases: null and empty texts get the score of a text without words, which
is below 0.5; labels other than 0 and 1 and null labels are left out of the
fit; with no labelled row of one class every score is 0; repeated rows are
scored alike, of texts repeated under one labelled id the fit takes one; texts
of any length are read whole; further columns of the input are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import seeded_sample

WORDS = re.compile(r"[^\W_]+")
#: Words that name a group of people and say nothing else.
IDENTITY_TERMS = (
    "women men girls boys wives husbands "
    "christians muslims jews hindus buddhists atheists catholics "
    "africans asians europeans americans mexicans immigrants refugees "
    "gay lesbian straight bisexual transgender "
    "black white latino "
    "deaf blind disabled elderly "
    "woman man girl boy wife husband "
    "christian muslim jew jewish hindu buddhist atheist catholic "
    "african asian european american mexican immigrant refugee "
    "gays lesbians bisexuals "
    "blacks whites latinos latina latinas"
).split()
OUT = "doc_id long, score double, predicted int"


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features(words: Iterable[str]) -> set[str]:
    """The words and, marked by a hyphen, their beginnings."""
    found = set(words)
    for n in (4, 5, 6):
        found |= {w[:n] + "-" for w in words if len(w) > n}
    return found


@dataclass
class ToxicityModel:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, words: set[str]) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in self.weights.keys() & features(words))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def exchangeable(texts: list[list[str]], labels: list[int], most: int) -> list[tuple[str, str]]:
    """Pairs of words that stand between the same two words and lie evenly over the labels; the commonest first."""
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.int64) for words in texts]
    if not vocabulary:
        return []
    size, y = len(vocabulary) + 1, np.array(labels)
    df = np.zeros((2, size))
    for own, label in zip(ids, labels, strict=True):
        df[label, np.unique(own)] += 1
    n = np.maximum(1, np.array([(y == 0).sum(), (y == 1).sum()]))[:, None]
    even = (df.min(axis=0) >= 3) & (np.abs(np.log((df[1] + 0.5) / n[1]) - np.log((df[0] + 0.5) / n[0])) < 0.25)
    line = np.concatenate([np.concatenate((x, [0])) for x in ids])  # 0 parts the texts
    left, word, right = line[:-2], line[1:-1], line[2:]
    inner = (left > 0) & (right > 0) & even[word]
    slots, times = np.unique(np.stack([left[inner] * size + right[inner], word[inner]], axis=1), axis=0, return_counts=True)
    # neighbours in a slot's sorted list stand for all its pairs; a pair counts as often as both stand there
    same = slots[1:, 0] == slots[:-1, 0]
    pairs, at = np.unique(np.stack([slots[:-1, 1][same], slots[1:, 1][same]], axis=1), axis=0, return_inverse=True)
    uses = np.bincount(at.reshape(-1), weights=np.minimum(times[:-1], times[1:])[same], minlength=len(pairs))
    names = {i: w for w, i in vocabulary.items()}
    best = np.lexsort((pairs[:, 1], pairs[:, 0], -uses))[:most] if len(pairs) else []
    return [(names[int(a)], names[int(b)]) for a, b in pairs[best]]


def counterfactuals(examples: list[set[str]], terms: list[str], swaps: list[tuple[str, str]], bound: int, seed: int) -> list[tuple[int, str | None, str]]:
    """(example, word out, word in); no word out: the sentence named no group.

    Identity terms are put in each other's place, exchangeable words in their
    partners'.
    """
    draw = random.Random(seed)
    named = set(terms)
    partners: dict[str, list[str]] = {}
    for a, b in swaps:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    out: list[tuple[int, str | None, str]] = []
    for k, words in enumerate(examples):
        present = sorted(named & words)
        for term in present or ([None] if terms else []):
            others = [t for t in terms if t not in words]
            if others:
                out.append((k, term, draw.choice(others)))
        near = sorted(w for w in partners.keys() & words if not words.issuperset(partners[w]))
        for word in draw.sample(near, min(2, len(near))):
            out.append((k, word, draw.choice([p for p in partners[word] if p not in words])))
    return out if len(out) <= bound else draw.sample(out, bound)


def pair_change(model: ToxicityModel, examples: list[set[str]], pairs: list[tuple[int, str | None, str]]) -> float:
    """Mean change of score over counterfactual pairs."""
    changes = [abs(model.score(examples[k]) - model.score(examples[k] - {a} | {b})) for k, a, b in pairs]
    return sum(changes) / max(1, len(changes))


def fit(texts: list[list[str]], labels: list[int], *, terms: list[str] = IDENTITY_TERMS, learned: int = 200, penalty: float = 4.0, l1: float = 1e-3, l2: float = 1e-4, rounds: int = 400, pairs: int = 6000, seed: int = 7) -> ToxicityModel:
    """Proximal gradient with momentum on word columns scaled by their log ratio.

    texts: the words of each text in order.  learned: so many exchangeable pairs
    join the fixed terms.  pairs: so many counterfactuals are charged.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    swaps = exchangeable(texts, labels, learned)
    examples = [set(words) for words in texts]
    n, positive = len(y), y.sum()
    df: tuple[Counter, Counter] = (Counter(), Counter())  # by class; the sets of all examples are never held together
    for words, label in zip(examples, labels, strict=True):
        df[label].update(features(words))
    least = max(3, round(0.003 * n))
    log_ratio = lambda w: math.log((df[1][w] + 0.5) / (positive + 1)) - math.log((df[0][w] + 0.5) / (n - positive + 1))
    # a feature as common in either class tells nothing
    ratios = {w: r for part in df for w in part if df[0][w] + df[1][w] >= least and abs(r := log_ratio(w)) >= 0.25}
    named = {f for t in [*terms, *(w for pair in swaps for w in pair)] for f in features([t])}
    ratios |= {w: log_ratio(w) for w in named if df[0][w] + df[1][w]}
    del df
    if not ratios:
        return ToxicityModel()
    vocabulary = {w: i for i, w in enumerate(sorted(ratios))}
    scale = np.clip(np.abs(np.array([ratios[w] for w in vocabulary])), 0.01, 4.0)
    held = [sorted(vocabulary[w] for w in features(words) if w in vocabulary) for words in examples]
    rows = np.repeat(np.arange(n), [len(x) for x in held])
    cols = np.array([i for x in held for i in x], dtype=np.int64)
    values = scale[cols]
    changed: list[tuple[int, int, float]] = []  # pair, column, step
    owners: list[int] = []
    for k, a, b in counterfactuals(examples, list(terms), swaps, pairs, seed):
        before, after = set(held[k]), {vocabulary[f] for f in features(examples[k] - {a} | {b}) if f in vocabulary}
        changed += [(len(owners), c, 1.0) for c in after - before] + [(len(owners), c, -1.0) for c in before - after]
        owners.append(k)
    owner = np.array(owners, dtype=np.int64)
    swap_row, swap_col = (np.array([x[i] for x in changed], dtype=np.int64) for i in (0, 1))
    swap_value = np.array([x[2] for x in changed]) * scale[swap_col] if changed else np.zeros(0)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=values * w[cols], minlength=n)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(cols, weights=values * g[rows], minlength=len(scale))

    def unfair(w: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean of 8 * change of score squared over the pairs, as parts of examples and of columns.

        At a score of one half that is half the squared change of the logit.
        """
        if not len(owner):
            return np.zeros(n), np.zeros(len(scale))
        at = z[owner]
        step = np.bincount(swap_row, weights=swap_value * w[swap_col], minlength=len(owner))
        first, second = logistic(at), logistic(at + step)
        change = 16 * (second - first) / len(owner)
        slope = second * (1 - second)
        shared = np.bincount(owner, weights=change * (slope - first * (1 - first)), minlength=n)
        return shared, np.bincount(swap_col, weights=swap_value * (change * slope)[swap_row], minlength=len(scale))

    probe, uses = np.ones(len(scale)), np.bincount(owner, minlength=n) / max(1, len(owner))
    for _ in range(12):  # a bound of the largest curvature, by power iteration
        steps = np.bincount(swap_row, weights=swap_value * probe[swap_col], minlength=max(1, len(owner))) / max(1, len(owner))
        z = times(probe)
        probe = back(z * (0.25 / n + 0.5 * penalty * uses)) + 2 * penalty * np.bincount(swap_col, weights=swap_value * steps[swap_row], minlength=len(scale))
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    step = 1 / (top + l2 + 0.25)
    w = v = np.zeros(len(scale))
    bias = bias_v = -1.0
    for k in range(rounds):
        z = times(v) + bias_v
        gap = (logistic(z) - y) / n
        shared, own = unfair(v, z)
        new = v - step * (back(gap + penalty * shared) + penalty * own + l2 * v)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = bias_v - step * (gap.sum() + penalty * shared.sum())
        turn = k / (k + 3)
        v, bias_v = new + turn * (new - w), new_bias + turn * (new_bias - bias)
        w, bias = new, new_bias
    return ToxicityModel(min(float(bias), -0.05), {word: float(w[i] * scale[i]) for word, i in vocabulary.items() if w[i]})


def score_documents(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(words_of(t.as_py())) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def sampled(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> tuple[list[list[str]], list[int]]:
    """Words in order and labels of at most ``sample`` texts of each class, drawn by (doc_id, label) before any text travels."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(WORDS.findall((t.as_py() or "").lower())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string())], names=["doc_id", "label", "words"])

    wanted = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = seeded_sample(rows.select("doc_id").join(wanted, "doc_id").distinct(), "label", ["doc_id"], sample, seed)
    texts = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * sample ids
    found = sorted((r["label"], r["doc_id"], r["words"]) for r in texts.mapInArrow(split, "doc_id long, label int, words string").collect())
    return [[sys.intern(w) for w in words.split()] for _, _, words in found], [label for label, _, _ in found]


def fit_on(docs: DataFrame, labels: DataFrame, *, sample: int = 1500, seed: int = 7, **options) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic, already limited to the rows to learn from."""
    texts, y = sampled(docs, labels, sample, seed)
    return fit(texts, y, seed=seed, **options)


def keep_civil(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(words_of(t.as_py())) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
