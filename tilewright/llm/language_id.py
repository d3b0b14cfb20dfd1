"""Language identification with a bidirectional gated recurrent network.

The network reads bytes in both directions; at every position the two states
give a distribution over the languages, and a document's probabilities are the
mean over the positions that hold part of a letter.  Each direction is a light
gated unit: z = sigmoid(E_z[byte] + U_z h), c = tanh(E_c[byte] + U_c h),
h = z h + (1 - z) c, with the gates' input parts read from a table by byte.

Texts run in segments of ``SEGMENT`` bytes side by side, one step of numpy for
many documents.  Each segment enters with the ``CONTEXT`` bytes before and behind
it: the states have read these when they come to its first byte, from either
side, so no position is labelled out of a window cut in the middle of a word.
Every byte of every text is read, and labelled once.

Training is backpropagation through time in numpy on the driver, on a bounded
sample: ``sample`` texts of each language in seeded order, whole, in windows of
``WINDOW`` bytes of which each language's are drawn equally often, and in a language
each text's.  The languages are those that occur in the training rows.

Edge cases: a text that is null or has no letter (no character of the Unicode
categories L) is ``und`` with score 1; rows with a null language or text are not
learnt from; of texts repeated under one id and language one is learnt from;
without a training row every text is ``und`` with score 0; ties between
languages go to the first in code-point order; a null id stays null; repeated
rows are handled alike; texts of any length are read whole; further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import seeded_sample

SEGMENT, CONTEXT, WINDOW = 256, 32, 128
PAD = 256
#: Symbols that run at once.
SYMBOLS = 6144 * 64
OUT = "doc_id long, lang_pred string, score double"
#: Positions that count towards a document: parts of letters and all bytes beyond ASCII.
COUNTS = np.array([chr(b).isalpha() or b >= 128 for b in range(256)] + [False])


@dataclass
class Network:
    """table: (2, 257, 2H) by direction and byte; recur: (2, H, 2H); out: (2H, K); bias: (K,)."""

    languages: list[str]
    table: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(data: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW symbols, the last padded."""
    n = -(-len(data) // WINDOW)
    flat = np.full(n * WINDOW, PAD, dtype=np.int16)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return flat.reshape(n, WINDOW)


def segments(data: bytes) -> list[tuple[bytes, int, int]]:
    """Each segment with its context, and where it begins and ends in that."""
    out = []
    for start in range(0, len(data), SEGMENT):
        low = max(0, start - CONTEXT)
        out.append((data[low : start + SEGMENT + CONTEXT], start - low, min(len(data), start + SEGMENT) - low))
    return out


def states(net: Network, symbols: np.ndarray) -> np.ndarray:
    """(T, 2, B, H): states at every step; step t of direction 1 reads position T-1-t."""
    b, t = symbols.shape
    h_size = net.recur.shape[1]
    both = np.stack([symbols.T, symbols.T[::-1]], axis=1)  # (T, 2, B)
    table = net.table.reshape(-1, 2 * h_size)
    offset = np.array([0, PAD + 1])[:, None]
    kind = net.recur.dtype
    h = np.zeros((2, b, h_size), dtype=kind)
    all_h = np.empty((t, 2, b, h_size), dtype=kind)
    pre = np.empty((2, b, 2 * h_size), dtype=kind)
    for k in range(t):
        np.matmul(h, net.recur, out=pre)
        pre += table[both[k] + offset]
        z = pre[..., :h_size]
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        c = np.tanh(pre[..., h_size:])
        h = np.subtract(h, c, out=all_h[k])
        h *= z
        h += c
    return all_h


def position_probabilities(net: Network, symbols: np.ndarray) -> np.ndarray:
    """(B, T, K): a distribution over the languages at every position."""
    h = states(net, symbols)
    size = h.shape[-1]
    logits = h[:, 0] @ net.out[:size]  # (T, B, K)
    logits += h[::-1, 1] @ net.out[size:]
    logits += net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits.transpose(1, 0, 2)


def train(rows: np.ndarray, targets: np.ndarray, languages: list[str], *, hidden: int = 12, steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the mean cross-entropy of all positions that count."""
    draw = np.random.default_rng(seed)
    k = len(languages)
    f = np.float32
    net = Network(
        languages,
        draw.normal(0, 0.3, (2, PAD + 1, 2 * hidden)).astype(f),
        draw.normal(0, 0.3, (2, hidden, 2 * hidden)).astype(f),
        draw.normal(0, 0.3, (2 * hidden, k)).astype(f),
        np.zeros(k, f),
    )
    if k < 2 or not len(rows):
        return net
    params = [net.table, net.recur, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = draw.integers(0, len(rows), batch)
        found = gradients(net, rows[pick], targets[pick])[1]
        lr = rate * (1 - step / (steps + 1)) + 1e-4
        for p, g, m, v in zip(params, found, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(f)
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the positions that count, and its gradients by table, recur, out and bias."""
    (batch, t), hidden, kind = x.shape, net.recur.shape[1], net.recur.dtype
    h = states(net, x)
    both = np.stack([x.T, x.T[::-1]], axis=1)
    prob = position_probabilities_of(net, h)  # (T, B, K)
    weight = COUNTS[x].astype(kind).T
    weight /= max(1.0, weight.sum())
    steps, rows = np.arange(t)[:, None], np.arange(batch)[None, :]
    loss = -float((np.log(prob[steps, rows, y[None, :]]) * weight).sum())
    prob[steps, rows, y[None, :]] -= 1
    g_logit = prob * weight[:, :, None]
    g_out = np.concatenate([np.einsum("tbh,tbk->hk", h[:, 0], g_logit), np.einsum("tbh,tbk->hk", h[::-1, 1], g_logit)])
    g_state = np.stack([g_logit @ net.out[:hidden].T, (g_logit @ net.out[hidden:].T)[::-1]], axis=1)
    g_table, g_recur = np.zeros_like(net.table), np.zeros_like(net.recur)
    g_input = np.empty((t, 2, batch, 2 * hidden), kind)
    carry = np.zeros((2, batch, hidden), kind)
    for s in range(t - 1, -1, -1):
        before = h[s - 1] if s else np.zeros_like(h[0])
        pre = before @ net.recur + net.table[np.arange(2)[:, None], both[s]]
        z, c = sigmoid(pre[..., :hidden]), np.tanh(pre[..., hidden:])
        g = carry + g_state[s]
        g_pre = np.concatenate([g * (before - c) * z * (1 - z), g * (1 - z) * (1 - c * c)], axis=2)
        carry = g * z + g_pre @ net.recur.transpose(0, 2, 1)
        g_recur += before.transpose(0, 2, 1) @ g_pre
        g_input[s] = g_pre
    for d in (0, 1):
        order = np.argsort(both[:, d], axis=None, kind="stable")
        byte = both[:, d].reshape(-1)[order]
        starts = np.concatenate(([0], np.flatnonzero(byte[1:] != byte[:-1]) + 1))
        g_table[d, byte[starts]] = np.add.reduceat(g_input[:, d].reshape(-1, 2 * hidden)[order], starts)
    return loss, [g_table, g_recur, g_out, g_logit.sum(axis=(0, 1))]


def position_probabilities_of(net: Network, h: np.ndarray) -> np.ndarray:
    """(T, B, K) from the states that ``states`` gave."""
    size = h.shape[-1]
    logits = h[:, 0] @ net.out[:size] + h[::-1, 1] @ net.out[size:] + net.bias
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and pooled probability of each text."""
    answers: list[tuple[str, float]] = [("und", 0.0 if not net.languages else 1.0)] * len(texts)
    if not net.languages:
        return answers
    sums = np.zeros((len(texts), len(net.languages)))
    counts = np.zeros(len(texts))
    waiting: dict[int, list[tuple[int, bytes, int, int]]] = {}  # by width: text, bytes, begin, end

    def flush(width: int) -> None:
        held = waiting.pop(width, [])
        if not held:
            return
        x = np.full((len(held), width), PAD, dtype=np.int16)
        weight = np.zeros(x.shape, dtype=np.float32)
        for row, (_, data, begin, end) in enumerate(held):
            x[row, : len(data)] = np.frombuffer(data, dtype=np.uint8)
            weight[row, begin:end] = 1
        weight *= COUNTS[x]
        owner = np.array([k for k, _, _, _ in held])
        np.add.at(sums, owner, np.einsum("btk,bt->bk", position_probabilities(net, x), weight))
        np.add.at(counts, owner, weight.sum(axis=1))

    live = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    for k, text in enumerate(texts):
        if live[k]:
            for part in segments(text.encode()):
                width = -(-len(part[0]) // 64) * 64
                waiting.setdefault(width, []).append((k, *part))
                if len(waiting[width]) * width >= SYMBOLS:
                    flush(width)
    for width in list(waiting):
        flush(width)
    for k in range(len(texts)):
        if live[k]:
            p = sums[k] / max(1.0, counts[k])
            best = int(p.argmax())
            answers[k] = (net.languages[best], float(min(1.0, max(0.0, p[best]))))
    return answers


def fit_on(docs: DataFrame, *, sample: int = 150, seed: int = 7, **options) -> Network:
    """Network for the languages of ``docs`` (doc_id, text, lang), the rows to learn from.

    Of each language the ``sample`` first texts in seeded order are read, whole.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # ids first, so that only the sample's texts travel
    drawn = seeded_sample(known.select("doc_id", "lang").distinct(), "lang", ["doc_id"], sample, seed)
    texts = known.join(F.broadcast(drawn), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # sample ids a language
    found = sorted((r["lang"], r["doc_id"], r["text"]) for r in texts.collect())
    languages = sorted({lang for lang, _, _ in found})
    rows = [windows(text.encode()) for _, _, text in found]
    if not sum(map(len, rows)):
        return train(np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), languages, seed=seed, **options)
    x = np.concatenate(rows)
    y = np.repeat([languages.index(lang) for lang, _, _ in found], [len(r) for r in rows])
    # each language is drawn equally often, and in it each text, so that short ones count
    chance = np.concatenate([np.full(len(r), 1 / max(1, len(r))) for r in rows])
    chance /= np.bincount(y, weights=chance, minlength=len(languages))[y]
    pick = np.random.default_rng(seed).choice(len(x), 4 * len(x), p=chance / chance.sum())
    return train(x[pick], y[pick], languages, seed=seed, **options)


def identify(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                answers = predict(net, part.column(1).to_pylist())
                columns = [part.column(0), pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)
