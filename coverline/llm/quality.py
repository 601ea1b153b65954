"""Operator 7: document quality by a factorisation machine.

Inputs of a score are hashed words (their logarithmic counts, scaled to unit length), binned statistics of a text's
structure, and binned metadata of the row that the text itself gives (its size in bytes, words and lines). All pairs of
inputs interact through vectors of ``RANK`` numbers; the sum over pairs takes linear time, as half the square of the sum
less the sum of squares. Training is in numpy on about ``PER_LABEL`` labelled documents of each label, weighted back to the
labels' shares, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split import held_out, sampled
from .textkit import buffers, slices, word_hashes, words

BUCKETS = 1 << 15
BINS = 16
#: Shares in 0 to 1, then sizes on a logarithmic scale.
SHARES = ("upper", "digit", "symbol", "space", "beyond_ascii", "distinct_words", "top_word", "repeated_next", "symbol_end", "one_letter")
SIZES = ("word_length", "bytes", "words", "lines")
INPUTS = BUCKETS + BINS * (len(SHARES) + len(SIZES))
RANK = 8
PER_LABEL = 3000
EPOCHS, BATCH, RATE = 6, 64, 0.08
ACCEPT = 0.7

_CLASS = np.full(256, 5, np.uint8)
_CLASS[128:] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[48:58] = 1
_CLASS[65:91] = 0
_CLASS[97:123] = 6
_SYMBOL = 5


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def _share_bin(x: np.ndarray) -> np.ndarray:
    """Finer near 0, where most shares lie."""
    return np.minimum(BINS - 1, np.floor(np.sqrt(np.clip(x, 0, 1)) * BINS)).astype(np.int64)


def _size_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.floor(np.log2(1 + np.maximum(x, 0)))).astype(np.int64)


def inputs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse inputs of whole texts: row (in order), input and value."""
    n = len(starts)
    row, first, last, joined = words(raw, starts, ends)
    hashes = word_hashes(joined, first, last)
    size = ends - starts
    rows_at = np.concatenate([[0], np.cumsum(size)])
    kind = _CLASS[joined]

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[rows_at[1:]] - total[rows_at[:-1]]

    n_words = np.bincount(row, minlength=n)
    some, any_byte = np.maximum(n_words, 1), np.maximum(size, 1)
    key, count = np.unique(row.astype(np.int64) * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    at, bucket = key // BUCKETS, key % BUCKETS
    top = np.zeros(n, np.int64)
    np.maximum.at(top, at, count)
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(at, weights=value * value, minlength=n))[at]
    next_same = np.bincount(row[:-1][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(row) > 1 else np.zeros(n)
    symbol_end = np.bincount(row[kind[last - 1] == _SYMBOL], minlength=n) if len(row) else np.zeros(n)
    shares = [
        per_row(kind == 0) / any_byte, per_row(kind == 1) / any_byte, per_row(kind == _SYMBOL) / any_byte, per_row(kind == 3) / any_byte, per_row(kind == 4) / any_byte,
        np.bincount(at, minlength=n) / some, top / some, next_same / some, symbol_end / some, np.bincount(row[(last - first) == 1], minlength=n) / some,
    ]
    sizes = [(size / some) ** 2, size, n_words, per_row(joined == 10)]
    bins = [_share_bin(x) for x in shares] + [_size_bin(x) for x in sizes]
    extra = np.stack([BUCKETS + k * BINS + b for k, b in enumerate(bins)], axis=1)
    rows = np.concatenate([at, np.repeat(np.arange(n), len(bins))])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([bucket, extra.ravel()])[order], np.concatenate([value, np.full(extra.size, 0.5)])[order].astype(np.float32)


def margins(model: Model, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Log-odds: linear part and, for each factor, half of (sum of v x) squared less the sum of (v x) squared."""
    out = model.bias + np.bincount(row, weights=model.weight[feature] * value, minlength=n)
    vx = model.factor[feature] * value[:, None]
    for k in range(RANK):
        total = np.bincount(row, weights=vx[:, k], minlength=n)
        out += 0.5 * (total * total - np.bincount(row, weights=vx[:, k] * vx[:, k], minlength=n))
    return out


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    raw, starts, ends = buffers(texts)
    out = np.empty(len(starts))
    for part in slices(starts, ends):
        z = margins(model, *inputs(raw, starts[part], ends[part]), part.stop - part.start)
        out[part] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, seed: int = 1) -> Model:
    """Stochastic gradients with a rate for each parameter; ``rows`` are (features, values) of each document."""
    rng = np.random.default_rng(seed)
    model = Model(float(np.log((label * weight).sum() + 1) - np.log(((1 - label) * weight).sum() + 1)), np.zeros(INPUTS, np.float32), rng.normal(0, 0.05, (INPUTS, RANK)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-4, np.float32), np.full((INPUTS, RANK), 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            lengths = [len(rows[i][0]) for i in pick]
            row = np.repeat(np.arange(len(pick)), lengths)
            feature = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            v = model.factor[feature]
            vx = v * x[:, None]
            total = np.stack([np.bincount(row, weights=vx[:, k], minlength=len(pick)) for k in range(RANK)], axis=1)
            z = margins(model, row, feature, x, len(pick))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) * weight[pick] / len(pick))[row]
            used, back = np.unique(feature, return_inverse=True)
            g_w = np.bincount(back, weights=error * x) + 1e-5 * model.weight[used]
            g_v = np.zeros((len(used), RANK))
            inner = (error * x)[:, None] * (total[row] - vx)
            for k in range(RANK):
                g_v[:, k] = np.bincount(back, weights=inner[:, k])
            g_v += 1e-4 * model.factor[used]
            g_b = float((error / np.array(lengths)[row]).sum())
            seen_w[used] += g_w * g_w
            seen_v[used] += g_v * g_v
            seen_b += g_b * g_b
            model.weight[used] -= RATE * g_w / np.sqrt(seen_w[used])
            model.factor[used] -= 0.3 * RATE * g_v / np.sqrt(seen_v[used])
            model.bias -= RATE * g_b / seen_b**0.5
    return model


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts, ends = buffers(batch.column(2))
        feature, value = [], []
        for part in slices(starts, ends):
            row, f, v = inputs(raw, starts[part], ends[part])
            stops = np.searchsorted(row, np.arange(part.stop - part.start + 1))
            for a, b in zip(stops[:-1], stops[1:]):
                feature.append(f[a:b].astype("<u2").tobytes())
                value.append(v[a:b].astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feature, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "quality", "feature", "value"])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from labelled documents outside the held-out quarter; none if there are no such rows."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample, counts = sampled(marked, "quality", per_label)
    if not counts:
        return None
    # the sample's ids are bounded by their number; of rows that repeat an id the smallest text is learned
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample.select("doc_id", "quality")), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = texts.select("doc_id", "quality", "text").mapInArrow(_rows_of, "doc_id long, quality int, feature binary, value binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r[0], bytes(r[2])))
    rows = [(np.frombuffer(bytes(r[2]), "<u2").astype(np.int64), np.frombuffer(bytes(r[3]), "<f2").astype(np.float32)) for r in found]
    label = np.array([r[1] for r in found], np.float64)
    weight = np.ones(len(label))
    for q, count in counts.items():
        weight[label == q] = count / max(1, int((label == q).sum()))
    return train(rows, label, weight / weight.mean())


def score(model: Model | None, text: str = "text") -> Column:
    """Probability of label 1 for a text column; a null text is scored as an empty one; 0.5 if nothing could be learned."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array(scores(model, texts))

    return predict(F.col(text))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; no other column is read. Of a document with several
    labels the smaller counts. Every row is scored, with repeated ids, null ids and empty texts too.
    """
    found = docs.select("doc_id", held_out().alias("held_out"), score(learn(docs, labels)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
