"""Operator 4: language of whole texts by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments of ``SEGMENT`` that run side by side through two recurrent layers, one from the left
and one from the right; at every byte both states vote on the language, and a document's probabilities are the mean over
all its bytes. The gates use x / (1 + |x|) in place of the exponential curves: the network is as able and several times
cheaper. It is trained here, in numpy, by backpropagation through time over a bounded sample: about ``PER_LANGUAGE``
documents of each language (fewer of each where there are so many languages that ``split.SAMPLE`` would be passed), and
``PER_DOCUMENT`` segments spread over each. Every language that has a labelled row can be predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split import held_out, sampled
from .textkit import buffers, slices

SEGMENT, HIDDEN, PAD = 64, 8, 256
PER_LANGUAGE, PER_DOCUMENT = 300, 12
EPOCHS, BATCH, RATE = 5, 256, 0.01
UNKNOWN = "und"


@dataclass
class Layer:
    """One direction: a row of gate inputs for each byte (reset, update, new), and the recurrent weights of each gate."""

    table: list[np.ndarray]
    back: list[np.ndarray]
    out: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.back, self.out]


@dataclass
class Model:
    languages: list[str]
    layers: list[Layer]
    bias: np.ndarray


def fresh(languages: list[str], seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    layers = [Layer([draw(PAD + 1, HIDDEN, scale=0.5) for _ in range(3)], [draw(HIDDEN, HIDDEN, scale=HIDDEN**-0.5) for _ in range(3)], draw(HIDDEN, len(languages), scale=HIDDEN**-0.5)) for _ in range(2)]
    return Model(languages, layers, np.zeros(len(languages), np.float32))


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def states(layer: Layer, symbols: np.ndarray, reverse: bool) -> np.ndarray:
    """State after each symbol; ``symbols`` is (time, segments), and so are the states with one more axis."""
    steps, n = symbols.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    r, z, c, tmp, mag = (np.empty_like(h) for _ in range(5))
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        for gate, table, back in ((r, layer.table[0], layer.back[0]), (z, layer.table[1], layer.back[1])):
            np.take(table, symbols[t], axis=0, out=gate, mode="clip")
            np.matmul(h, back, out=tmp)
            gate += tmp
            np.abs(gate, out=mag)
            mag += 1
            gate /= mag
            gate *= 0.5
            gate += 0.5
        np.take(layer.table[2], symbols[t], axis=0, out=c, mode="clip")
        np.matmul(h, layer.back[2], out=tmp)
        tmp *= r
        c += tmp
        np.abs(c, out=mag)
        mag += 1
        c /= mag
        h = out[t - 1 if not reverse else t + 1] if (t > 0 if not reverse else t < steps - 1) else h
        np.subtract(h, c, out=tmp)
        tmp *= z
        np.add(c, tmp, out=out[t])
        h = out[t]
    return out


def _probabilities(model: Model, found: list[np.ndarray]) -> np.ndarray:
    score = np.matmul(found[0], model.layers[0].out)
    score += np.matmul(found[1], model.layers[1].out)
    score += model.bias
    np.clip(score, -30, 30, out=score)
    np.exp(score, out=score)
    total = score[..., 0].copy()
    for k in range(1, score.shape[-1]):
        total += score[..., k]
    score /= total[..., None]
    return score


def _gradients(model: Model, symbols: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of all parameters over one batch of segments, by backpropagation through time."""
    real = (symbols != PAD).astype(np.float32)
    found = [states(layer, symbols, bool(k)) for k, layer in enumerate(model.layers)]
    p = _probabilities(model, found)
    n = max(1.0, float(real.sum()))
    chosen = np.take_along_axis(p, target[None, :, None], axis=2)[..., 0]
    loss = float(-(np.log(chosen + 1e-9) * real).sum() / n)
    error = p
    error[np.arange(symbols.shape[0])[:, None], np.arange(symbols.shape[1])[None, :], target[None, :]] -= 1
    error *= (real / n)[..., None]
    grads: list[np.ndarray] = []
    for k, layer in enumerate(model.layers):
        h = found[k]
        d_out = np.einsum("tnh,tnc->hc", h, error)
        d_table = [np.zeros_like(x) for x in layer.table]
        d_back = [np.zeros_like(x) for x in layer.back]
        flow = np.zeros_like(h[0])
        steps = len(symbols)
        for t in range(steps) if k else range(steps - 1, -1, -1):
            before = t + 1 if k else t - 1
            h0 = h[before] if 0 <= before < steps else np.zeros_like(h[0])
            x = symbols[t]
            pre = [layer.table[g][x] + h0 @ layer.back[g] for g in range(2)]
            s = [_soft(v) for v in pre]
            r, z = (0.5 + 0.5 * v for v in s)
            raw = h0 @ layer.back[2]
            c = _soft(layer.table[2][x] + r * raw)
            dh = flow + error[t] @ layer.out.T
            dz = dh * (h0 - c) * 0.5 * (1 - np.abs(s[1])) ** 2
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dr = dc * raw * 0.5 * (1 - np.abs(s[0])) ** 2
            draw = dc * r
            flow = dh * z + dr @ layer.back[0].T + dz @ layer.back[1].T + draw @ layer.back[2].T
            for g, (into, recur) in enumerate(((dr, dr), (dz, dz), (dc, draw))):
                np.add.at(d_table[g], x, into)
                d_back[g] += h0.T @ recur
        grads += [*d_table, *d_back, d_out]
    return loss, [*grads, error.sum(axis=(0, 1))]


def train(segments: np.ndarray, target: np.ndarray, languages: list[str], seed: int = 1) -> Model:
    """Adam over shuffled batches; ``segments`` is (n, SEGMENT) of byte values, PAD after a text's end."""
    model, rng = fresh(languages, seed), np.random.default_rng(seed)
    params = [*(p for layer in model.layers for p in layer.parameters()), model.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = EPOCHS * -(-len(segments) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, grads = _gradients(model, np.ascontiguousarray(segments[pick].T), target[pick])
            step += 1
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            for p, g, m, v in zip(params, grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                rate = RATE * (1 - 0.9 * step / total)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All segments of the rows, (n, SEGMENT), and the row of each; an empty row has none."""
    counts = -(-(ends - starts) // SEGMENT)
    row = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    at = starts[row] + (np.arange(len(row)) - first[row]) * SEGMENT
    place = at[:, None] + np.arange(SEGMENT)
    past = place >= ends[row][:, None]
    np.minimum(place, max(0, len(raw) - 1), out=place)
    out = raw[place].astype(np.intp) if len(raw) else np.zeros(place.shape, np.intp)
    out[past] = PAD
    return out, row


def document_probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """(rows, languages): the mean of the labels of all bytes of each whole text; zeros where there is no byte."""
    raw, starts, ends = buffers(texts)
    out = np.zeros((len(starts), len(model.languages)), np.float64)
    for part in slices(starts, ends, SEGMENT * 4096):
        for at in range(part.start, part.stop):
            if ends[at] - starts[at] <= SEGMENT * 8192:
                continue
            # a longer text alone fills a slice: it is taken piece by piece
            for k in range(int(starts[at]), int(ends[at]), SEGMENT * 4096):
                out[at] += _sums(model, raw, np.array([k]), np.array([min(int(ends[at]), k + SEGMENT * 4096)]))[0]
            break
        else:
            out[part] += _sums(model, raw, starts[part], ends[part])
    size = np.maximum(ends - starts, 1)
    return out / size[:, None]


def _sums(model: Model, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    segments, row = _segments(raw, starts, ends)
    total = np.zeros((len(starts), len(model.languages)), np.float64)
    if not len(row):
        return total
    symbols = np.ascontiguousarray(segments.T)
    p = _probabilities(model, [states(layer, symbols, bool(k)) for k, layer in enumerate(model.layers)])
    padded = np.flatnonzero(segments[:, -1] == PAD)
    p[:, padded] *= (symbols[:, padded] != PAD)[..., None]
    per = p.sum(axis=0)
    for k in range(total.shape[1]):
        total[:, k] = np.bincount(row, weights=per[:, k], minlength=len(starts))
    return total


def _spread(batches):
    """Up to PER_DOCUMENT segments of each text, spread evenly over the whole of it."""
    for batch in batches:
        raw, starts, ends = buffers(batch.column(1))
        lang, bits = [], []
        for name, a, b in zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist()):
            n = -(-(b - a) // SEGMENT)
            for k in range(min(n, PER_DOCUMENT)):
                at = a + (k * n // min(n, PER_DOCUMENT)) * SEGMENT
                lang.append(name)
                bits.append(raw[at : min(b, at + SEGMENT)].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(bits, pa.binary())], names=["lang", "bits"])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from labelled documents outside the held-out quarter; none if there are no such rows."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sample, counts = sampled(rows, "lang", per_language)
    if not counts:
        return None
    languages = list(counts)
    found = sample.select("lang", "text").mapInArrow(_spread, "lang string, bits binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    segments = np.full((len(found), SEGMENT), PAD, np.intp)
    for k, r in enumerate(found):
        segments[k, : len(r[1])] = np.frombuffer(bytes(r[1]), np.uint8)
    return train(segments, np.array([languages.index(r[0]) for r in found], np.intp), languages) if found else None


def language(model: Model | None, text: str = "text") -> Column:
    """A struct of lang_pred and score for a text column; ``und`` with 0 where the text is null or has no letter."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        p = document_probabilities(model, texts)
        best = p.argmax(axis=1)
        names = pa.array(model.languages).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], names=["lang_pred", "score"])

    return F.when(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), predict(F.col(text))).otherwise(unknown)


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. ``docs`` needs doc_id, text and lang; no other column is read.

    A null or empty text, or one without letters, is ``und`` with score 0; so is every row where no language could be
    learned. Rows with a null lang or doc_id are not learned from but predicted; an id that repeats is learned from once
    for each of its languages and predicted as often as it comes. Equal probabilities go to the first language by name.
    """
    found = docs.select("doc_id", held_out().alias("held_out"), language(learn(docs)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
