"""Words of whole texts as numpy arrays, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

#: Value of each byte in a word's hash: A-Z as a-z, separators nothing.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE[SEPARATOR] = 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed)) | np.uint64(1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column with each row's start and end; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if texts.null_count:
        gone = np.asarray(texts.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, at_most: int = 1 << 20) -> Iterator[slice]:
    """Runs of rows of about ``at_most`` bytes together; a longer row is a run of its own."""
    first, held = 0, 0
    for i, size in enumerate((ends - starts).tolist()):
        if held and held + size > at_most:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if first < len(starts):
        yield slice(first, len(starts))


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' words, in order: the row, start and end in ``joined`` bytes, and those bytes (rows end to end)."""
    sizes = ends - starts
    if len(starts) and np.array_equal(starts[1:], ends[:-1]):
        joined = raw[starts[0] : ends[-1]]
    else:
        joined = np.concatenate([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]) if len(starts) else raw[:0]
    rows_at = np.concatenate([[0], np.cumsum(sizes)])
    inside = ~SEPARATOR[joined]
    n = len(joined)
    cut = np.zeros(n + 1, dtype=bool)
    cut[rows_at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(rows_at, first, side="right") - 1
    return row, first, last, joined


def word_hashes(joined: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of lower-cased words (A-Z only): a sum over bytes, each with its own multiplier by place, then mixed."""
    if not len(first):
        return np.empty(0, np.uint64)
    lengths = last - first
    span = joined[first[0] : last[-1]]
    begin = first - first[0]
    place = np.arange(len(span), dtype=np.int64)
    gaps = np.diff(np.append(begin, len(span)))
    place -= np.repeat(begin, gaps)
    longest = int(lengths.max())
    np.minimum(place, longest, out=place)
    with np.errstate(over="ignore"):
        value = _VALUE[span]
        value *= constants(longest + 1, 7 + seed)[place]
        total = np.add.reduceat(value, begin)
        return mix64(total + lengths.astype(np.uint64) * _GOLDEN)
