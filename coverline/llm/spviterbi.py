"""Operator 3: SentencePiece encoding and decoding by a batched Viterbi search.

A text is split before every run of spaces, as no piece goes on past one (checked when the model is read). Distinct words
of a batch are grouped by their length in bytes and advance together: hashes of all substrings of a length are probed at
once among the sorted keys of pieces of that length, and for every end the best score over all piece lengths, and the
length that gave it, come from vectorised maxima. Characters without a piece fall back to their bytes.

A word of more than ``LONG`` bytes (a script without spaces, an encoded blob) is first cut wherever no piece of the model that
occurs in it goes across: no path can differ there, so its segments are words like any other. What stays long without such a
place is solved on its own, one end after another over the pieces that occur, in windows of ``WINDOW`` bytes.

The best path is the one with the largest sum of the model's piece scores; of equal ones the longer last piece holds. For a
model made by merging pairs this is the best reading under its scores, not the order in which it would merge.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import buffers, constants, mix64, slices

_BASE = np.uint64(0x9E3779B97F4A7C15)
_META = "▁".encode()
_WORK, _SLICE = 1 << 20, 1 << 20
_NONE = np.float64(-1e30)
LONG, WINDOW = 512, 1 << 16


@dataclass
class Pieces:
    """The model by byte length of its pieces: sorted keys, a filter over their top bits, scores and ids."""

    keys: dict[int, np.ndarray]
    filters: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    ids: dict[int, np.ndarray]
    byte_ids: np.ndarray
    unknown: float
    bytes_of: np.ndarray
    first_of: np.ndarray


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@functools.cache
def pieces(path: str | None) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    n = model.get_piece_size()
    byte_ids, stored, by_length, least = np.full(256, -1, np.int32), [], {}, 0.0
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:-1], 16)] = i
            stored.append(bytes([int(name[3:-1], 16)]))
            continue
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            stored.append(b"")
            continue
        data = name.encode().replace(_META, b" ")
        if b" " in data.lstrip(b" "):
            raise ValueError("a piece goes on past a space")
        stored.append(data)
        least = min(least, model.get_score(i))
        by_length.setdefault(len(data), []).append((_hash(data), model.get_score(i), i))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces to fall back to")
    keys, filters, scores, ids = {}, {}, {}, {}
    for size, rows in by_length.items():
        rows.sort()
        keys[size] = np.array([r[0] for r in rows], np.uint64)
        filters[size] = np.zeros(1 << 18, bool)
        filters[size][(keys[size] >> np.uint64(46)).astype(np.int64)] = True
        scores[size], ids[size] = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int32)
    first = np.concatenate([[0], np.cumsum([len(x) for x in stored])])
    return Pieces(keys, filters, scores, ids, byte_ids, least - 10, np.frombuffer(b"".join(stored), np.uint8), first)


def _best_paths(model: Pieces, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of equally long words, (m, n) bytes; ids of all rows end to end."""
    m, n = rows.shape
    x = np.ascontiguousarray(rows.T)
    prefix = np.zeros((n + 1, m), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + x[j].astype(np.uint64) + np.uint64(1)
        sizes = [s for s in sorted(model.keys, reverse=True) if s <= n]
        score = {s: np.full((n - s + 1, m), _NONE) for s in sizes}
        ids = {s: np.full((n - s + 1, m), -1, np.int32) for s in sizes}
        power = np.uint64(1)
        powers = {}
        for s in range(1, n + 1):
            power = power * _BASE
            powers[s] = power
        for s in sizes:
            h = prefix[s:] - prefix[:-s] * powers[s]
            at = np.flatnonzero(model.filters[s][(h >> np.uint64(46)).astype(np.int64)])
            found = h.ravel()[at]
            place = np.minimum(np.searchsorted(model.keys[s], found), len(model.keys[s]) - 1)
            good = model.keys[s][place] == found
            score[s].ravel()[at[good]] = model.scores[s][place[good]]
            ids[s].ravel()[at[good]] = model.ids[s][place[good]]
    # a character that is no piece: its first byte costs the penalty, the others nothing
    lead = np.where(x < 0x80, 1, np.where(x < 0xC0, 0, np.where(x < 0xE0, 2, np.where(x < 0xF0, 3, 4))))
    if 1 not in score:
        score[1], ids[1] = np.full((n, m), _NONE), np.full((n, m), -1, np.int32)
        sizes.append(1)
    for width in range(1, 5):
        if width > n:
            break
        lone = lead[: n - width + 1] == width
        lone &= score[width] == _NONE if width in score else True
        if lone.any():
            at, row = np.nonzero(lone)
            for k in range(width):
                score[1][at + k, row] = model.unknown if k == 0 else 0.0
                ids[1][at + k, row] = model.byte_ids[x[at + k, row]]
    best = np.zeros((n + 1, m))
    step = np.zeros((n + 1, m), np.int16)
    chosen = np.full((n + 1, m), -1, np.int32)
    for j in range(1, n + 1):
        top = np.full(m, 4 * _NONE)
        for s in sizes:
            if s <= j:
                value = best[j - s] + score[s][j - s]
                better = value > top
                if better.any():
                    np.copyto(top, value, where=better)
                    step[j][better] = s
                    np.copyto(chosen[j], ids[s][j - s], where=better)
        best[j] = top
    columns = np.arange(m)
    at = np.full(m, n)
    out = np.full((n, m), -1, np.int32)
    count = np.zeros(m, np.int64)
    while True:
        open_ = np.flatnonzero(at > 0)
        if not len(open_):
            break
        out[count[open_], columns[open_]] = chosen[at[open_], columns[open_]]
        count[open_] += 1
        at[open_] -= step[at[open_], columns[open_]]
    place = np.repeat(count, count) - 1 - _within(count)
    return out[place, np.repeat(columns, count)], count


def _occurring(model: Pieces, word: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, score, id) of every piece that occurs in ``word`` and starts in begin to stop, by start and falling size."""
    most = max(model.keys)
    part = word[begin : min(len(word), stop + most - 1)]
    x = part.astype(np.uint64) + np.uint64(1)
    out: tuple[list, ...] = ([], [], [], [])
    with np.errstate(over="ignore"):
        h = np.zeros(len(part) + 1, np.uint64)
        for s in range(1, min(most, len(part)) + 1):
            # a substring's hash from that of its first s - 1 bytes
            h = h[: len(part) - s + 1] * _BASE + x[s - 1 :]
            if s not in model.keys:
                continue
            at = np.flatnonzero(model.filters[s][(h[: stop - begin] >> np.uint64(46)).astype(np.int64)])
            place = np.minimum(np.searchsorted(model.keys[s], h[at]), len(model.keys[s]) - 1)
            good = model.keys[s][place] == h[at]
            at, place = at[good], place[good]
            for into, value in zip(out, (at + begin, np.full(len(at), s), model.scores[s][place], model.ids[s][place])):
                into.append(value)
    start, size, score, ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    order = np.lexsort((-size, start))
    return start[order], size[order], score[order], ids[order]


def _segments(model: Pieces, word: np.ndarray) -> np.ndarray:
    """Where the segments of a long word start: at each first byte of a character that no piece in the word goes across."""
    across = np.zeros(len(word) + 1, np.int32)
    for begin in range(0, len(word), WINDOW):
        start, size, _, _ = _occurring(model, word, begin, min(len(word), begin + WINDOW))
        np.add.at(across, start + 1, 1)
        np.add.at(across, start + size, -1)
    free = (np.cumsum(across[:-1]) == 0) & ((word & 0xC0) != 0x80)
    free[0] = True
    return np.flatnonzero(free)


def _long_path(model: Pieces, word: np.ndarray) -> np.ndarray:
    """The ids of one long word: the best score of each end, then back along the pieces that gave it."""
    n = len(word)
    best, step, chosen = np.full(n + 1, 4 * _NONE), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
    best[0] = 0.0
    reach = max(*model.keys, 4)
    for begin in range(0, n, WINDOW):
        stop = min(n, begin + WINDOW)
        start, size, score, ids = (x.tolist() for x in _occurring(model, word, begin, stop))
        # what a window's ends may hold already came from the window before
        held = best[begin : stop + reach + 1].tolist()
        steps, ids_at = step[begin : stop + reach + 1].tolist(), chosen[begin : stop + reach + 1].tolist()
        lead = word[begin:stop].tolist()
        k, m = 0, len(start)
        for at in range(stop - begin):
            here, first = held[at], lead[at]
            width = 1 if first < 0x80 else 0 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            alone = False
            while k < m and start[k] == at + begin:
                s = size[k]
                value = here + score[k]
                alone |= s == width
                end = at + s
                # of equal paths the one with the longer last piece, that is the one from further back, came first
                if value > held[end]:
                    held[end], steps[end], ids_at[end] = value, s, ids[k]
                k += 1
            if width and not alone and at + begin + width <= n and here + model.unknown > held[at + width]:
                held[at + width], steps[at + width], ids_at[at + width] = here + model.unknown, width, -1
        filled = len(best[begin : stop + reach + 1])
        best[begin : begin + filled], step[begin : begin + filled], chosen[begin : begin + filled] = held[:filled], steps[:filled], ids_at[:filled]
    out, at = [], n
    back, names = step.tolist(), chosen.tolist()
    while at:
        s = back[at]
        out += [names[at]] if names[at] >= 0 else model.byte_ids[word[at - s : at]][::-1].tolist()
        at -= s
    return np.array(out[::-1], np.int32)


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _gather(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return values[np.repeat(first, count) + _within(count)]


def encode_rows(model: Pieces, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of whole texts; an empty text has none. A text longer than a slice is taken in parts that end before a space."""
    if len(starts) == 1 and ends[0] - starts[0] > 2 * _SLICE:
        text, ids, at = raw[starts[0] : ends[0]].tobytes().replace(_META, b" "), [], 0
        while at < len(text):
            stop = _space_after(text, at + _SLICE)
            ids.append(_encoded(model, [(b"" if at else b" ") + text[at:stop]])[0])
            at = stop
        return np.concatenate(ids), np.array([sum(map(len, ids))], np.int64)
    texts = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    return _encoded(model, [b" " + (t.replace(_META, b" ") if _META in t else t) if t else b"" for t in texts])


def _space_after(text: bytes, at: int) -> int:
    """The first place from ``at`` on where a run of spaces starts, or the text's end."""
    while 0 <= (at := text.find(b" ", at)) and text[at - 1 : at] == b" ":
        at += 1
    return at if at > 0 else len(text)


def _encoded(model: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of texts that start with their space."""
    size = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if not len(joined):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    space = joined == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    rows_at = np.cumsum(size) - size
    begin[rows_at[size > 0]] = True
    first = np.flatnonzero(begin)
    length = np.diff(np.append(first, len(joined)))
    for k in np.flatnonzero(length > LONG).tolist():
        begin[first[k] + _segments(model, joined[first[k] : first[k] + length[k]])] = True
    if (length > LONG).any():
        first = np.flatnonzero(begin)
        length = np.diff(np.append(first, len(joined)))
    with np.errstate(over="ignore"):
        value = (joined.astype(np.uint64) + np.uint64(1)) * constants(int(length.max()), 41)[_within(length)]
        name = mix64(np.add.reduceat(value, first) + length.astype(np.uint64) * constants(1, 43)[0])
    _, sample, word = np.unique(name, return_index=True, return_inverse=True)
    u_first, u_length = first[sample], length[sample]
    ids_of, count_of, from_of = [], np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
    made = 0
    order = np.argsort(u_length, kind="stable")
    edges = np.flatnonzero(np.diff(u_length[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        n = int(u_length[order[a]])
        rows = 1 if n > LONG else max(1, _WORK // (n * min(n, 24)))
        for k in range(a, b, rows):
            pick = order[k : min(b, k + rows)]
            if n > LONG:
                ids = _long_path(model, joined[u_first[pick[0]] : u_first[pick[0]] + n])
                count = np.array([len(ids)], np.int64)
            else:
                ids, count = _best_paths(model, joined[u_first[pick][:, None] + np.arange(n)])
            from_of[pick] = made + np.cumsum(count) - count
            count_of[pick] = count
            ids_of.append(ids)
            made += len(ids)
    ids = np.concatenate(ids_of)
    count = count_of[word]
    row = np.searchsorted(np.cumsum(size), first, side="right")
    return _gather(ids, from_of[word], count), np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)


def decode_rows(model: Pieces, ids: np.ndarray, count: np.ndarray) -> list[str]:
    """The texts that ids stand for; the space that encoding put in front is taken off, malformed bytes are replaced."""
    width = (model.first_of[1:] - model.first_of[:-1])[ids]
    data = _gather(model.bytes_of, model.first_of[ids], width).tobytes()
    stops = np.concatenate([[0], np.cumsum(width)])[np.cumsum(count)].tolist() if len(count) else []
    out, begin = [], 0
    for stop in stops:
        text = data[begin:stop]
        out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
        begin = stop
    return out


def encoded(text: str = "text", path: str | None = None) -> Column:
    """A struct of ids and their crc32 (as little-endian 32-bit numbers) for a text column; a null text has no ids."""

    @F.arrow_udf("struct<ids: array<int>, ids_crc32: bigint, n_byte_ids: int>")
    def encode(texts: pa.Array) -> pa.Array:
        model = pieces(path)
        raw, starts, ends = buffers(texts)
        flat, counts, crc, low = [], [], [], []
        is_byte = _byte_ids(model)
        for part in slices(starts, ends, _SLICE):
            ids, count = encode_rows(model, raw, starts[part], ends[part])
            flat.append(ids)
            counts.append(count)
            stops = np.cumsum(count)
            data = ids.astype("<i4").tobytes()
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
            low.append(bytes_before[stops] - bytes_before[stops - count])
            crc += [zlib.crc32(memoryview(data)[4 * (b - c) : 4 * b]) for b, c in zip(stops.tolist(), count.tolist())]
        flat_ids = np.concatenate(flat) if flat else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else np.zeros(1, np.int32)
        few = np.concatenate(low).astype(np.int32) if low else np.empty(0, np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_ids)), pa.array(crc, pa.int64()), pa.array(few)], names=["ids", "ids_crc32", "n_byte_ids"])

    return encode(F.col(text))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; a null array gives an empty text."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        count = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        return pa.array(decode_rows(pieces(path), np.asarray(lists.flatten(), np.int64), count), pa.string())

    return decode(ids)


def _byte_ids(model: Pieces) -> np.ndarray:
    out = np.zeros(len(model.first_of), bool)
    out[model.byte_ids] = True
    return out


def there_and_back(text: str = "text", path: str | None = None) -> Column:
    """Of a text column: the number of ids, of byte ids, the ids' crc32, and the text decoded from the ids as a digest and compared.

    Ids of a slice of rows are made, decoded and dropped again, so that no column of ids is held.
    """

    @F.arrow_udf("struct<n_ids: bigint, n_byte_ids: bigint, ids_crc32: bigint, decoded_sha256: string, round_trip: boolean>")
    def check(texts: pa.Array) -> pa.Array:
        model = pieces(path)
        is_byte = _byte_ids(model)
        raw, starts, ends = buffers(texts)
        out: tuple[list, ...] = ([], [], [], [], [])
        for part in slices(starts, ends, _SLICE):
            ids, count = encode_rows(model, raw, starts[part], ends[part])
            data = memoryview(ids.astype("<i4").tobytes())
            low = np.concatenate([[0], np.cumsum(is_byte[ids])])
            stops = np.cumsum(count)
            back = decode_rows(model, ids, count)
            for k, (stop, n, again) in enumerate(zip(stops.tolist(), count.tolist(), back), part.start):
                out[0].append(n)
                out[1].append(int(low[stop] - low[stop - n]))
                out[2].append(zlib.crc32(data[4 * (stop - n) : 4 * stop]))
                encoded_again = again.encode()
                out[3].append(hashlib.sha256(encoded_again).hexdigest())
                out[4].append(encoded_again == raw[starts[k] : ends[k]].tobytes().replace(_META, b" "))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return check(F.col(text))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_ids, n_byte_ids, ids_crc32, decoded_sha256, round_trip.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text has no ids and decodes to an empty
    one. round_trip says whether decoding gives the text again (with the mark of a space, U+2581, read as a space).
    """
    found = docs.select("doc_id", "text").withColumn("x", there_and_back(path=path))
    return found.select("doc_id", "x.n_ids", "x.n_byte_ids", "x.ids_crc32", "x.decoded_sha256", "x.round_trip")
