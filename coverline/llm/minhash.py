"""Operator 10: near duplicates by b-bit MinHash.

Per distinct set of word shingles, ``BANDS`` bands of ``ROWS`` minima propose candidates; only the low ``BITS`` bits of
each minimum are kept for the estimate, packed in 64-bit words and compared by counting bits, with the chance of an
accidental match taken out. Pairs that the estimate cannot rule out are confirmed on the full shingle sets.

With 40 bands of 4, a pair at the threshold of 0.75 shares no band with probability 3e-7; the estimate of such a pair
falls below ``SLACK`` under the threshold (over five standard errors) about as rarely.

Work stays linear in the copies: equal sets are one node before banding. Buckets come from one sort by (key, node) over
ranges that split a bucket as readily as they part two, so no task holds a large one. A bucket is cut into pieces of bounded
size; each row is first linked to the head of its piece, and heads to one another. In buckets that still hold several
components, rows outside the largest one visit every other piece, so that each pair across components meets: by signatures
first, and only under the first key that both rows share. A group with few pairs left gives these pairs, one with many its
rows; both are confirmed on full sets, and only links that join something are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop, keep
from .textkit import buffers, constants, mix64, slices, word_hashes, words

SHINGLE = 5
BANDS, ROWS, BITS = 40, 4, 2
SLACK = 0.22
#: Shingles of a bucket's rows that are compared at once, and what a row counts at least.
PIECE, LEAST = 1 << 18, 1 << 8
#: Rows that visit a piece at once.
VISITORS = 1024
#: Open pairs to a row up to which a group gives pairs instead of rows: a pair ships one set, as a row does.
PAIRS = 1
#: Minima that fit one 64-bit word, and the mask of their lowest bits.
_LANES = 64 // BITS
_LOW = sum(1 << (BITS * i) for i in range(_LANES))
_PACKS = BANDS * ROWS // _LANES
_NOBODY = np.iinfo(np.int64).min
#: Bits for each mark in the filter by which texts are found again, at least in all and at most (32 MB, for some 16 million marks); more marks
#: than that meet the texts by a join.
FILTER_BITS, LEAST_FILTER, MOST_FILTER = 16, 1 << 20, 1 << 28


def _shingle_hashes(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every row, rows in order, with the counts of each row."""
    count = np.bincount(row, minlength=rows)
    weights = constants(SHINGLE, 99)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    parts, at = [], []
    with np.errstate(over="ignore"):
        n = len(hashes) - SHINGLE + 1
        if n > 0:
            same = np.flatnonzero(row[: n] == row[SHINGLE - 1 :])
            total = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                total += hashes[k : k + n] * weights[k]
            parts.append(mix64(total[same]))
            at.append(row[same])
        few = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(few):
            total = np.zeros(len(few), np.uint64)
            for k in range(SHINGLE - 1):
                have = count[few] > k
                total[have] += hashes[first[few[have]] + k] * weights[k]
            parts.append(mix64(total + count[few].astype(np.uint64) * constants(1, 5)[0]))
            at.append(few)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    value, place = np.concatenate(parts), np.concatenate(at)
    order = np.argsort(place, kind="stable")
    return value[order], np.bincount(place, minlength=rows)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, empty sets too."""
    raw, starts, ends = buffers(texts)
    for part in slices(starts, ends):
        row, first, last, joined = words(raw, starts[part], ends[part])
        value, count = _shingle_hashes(row, word_hashes(joined, first, last), part.stop - part.start)
        stops = np.cumsum(count).tolist()
        begin = 0
        for i, stop in enumerate(stops):
            yield part.start + i, np.unique(value[begin:stop])
            begin = stop


def node_of(shingles: np.ndarray) -> int:
    """The name of a shingle set: 64 bits (signed) that depend on all its members."""
    with np.errstate(over="ignore"):
        total = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix64(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest 32-bit value of the set under each of BANDS * ROWS hash functions."""
    multiply = constants(BANDS * ROWS, 17).astype(np.uint32) | np.uint32(1)
    flip = (constants(BANDS * ROWS, 23) >> np.uint64(32)).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        part = x[None, k : k + 512] ^ flip[:, None]
        part *= multiply[:, None]
        # the product's high half depends on all bits of x, its low half does not
        np.minimum(out, part.min(axis=1), out=out)
    return out


def sketch(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the minima: a 64-bit key per band, and the packed low bits."""
    with np.errstate(over="ignore"):
        weights = constants(ROWS, 31)
        bands = (least.reshape(BANDS, ROWS).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        keys = mix64(bands + constants(BANDS, 37))
        # low bits of a minimum are spread anew, as multiplication leaves patterns in them
        low = (mix64(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(_PACKS, _LANES)
        packed = (low << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, node, keys, packs = [], [], [], []
        for _, found in shingle_sets(batch.column(1)):
            count.append(len(found))
            if len(found):
                a, b = sketch(minima(found))
                node.append(node_of(found))
                keys.append(a)
                packs.append(b)
            else:
                node.append(None)
        offsets = np.concatenate([[0], np.cumsum([n is not None for n in node])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        table = np.stack(packs) if packs else np.empty((0, _PACKS), np.int64)
        place = np.where([n is not None for n in node], offsets[:-1], -1)
        signature = [pa.array([int(table[p, j]) if p >= 0 else None for p in place.tolist()], pa.int64()) for j in range(_PACKS)]
        bands = pa.ListArray.from_arrays(pa.array(offsets * BANDS, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(node, pa.int64()), bands, *signature],
            names=["doc_id", "n_shingles", "node", "bands", *(f"s{j}" for j in range(_PACKS))],
        )


def _has(wanted: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (wanted[bit >> 3] >> (bit & 7) & 1).astype(bool)


def _sets_where(wanted: np.ndarray | None):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, mark, shingles) of the rows (mark, text) whose mark is in the filter, or of all; most of the others never leave their task."""
        for batch in batches:
            mark, texts = batch.column(0).to_numpy(), batch.column(1)
            if wanted is not None:
                last = 8 * len(wanted) - 1
                mine = _has(wanted, mark & last) & _has(wanted, (mark >> 32) & last)
                mark, texts = mark[mine], texts.filter(pa.array(mine))
            node, held, marks, size = [], [], [], 0
            for i, found in shingle_sets(texts):
                if len(found):
                    node.append(node_of(found))
                    held.append(found.view(np.int64))
                    marks.append(mark[i])
                    size += len(found)
                if size > 1 << 20:
                    yield _set_batch(node, marks, held)
                    node, held, marks, size = [], [], [], 0
            yield _set_batch(node, marks, held)

    return sets


def _set_batch(node: list[int], marks: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(marks, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["node", "mark", "shingles"])


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: matching lanes by bit counts, less those that match by chance."""
    differing = F.lit(0)
    for j in range(_PACKS):
        x = F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        differing = differing + F.bit_count(folded.bitwiseAND(F.lit(_LOW)))
    match = 1 - differing / F.lit(float(BANDS * ROWS))
    chance = 2.0**-BITS
    return (match - chance) / (1 - chance)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, node): those that share their key, with their piece and what they are linked to.

    A row is linked to the head of its piece, a head to the piece's before it, a bucket's first row to itself. A key may go
    on in the task before or after: the first row of a task's first and last bucket comes once more, marked as edge.
    """
    place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    carry: list[np.ndarray] | None = None
    key_now, weight, piece_now, head, above, top, made, first = None, 0, -1, 0, 0, 0, 0, True

    def batch_of(*columns) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "piece", "node", "link", "edge"])

    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(3)]
        key, node, n = rows if carry is None else [np.concatenate(x) for x in zip(carry, rows)]
        carry = None
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = key[0] != key_now
        if new[-1] and not (first and new.sum() == 1):
            # whether it stands alone is seen in the next batch
            carry = [key[-1:], node[-1:], n[-1:]]
            key, node, n, new = key[:-1], node[:-1], n[:-1], new[:-1]
            if not len(key):
                continue
        run = np.cumsum(new)
        size = np.bincount(run)
        w = np.maximum(n, LEAST)
        before = np.cumsum(w) - w
        begin = np.concatenate([[-weight], before[new]])
        piece = (before - begin[run]) // PIECE
        turn = new.copy()
        turn[1:] |= piece[1:] != piece[:-1]
        turn[0] |= piece[0] != piece_now
        at = np.maximum.accumulate(np.where(turn, np.arange(len(key)), -1))
        heads = np.where(at >= 0, node[at], head)
        last_head = np.concatenate([[head], heads[:-1]])
        link = np.where(new, node, np.where(turn, last_head, heads))
        number = place + made + np.cumsum(turn)
        shown = (size[run] > 1) | (run == 0)
        if first:
            shown |= run == 1
            yield batch_of(key[:1], number[:1], node[:1], node[:1], [True])
            first = False
        yield batch_of(key[shown], number[shown], node[shown], link[shown], np.zeros(int(shown.sum()), bool))
        starts = np.flatnonzero(new)
        if len(starts):
            top, weight = node[starts[-1]], 0
            begin_last = starts[-1]
        else:
            begin_last = 0
        weight += int(w[begin_last:].sum())
        key_now, piece_now, head, made = key[-1], piece[-1], heads[-1], made + int(turn.sum())
    if carry is not None:
        key, node, _ = carry
        yield batch_of(key, [place + made + 1], node, node, [False])
        yield batch_of(key, [place + made + 1], node, node, [True])
    elif key_now is not None:
        yield batch_of([key_now], [place + made], [top], [top], [True])


def _fits(a: Column, b: Column, threshold: float) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * F.lit(round(threshold * 100))


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes and estimate do not rule them out, with the marks of both."""
    signs = nodes.select("node", F.struct("n_shingles", "mark", *(f"s{j}" for j in range(_PACKS))).alias("sign"))
    both = pairs.join(signs.select(F.col("node").alias("a"), F.col("sign").alias("sign_a")), "a").join(signs.select(F.col("node").alias("b"), F.col("sign").alias("sign_b")), "b")
    likely = _fits(F.col("sign_a.n_shingles"), F.col("sign_b.n_shingles"), threshold) & (estimate("sign_a", "sign_b") >= threshold - SLACK)
    return both.where(likely).select("a", "b", F.col("sign_a.mark").alias("mark_a"), F.col("sign_b.mark").alias("mark_b"))


def _sets_of(marks: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """(node, mark, shingles) of the documents with the given marks, and of few others, made anew from their texts.

    The marks become a filter, two bits for each mark, whose size follows their number and which goes to every task: texts stay where they
    are. What else the filter lets through meets nothing, as sets are joined by node and mark. Marks that are too many for
    ``MOST_FILTER`` bits meet the texts by a join. Where ids repeat, of rows that have both in common one stays.
    """
    texts = docs.select(_mark(F.col("doc_id")).alias("mark"), "text").where("text is not null")
    asked = marks.select("mark").distinct()
    size = LEAST_FILTER
    n = asked.count()
    while size < FILTER_BITS * n:
        size *= 2
    if size > MOST_FILTER:
        texts, packed = texts.join(asked, "mark", "left_semi"), None
    else:
        bits = asked.select(F.explode(F.array(F.col("mark").bitwiseAND(F.lit(size - 1)), F.shiftright("mark", 32).bitwiseAND(F.lit(size - 1)))).alias("bit"))
        found = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()  # size / 8 bytes in all at most
        packed = np.zeros((size >> 15, 1 << 12), np.uint8)
        for r in found:
            packed[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
        packed = packed.ravel()
    sets = texts.mapInArrow(_sets_where(packed), "node long, mark long, shingles array<long>")
    return keep(sets.dropDuplicates(["node", "mark"]) if repeated else sets, "sets")


def _mark(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"))


def _confirmed(pairs: DataFrame, docs: DataFrame, repeated: bool, threshold: float) -> DataFrame:
    """The pairs (a, b, mark_a, mark_b) whose full sets reach the threshold, as a table."""
    sets = _sets_of(pairs.select(F.explode(F.array("mark_a", "mark_b")).alias("mark")), docs, repeated)
    named = lambda side: sets.select(F.col("node").alias(side), F.col("mark").alias(f"mark_{side}"), F.col("shingles").alias(f"set_{side}"))
    both = pairs.join(named("a"), ["a", "mark_a"]).join(named("b"), ["b", "mark_b"])
    both = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    out = keep(both.where(F.col("shared") * 100 >= union * F.lit(round(threshold * 100))).select("a", "b"), "links")
    drop(sets)
    return out


def _by_group(work):
    """Rows come sorted by group; ``work`` is done on runs of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            whole = pa.concat_tables(held)
            group = _groups(whole)
            last = np.flatnonzero(group != group[-1])
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield work(whole.slice(0, stop))
            held = [whole.slice(stop)]
        if held:
            yield work(pa.concat_tables(held))

    return run


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _groups(table: pa.Table) -> np.ndarray:
    """A number for each run of equal (key, here, turn)."""
    change = np.zeros(table.num_rows, np.int64)
    for name in ("key", "here", "turn"):
        x = _column(table, name)
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def _each_group(table: pa.Table, threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, stop, i, j) of every group with the pairs in it that are still open."""
    group = _groups(table)
    key, here, turn, piece, comp, main, size = (_column(table, c) for c in ("key", "here", "turn", "piece", "comp", "main", "n_shingles"))
    sign = np.stack([_column(table, f"s{j}") for j in range(_PACKS)]).view(np.uint64)
    lists = table.column("bands").combine_chunks()
    bands = np.asarray(lists.flatten()).reshape(-1, BANDS)
    begin = 0
    for stop in (np.flatnonzero(np.diff(group, append=group[-1] + 1)) + 1).tolist():
        at = slice(begin, stop)
        i, j = _open_pairs(comp[at], piece[at] == here[begin], comp[at] == main[at], piece[at], turn[begin] == 0, size[at], sign[:, at], threshold)
        if len(i):
            # a pair belongs to the first key that both share
            first = np.concatenate([(bands[begin + i[k : k + 65536]] == bands[begin + j[k : k + 65536]]).argmax(axis=1) for k in range(0, len(i), 65536)])
            mine = bands[begin + i, first] == key[begin]
            i, j = i[mine], j[mine]
        yield begin, stop, i, j
        begin = stop


def _open_rows(threshold: float):
    def rows(table: pa.Table) -> pa.RecordBatch:
        """What is open in each group: pairs (node, other) if they are few, else the rows that are in one, without other."""
        node, take, other = _column(table, "node"), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for begin, _, i, j in _each_group(table, threshold):
            mine = np.unique(np.concatenate([i, j]))
            few = len(i) <= PAIRS * len(mine)
            take.append(begin + (i if few else mine))
            other.append(node[begin + j] if few else np.full(len(mine), _NOBODY))
        other = np.concatenate(other)
        found = table.take(pa.array(np.concatenate(take)))
        return found.append_column("other", pa.array(other, mask=other == _NOBODY)).combine_chunks().to_batches()[0] if len(other) else pa.RecordBatch.from_pylist([], table.schema.append(pa.field("other", pa.int64())))

    return rows


def _links(threshold: float):
    def links(table: pa.Table) -> pa.RecordBatch:
        """Confirmed links that join what was apart."""
        node, comp = _column(table, "node"), _column(table, "comp")
        lists = table.column("shingles").combine_chunks()
        at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        found: list[tuple[int, int]] = []
        for begin, stop, i, j in _each_group(table, threshold):
            if len(i):
                sets = [flat[at[k] : at[k + 1]] for k in range(begin, stop)]
                shared = _shared(sets, i, j)
                size = np.array([len(x) for x in sets])
                good = 100 * shared >= round(threshold * 100) * (size[i] + size[j] - shared)
                found += _forest(node[begin:stop], comp[begin:stop], i[good], j[good])
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return links


def _open_pairs(comp: np.ndarray, own: np.ndarray, main: np.ndarray, piece: np.ndarray, first: bool, size: np.ndarray, sign: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that sizes and estimate do not rule out, by shifts of one row at a time.

    A group holds a piece's own rows and some that visit it. Own rows meet each other in the piece's first group; a visitor
    meets own rows of the largest component, and others if it comes from an earlier piece, as they visit its piece too.
    """
    chance, low, least = 2.0**-BITS, np.uint64(_LOW), round(threshold * 100)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, len(comp)):
        a, b = slice(None, -d), slice(d, None)
        meets = np.where(own[a] & own[b], first, (own[a] & (main[a] | (piece[b] < piece[a]))) | (own[b] & (main[b] | (piece[a] < piece[b]))))
        meets &= own[a] | own[b]
        i = np.flatnonzero(meets & (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])))
        if not len(i):
            continue
        x = sign[:, i] ^ sign[:, i + d]
        folded = x.copy()
        for k in range(1, BITS):
            folded |= x >> np.uint64(k)
        match = 1 - np.bitwise_count(folded & low).sum(axis=0) / (BANDS * ROWS)
        i = i[(match - chance) / (1 - chance) >= threshold - SLACK]
        left.append(i)
        right.append(i + d)
    return np.concatenate(left), np.concatenate(right)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles each pair of sets has in common: few pairs by merging, many by rows of bits."""
    if len(i) <= 32:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    use = several[name]
    owner, name = owner[use], number[name[use]]
    out, width = np.zeros(len(i), np.int64), 1 << 14
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    for first in range(0, int(several.sum()), width):
        a, b = np.searchsorted(name, [first, first + width])
        bits = np.zeros((len(sets), width), np.uint8)
        bits[owner[a:b], name[a:b] - first] = 1
        packed = np.packbits(bits, axis=1).view(np.uint64)
        packed = packed[:, packed.any(axis=0)]
        for k in range(0, len(i), 8192):
            out[k : k + 8192] += np.bitwise_count(packed[i[k : k + 8192]] & packed[j[k : k + 8192]]).sum(axis=1, dtype=np.int64)
    return out


def _forest(node: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of confirmed links, those that join components not yet joined here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = root(int(comp[a])), root(int(comp[b]))
        if p != q:
            parent[p] = q
            out.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are not read. Null and empty texts, and texts without words, have an
    empty set and are linked with nothing. Rows that repeat are linked as equal sets. Rows without a doc_id take part;
    a component made of such rows alone has a null component_id, and they are kept. Names of sets are 64-bit hashes.
    """
    signature = [f"s{j}" for j in range(_PACKS)]
    sketches = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches, f"doc_id long, n_shingles long, node long, bands array<long>, {', '.join(f'{s} long' for s in signature)}"), "sketches")
    one = F.struct("bands", *signature)
    whole = keep(sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first(one).alias("x")).select("node", "first_id", _mark(F.col("first_id")).alias("mark"), "n_shingles", "x.*"), "nodes")
    listed = keep(sketches.select("doc_id", "n_shingles", "node"), "documents")
    drop(sketches)
    repeated = not listed.groupBy("doc_id").count().where("count > 1").isEmpty()

    rows = whole.select(F.explode("bands").alias("key"), "node", "n_shingles").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    runs = keep(rows.mapInArrow(_runs, "key long, piece long, node long, link long, edge boolean"), "runs")
    nodes = whole.drop("bands")
    edges = runs.where("edge").select("key", "node").distinct()
    across = edges.join(edges.groupBy("key").agg(F.min("node").alias("link")), "key")  # at most two rows a task
    pairs = runs.where("not edge").select("link", "node").unionByName(across.select("link", "node")).where("link <> node")
    star = keep(_likely(pairs.select(F.col("link").alias("a"), F.col("node").alias("b")).distinct(), nodes, threshold), "likely")
    links = _confirmed(star, docs, repeated, threshold)
    drop(star)
    labels = components(links)

    # buckets that still hold several components: rows outside the largest visit the other pieces
    placed = runs.where("not edge").select("key", "piece", "node").join(labels, "node", "left").select("key", "piece", "node", F.coalesce("label", "node").alias("comp"))
    parts = keep(placed.groupBy("key", "piece", "comp").agg(F.count("*").alias("n")), "pieces")
    per = parts.groupBy("key", "comp").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    pieces = parts.select("key", "piece").distinct().join(per.select("key", "main", F.ceil((F.col("n") - F.col("most")) / VISITORS).cast("long").alias("turns")), "key")
    own = placed.join(pieces, ["key", "piece"])
    visitors = own.where("comp <> main").withColumn("turn", F.pmod(F.xxhash64("node"), F.col("turns")))
    visits = visitors.join(pieces.select("key", F.col("piece").alias("here")), "key").where("here <> piece").select("key", "here", "turn", "piece", "node", "comp", "main")
    # a piece's own rows are there each time that others come; it is one time if none do
    turns = visits.select("key", F.col("here").alias("piece"), "turn").unionByName(pieces.select("key", "piece", F.lit(0).cast("long").alias("turn"))).distinct()
    homes = own.join(turns, ["key", "piece"]).select("key", F.col("piece").alias("here"), "turn", "piece", "node", "comp", "main")
    signs = whole.select("node", "mark", "n_shingles", *signature, "bands")
    columns = ["key", "here", "turn", "piece", "node", "mark", "comp", "main", "n_shingles", *signature]
    kinds = ", ".join(f"{c} long" for c in columns) + ", bands array<long>"
    # by ranges, which share groups out evenly
    dealt = lambda df: df.repartitionByRange("key", "here", "turn").sortWithinPartitions("key", "here", "turn")
    spread = dealt(homes.unionByName(visits).join(signs, "node").select(*columns, "bands"))
    unruled = keep(spread.mapInArrow(_by_group(_open_rows(threshold)), f"{kinds}, other long"), "open")
    drop(runs, parts, labels)
    ends = unruled.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    marks = nodes.select("node", "mark")
    ends = keep(ends.join(marks.select(F.col("node").alias("a"), F.col("mark").alias("mark_a")), "a").join(marks.select(F.col("node").alias("b"), F.col("mark").alias("mark_b")), "b"), "likely")
    apart = _confirmed(ends, docs, repeated, threshold)
    crowded = unruled.where("other is null")
    sets = _sets_of(crowded.select("mark"), docs, repeated)
    full = dealt(crowded.join(sets, ["node", "mark"]).select(*columns, "bands", "shingles"))
    again = keep(full.mapInArrow(_by_group(_links(threshold)), "a long, b long").distinct(), "again")
    drop(unruled, ends, sets)
    both = keep(links.unionByName(apart).unionByName(again), "links")
    drop(links, apart, again)
    labels = components(both)

    named = nodes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = keep(named.join(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "label").select("node", "component_id"), "named")
    drop(both, labels, whole)
    out = listed.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
