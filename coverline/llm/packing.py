"""Operator 9: packing token pieces into sequences by a grouping genetic algorithm on islands.

Texts are tokenised once. A document longer than a sequence is cut so that every piece but the first is full; full pieces
are sequences of their own. The others are dealt by hash into regions of about ``REGION`` pieces; each region is evolved
on ``ISLANDS`` islands. A population starts from best-fit packings alone: of decreasing, jittered and random orders. Crossover
injects the well-filled bins of one parent into the other, removes the bins that hold the same pieces, dissolves what is
loosely filled, and gives the displaced pieces back: best fit into the bins that stay, or into new bins that they fill exactly
where they can, whichever child needs fewer bins. Between epochs each island's elite moves to the next island (a join of small
rows), and at the end the pieces of loosely filled bins of all regions are dealt and evolved once more. ``searched`` tells for
each region how many bins its best start had and how many were left.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep
from .tokens import default_tokenizer, encoder

CAPACITY = 1024
END_ID = 2
REGION = 65536
ISLANDS, POPULATION = 3, 4
EPOCHS, GENERATIONS = 2, 4
#: Shares of one parent's bins that go over, and of the other's full bins that are dissolved.
INJECTED, DISSOLVED = (0.1, 0.5), (0.3, 0.7)
#: How many openings of a bin are tried for one that two more pieces end exactly.
TRIES = 24
#: Bins filled less than this are packed once more with those of other regions.
LOOSE = 0.97


def _tokenised(path: str | None, capacity: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            place, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                view, n = memoryview(ids), len(ids)
                a, b = 0, n - (n - 1) // capacity * capacity
                k = 0
                while a < n:
                    place.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(view[a:b]))
                    a, b, k = b, b + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


class Bins:
    """Open bins by room left; the tightest that fits is found in one step of bit arithmetic."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.mask = capacity, 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def open(self, room: int) -> int:
        self.count += 1
        self._put(self.count - 1, room)
        return self.count - 1

    def _put(self, label: int, room: int) -> None:
        if room:
            self.by_room[room].append(label)
            self.mask |= 1 << room

    def best_fit(self, size: int) -> int:
        fits = self.mask >> size
        if not fits:
            return self.open(self.capacity - size)
        room = size + (fits & -fits).bit_length() - 1
        rest = self.by_room[room]
        label = rest.pop()
        if not rest:
            self.mask ^= 1 << room
        self._put(label, room - size)
        return label


def best_fit(sizes: list[int], order: list[int], capacity: int) -> np.ndarray:
    bins, out = Bins(capacity), np.empty(len(sizes), np.int32)
    for i in order:
        out[i] = bins.best_fit(sizes[i])
    return out


def exact_fill(sizes: list[int], capacity: int, tries: int = TRIES) -> np.ndarray:
    """Each bin opens with the largest piece left and is ended exactly by one, two or three pieces if any do, else by the largest that fit.

    Bit x of a mask says whether a piece of size x is left; pieces that add up to a room are then a shift and an AND.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, x in enumerate(sizes):
        stacks[x].append(i)
    have = sum(1 << x for x in range(1, capacity + 1) if stacks[x])
    mirror = sum(1 << (capacity - x) for x in range(1, capacity + 1) if stacks[x])
    out, label = np.empty(len(sizes), np.int32), 0

    def take(x: int) -> None:
        nonlocal have, mirror
        out[stacks[x].pop()] = label
        if not stacks[x]:
            have ^= 1 << x
            mirror ^= 1 << (capacity - x)

    def pair(room: int) -> int:
        """The larger of two pieces that fill the room together; 0 if there are none."""
        both = have & (mirror >> (capacity - room)) & ((1 << room) - 1)
        if room % 2 == 0 and both >> (room // 2) & 1 and len(stacks[room // 2]) < 2:
            both ^= 1 << (room // 2)
        return both.bit_length() - 1 if both else 0

    while have:
        first = have.bit_length() - 1
        take(first)
        room = capacity - first
        while room and have & ((2 << room) - 1):
            if have >> room & 1:
                take(room)
                room = 0
                continue
            options, chosen = have & ((1 << room) - 1), 0
            largest = options.bit_length() - 1
            if two := pair(room):
                chosen = two
            else:
                for _ in range(tries):
                    if not options:
                        break
                    x = options.bit_length() - 1
                    options ^= 1 << x
                    rest = pair(room - x)
                    if rest and rest != x and room - x - rest != x:
                        chosen = x
                        break
            take(chosen or largest)
            room -= chosen or largest
        label += 1
    return out


def fitness(sizes: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewest bins first, then the fuller the full ones the better; smaller is fitter."""
    fill = np.bincount(bins, weights=sizes)
    return int((fill > 0).sum()), -float((fill * fill).sum())


def crossover(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Whole well-filled bins of ``giver`` go into ``taker``; bins that hold the same pieces go, and so do those that are not full.

    Some full bins are dissolved too: the small pieces they hold are what ends others exactly. The displaced pieces are
    best-fitted in jittered decreasing order, and, in a second child, fill new bins exactly where they can; the fitter child
    is returned.
    """
    draw = np.random.default_rng(rng.getrandbits(32)).random
    fill = np.bincount(giver, weights=sizes)
    full = fill >= (capacity if (fill == capacity).any() else capacity * 0.98)
    full &= draw(len(fill)) < rng.uniform(*INJECTED)
    given = full[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[given]] = True
    hit |= np.bincount(taker, weights=sizes) < capacity
    hit |= draw(len(hit)) < rng.uniform(*DISSOLVED)
    stay = ~given & ~hit[taker]
    kept, bins = np.empty(len(sizes), np.int32), Bins(capacity)
    for labels, mask in ((giver, given), (taker, stay)):
        old, new = np.unique(labels[mask], return_inverse=True)
        room = capacity - np.bincount(new, weights=sizes[mask], minlength=len(old)).astype(int)
        base = bins.count
        for r in room.tolist():
            bins.open(r)
        kept[mask] = base + new
    loose = np.flatnonzero(~given & ~stay)
    if not len(loose):
        return kept
    fitted, filled = kept.copy(), kept.copy()
    filled[loose] = bins.count + exact_fill(sizes[loose].tolist(), capacity)
    order = loose[np.argsort(-sizes[loose] * np.array([rng.uniform(0.97, 1.03) for _ in loose]), kind="stable")]
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitted[i] = bins.best_fit(size)
    return min((filled, fitted), key=lambda x: fitness(sizes, x))


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Dissolve the emptiest bins and some others at random, and best-fit their pieces among the rest."""
    fill = np.bincount(bins, weights=sizes)
    keep_bin = np.ones(len(fill), bool)
    keep_bin[np.argsort(fill)[: max(1, len(fill) // 50)]] = False
    keep_bin[[rng.randrange(len(fill)) for _ in range(max(1, len(fill) // 20))]] = False
    stay = keep_bin[bins]
    out, left = np.empty(len(sizes), np.int32), Bins(capacity)
    old, new = np.unique(bins[stay], return_inverse=True)
    for r in (capacity - np.bincount(new, weights=sizes[stay], minlength=len(old)).astype(int)).tolist():
        left.open(r)
    out[stay] = new
    loose = np.flatnonzero(~stay)
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        out[i] = left.best_fit(size)
    return out


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, seed: int) -> list[np.ndarray]:
    """The population after some generations, the fittest first; a start is best-fit packings, and the search ends at the lower bound."""
    rng = random.Random(seed)
    bound = -(-int(sizes.sum()) // capacity)
    listed = sizes.tolist()
    while len(population) < POPULATION:
        # decreasing, twice nearly so, and at random
        jitter = (0.0, 0.02, 0.05, None)[len(population) % 4]
        order = sorted(range(len(listed)), key=lambda i: rng.random() if jitter is None else -listed[i] * (1 + rng.uniform(-jitter, jitter)))
        population.append(best_fit(listed, order, capacity))
    ranked = sorted(((fitness(sizes, x), k, x) for k, x in enumerate(population)), key=lambda r: r[:2])
    serial = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] == bound:
            break
        children = []
        for _ in range(max(2, POPULATION // 2)):
            a, b = (min(rng.sample(range(len(ranked)), min(2, len(ranked)))) for _ in range(2))
            child = crossover(sizes, ranked[a][2], ranked[b][2], capacity, rng) if a != b else mutate(sizes, ranked[a][2], capacity, rng)
            if rng.random() < 0.3:
                child = mutate(sizes, child, capacity, rng)
            children.append((fitness(sizes, child), serial, child))
            serial += 1
        ranked = sorted([*ranked, *children], key=lambda r: r[:2])[:POPULATION]
    return [x for _, _, x in ranked]


def _epoch(capacity: int, generations: int, epoch: int):
    kinds = pa.schema([("region", pa.int64()), ("island", pa.int32()), ("items", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("population", pa.list_(pa.list_(pa.int32()))), ("n_start", pa.int64()), ("n_bins", pa.int64()), ("square", pa.float64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, seed = np.array(row["sizes"], np.int64), hash((row["region"], row["island"], epoch))
                population = [np.array(x, np.int32) for x in (row["population"] or []) + ([row["elite"]] if row["elite"] else [])]
                started = row["n_start"]
                if started is None:
                    population = evolve(sizes, population, capacity, 0, seed)
                    started = fitness(sizes, population[0])[0]
                population = evolve(sizes, population, capacity, generations, seed)
                least, square = fitness(sizes, population[0])
                yield pa.RecordBatch.from_pylist(
                    [{"region": row["region"], "island": row["island"], "items": row["items"], "sizes": row["sizes"], "population": [x.tolist() for x in population], "n_start": started, "n_bins": least, "square": square}],
                    kinds,
                )

    return step


_STATE = "region long, island int, items array<long>, sizes array<long>, population array<array<int>>, n_start long, n_bins long, square double"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each region's best packing: every item with its bin, place in it and the bin's fill."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes, bins = np.array(row["sizes"], np.int64), np.array(row["best"], np.int64)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(fill)])[:-1]
            offset = np.empty(len(sizes), np.int64)
            offset[order] = before - first[bins[order]]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["region"], np.int64)), pa.array(row["items"], pa.int64()), pa.array(sizes), pa.array(bins), pa.array(offset), pa.array(fill[bins])], names=["region", "item_id", "length", "bin", "offset", "fill"])


def searched(items: DataFrame, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """(region, items, sizes, best, bound, n_start, n_bins) for items (item_id, length below capacity): a region's best packing,
    the least number of bins there could be, that of its best start and that of the search's end."""
    n_regions = max(1, -(-items.count() // region))
    dealt = items.select("item_id", "length", F.pmod(F.xxhash64("item_id"), F.lit(n_regions)).alias("region"))
    rows = dealt.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("item_id", "length"))).alias("x"))
    rows = rows.select("region", F.col("x.item_id").alias("items"), F.col("x.length").alias("sizes"))
    fresh = {"population": F.lit(None).cast("array<array<int>>"), "elite": F.lit(None).cast("array<int>"), "n_start": F.lit(None).cast("long")}
    state = rows.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS))))).withColumns(fresh)
    before = None
    for epoch in range(EPOCHS):
        spread = state.select("region", "island", "items", "sizes", "population", "elite", "n_start").repartition("region", "island")
        last, before = before, keep(spread.mapInArrow(_epoch(capacity, GENERATIONS, epoch), _STATE), "islands")
        if last is not None:
            drop(last)
        state = before
        if epoch + 1 < EPOCHS:
            moved = state.select("region", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(moved, ["region", "island"], "left")
    best = state.groupBy("region").agg(F.min_by(F.struct("items", "sizes", F.col("population")[0].alias("best"), "n_bins"), F.struct("n_bins", "square", "island")).alias("x"), F.min("n_start").alias("n_start"))
    total = F.aggregate("x.sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    return best.select("region", "x.items", "x.sizes", "x.best", F.ceil(total / capacity).alias("bound"), "n_start", "x.n_bins")


def pack_items(items: DataFrame, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """(region, item_id, length, bin, offset, fill) for items (item_id, length below capacity)."""
    best = searched(items, capacity, region).select("region", "items", "sizes", "best")
    return best.mapInArrow(_placed, "region long, item_id long, length long, bin long, offset long, fill long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text is the end id alone. Rows are packed
    one by one, so repeated doc_ids give repeated pieces. An empty table gives no rows.
    """
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenised(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = keep(tokens.withColumn("item_id", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("item_id", "length")
    first = keep(pack_items(short, capacity), "packed")
    loose = F.col("fill") < int(capacity * LOOSE)
    second = keep(pack_items(first.where(loose).select("item_id", "length"), capacity), "packed")

    def numbered(df: DataFrame, round_: int) -> DataFrame:
        return df.select("item_id", (((F.col("region") * 2 + round_) * 2 * capacity * REGION) + F.col("bin") * 2).alias("sequence_id"), "offset")

    places = numbered(first.where(~loose), 0).unionByName(numbered(second, 1))
    out = pieces.join(places, "item_id", "left")
    alone = F.col("length") == capacity
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(alone, F.col("item_id") * 2 + 1).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    )
