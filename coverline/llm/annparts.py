"""Operator 6: nearest neighbours by learned partitions.

On a bounded sample a graph of near neighbours is built and cut into parts of equal size so that few neighbours are
parted; a small classifier then learns which part a vector belongs to. It places every row in its most probable part and
sends a query to the most probable ones, where the exact distance ranks the candidates. How many parts a query visits is
measured: on sample rows that the classifier has not seen, the fewest that reach ``TARGET`` of the true neighbours. Where
vectors have no structure to learn, that is most of the parts. A part is dealt over blocks of about ``BLOCK`` rows; a task
holds one block, past which the queries stream, and of each block only k rows a query go on. The number of parts grows with
the table up to ``MOST_PARTS``, and the sample with the number of parts; beyond that parts grow, and blocks with them in number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in the sample: this many, or so many a part if that is more (16,384 at most).
SAMPLE, SAMPLE_PART, GRAPH_K, HIDDEN = 6000, 16, 10, 64
#: Rows to a part at first; the number of parts lies between the two bounds.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 8, 1024
TARGET, UNSEEN = 0.95, 0.2
BLOCK = 4096


@dataclass
class Router:
    """A network of one hidden layer from a vector to part scores."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, in blocks of rows."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = square[a : a + 512, None] + square[None] - 2 * (x[a : a + 512] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Parts of equal size (5 per cent slack) that cut few edges: balanced bisection along the main direction, then moves to where neighbours are."""
    n = len(x)
    label = np.zeros(n, np.int64)
    groups = [(np.arange(n), parts)]
    made = 0
    while groups:
        rows, p = groups.pop()
        if p <= 1:
            label[rows] = made
            made += 1
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred[: 4 * x.shape[1] + 200], full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(x.shape[1])
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = p // 2
        cut = len(order) * left // p
        groups += [(order[:cut], left), (order[cut:], p - left)]
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    most = int(np.ceil(n / parts * 1.05))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (both[0], label[both[1]]), 1)
        here = votes[np.arange(n), label]
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - here
        count = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain + rng.uniform(0, 0.1, n)).tolist():
            if gain[i] <= 0:
                break
            if count[want[i]] < most:
                count[label[i]] -= 1
                count[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if moved < n // 500:
            break
    return label


def train_router(x: np.ndarray, target: np.ndarray, parts: int, seed: int = 1, epochs: int = 25) -> Router:
    """Cross-entropy against soft targets (the share of each part among a row and its neighbours), by Adam."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            xs = x[pick]
            hidden = np.maximum(xs @ params[0] + params[1], 0)
            z = hidden @ params[2] + params[3]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - target[pick]) / len(pick)
            dh = dz @ params[2].T * (hidden > 0)
            step += 1
            for q, g, m, v in zip(params, (xs.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(0)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(*params)


def fit(x: np.ndarray, parts: int, seed: int = 1) -> tuple[Router, float, int]:
    """A router over a sample, the factor that brings vectors to unit scale, and how many parts a query visits."""
    scale = float(1 / (np.sqrt((x * x).sum(axis=1).mean()) + 1e-12)) * x.shape[1] ** 0.5
    x = x * scale
    parts = max(1, min(parts, len(x)))
    k = min(GRAPH_K, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), scale, 1
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), label] = 1.0
    for j in range(k):
        np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 1 / k)
    target /= target.sum(axis=1, keepdims=True)
    unseen = np.random.default_rng(seed).random(len(x)) < UNSEEN
    router = train_router(x[~unseen], target[~unseen], parts)
    order = np.argsort(-router.scores(x), axis=1, kind="stable")
    asked = order[unseen] if unseen.any() else order
    homes = order[:, 0][graph[unseen] if unseen.any() else graph]
    place = np.argmax(asked[:, None, :] == homes[:, :, None], axis=2)
    reached = [(place < m).mean() for m in range(1, parts + 1)]
    return router, scale, next(m for m, share in enumerate(reached, 1) if share >= TARGET)


def usable(vector: Column) -> Column:
    """Not null, not all zero, and no component null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    return np.asarray(vectors.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _ranked(k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, candidates before queries: a block's candidates are held while its queries stream past."""
        here, held, block = None, [], None
        for batch in batches:
            parts, blocks, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero((parts[1:] != parts[:-1]) | (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
                if a == b:
                    continue
                if here != (parts[a], blocks[a]):
                    here, held, block = (parts[a], blocks[a]), [], None
                ids, vectors = batch.column(3).to_numpy()[a:b], _matrix(batch.column(4).slice(a, b - a))
                if not asks[a]:
                    held.append((ids, vectors))
                elif held:
                    block = block or Block(*(np.concatenate(x) for x in zip(*held)))
                    yield block.nearest(ids, vectors, k)

    return rank


class Block:
    """Candidates of one block, by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.square = (self.vectors * self.vectors).sum(axis=1)
        self.starts = np.flatnonzero(np.append(True, self.ids[1:] != self.ids[:-1]))
        self.repeated = len(self.starts) < len(self.ids)

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
        """Each query's k nearest ids. Products find what may be among them, differences measure it.

        Products are off by far less than the margin, so whatever is as near as the k-th is measured on the original
        vectors, and near copies come out exact. Of an id that repeats, the nearest row counts.
        """
        found: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), 64):
            part = q[a : a + 64]
            square = (part * part).sum(axis=1)
            rough = square[:, None] + self.square[None] - 2 * (part @ self.vectors.T)
            margin = 1e-9 * (square + self.square.max())
            own = q_ids[a : a + 64]
            rough[self.ids[None, :] == own[:, None]] = np.inf
            each = np.minimum.reduceat(rough, self.starts, axis=1) if self.repeated else rough  # the nearest row of each id
            kth = np.partition(each, k - 1, axis=1)[:, k - 1] if each.shape[1] > k else np.full(len(part), np.inf)
            for i in range(len(part)):
                near = np.flatnonzero(rough[i] <= kth[i] + 2 * margin[i])
                near = near[self.ids[near] != own[i]]
                distance = np.sqrt(((self.vectors[near] - part[i]) ** 2).sum(axis=1))
                best = np.lexsort((self.ids[near], distance))
                if self.repeated:
                    _, first = np.unique(self.ids[near][best], return_index=True)
                    best = best[np.sort(first)]
                best = best[:k]
                best = best[np.isfinite(distance[best])]
                found[0].append(np.full(len(best), own[i]))
                found[1].append(self.ids[near][best])
                found[2].append(distance[best])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["query_id", "vec_id", "score"])


def visits(order: np.ndarray, probes: int, held: np.ndarray | None, k: int) -> pa.ListArray:
    """Of each row's parts in order the first ``probes``, and as many more as it takes to hold k candidates besides the row itself."""
    much = np.full(len(order), min(probes, order.shape[1]) if len(order) else 0)
    if held is not None and len(order):
        much = np.clip((np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1, much, order.shape[1])
    kept = np.arange(order.shape[1])[None, :] < much[:, None]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(much)]).astype(np.int32)), pa.array(order[kept]))


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all other rows.

    ``rows`` needs vec_id and embedding; other columns are not read. Vectors that are null, zero, or hold a null or
    non-finite component take no part; neither do rows without a vec_id or vectors of another length than most. Equal
    distances go by the smaller vec_id. Rows that repeat a vec_id are one: the nearest of them counts, and a query's own
    id is never found. An empty table gives no rows.
    """
    spark = rows.sparkSession
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("count"), F.approx_count_distinct("vec_id").alias("ids")).orderBy(F.desc("count"), "size").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    width, total, ids = sizes
    good = good.where(F.size("embedding") == width)
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, total // PART_ROWS)))
    share = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # one row an id, so that repeats cannot swell the sample
    sample = good.where(share < min(1.0, max(SAMPLE, SAMPLE_PART * parts) / max(1, ids))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("embedding").toArrow()
    x = _matrix(sample.column(0))
    if not len(x):
        x = _matrix(good.select("embedding").limit(1).toArrow().column(0))
    router, scale, probes = fit(np.unique(x, axis=0), parts)

    def routed(held: np.ndarray | None):
        @F.arrow_udf("array<int>")
        def route(vectors: pa.Array) -> pa.Array:
            order = np.argsort(-router.scores(_matrix(vectors) * scale), axis=1, kind="stable").astype(np.int32)
            return visits(order, probes, held, k)

        return route

    def home_of():
        @F.arrow_udf("int")
        def home(vectors: pa.Array) -> pa.Array:
            return pa.array(router.scores(_matrix(vectors) * scale).argmax(axis=1).astype(np.int32))

        return home

    # copies of a row are one before they are placed, and an id's vectors lie in as many blocks as their number asks for
    placed = good.groupBy("vec_id", "embedding").agg(F.lit(True).alias("once")).select("vec_id", "embedding", home_of()("embedding").alias("part"))
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count_distinct("vec_id").alias("held")).collect()  # at most MOST_PARTS rows
    held = np.zeros(MOST_PARTS, np.int64)
    for r in sizes:
        held[r.part] = r.held
    blocks = F.broadcast(spark.createDataFrame([(r.part, r.blocks) for r in sizes], "part int, blocks int"))
    candidates = placed.join(blocks, "part").select("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "embedding")
    queries = good.where(is_query).distinct().select("vec_id", "embedding", F.explode(routed(held)("embedding")).alias("part")).join(blocks, "part")
    queries = queries.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
    together = candidates.unionByName(queries).repartition("part", "block").sortWithinPartitions("part", "block", "asks")
    found = together.select("part", "block", "asks", "vec_id", "embedding").mapInArrow(_ranked(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # ranks cut each task's rows to k a query before they are shuffled
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
