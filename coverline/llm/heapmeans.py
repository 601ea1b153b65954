"""Operator 13: centroid clustering with heap-ordered bounds.

Vectors become whole numbers and are written once, a row a block of ``BLOCK`` vectors. Beside them lies a table of states: each
block keeps one heap a cluster of its vectors there, ordered by the gap between the lower bound of the distance to any
other centroid and the upper bound of that to their own. When centroids move, a cluster's gaps all shrink by the same: its own
centroid's drift and the largest of the others'. So a gap is entered with its cluster's drift so far added, and has expired when
the cluster's drift has reached it. A round pops what has expired from the tops of the heaps, measures only these vectors
against all centroids, exactly, and pushes them again. Both tables are bucketed by block, so a round shuffles nothing; it
writes the heaps and what sums and counts gained and lost, and only the totals, a number for each cluster and component, reach
the driver. A lost executor costs its blocks of one round.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep, scratch_path

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Largest component, as a whole number, for which squared distances of ``WIDTH`` components fit in 64 bits.
MOST = 1 << 27
BLOCK = 1024
#: Vectors a bucket, until there are ``MOST_BUCKETS``.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4096, 8, 32768
#: Relative room for the rounding of bounds: a gap this close to its end counts as expired.
MARGIN = 1e-9
HEAPS = "array<struct<keys: array<double>, places: array<int>>>"


@dataclass
class Clustering:
    """``rows`` (vec_id, cluster, distance), the final ``centroids``, and how many vectors each assignment measured anew."""

    rows: DataFrame
    centroids: list[list[int]]
    measured: list[int]


def whole(vector: Column, width: int = WIDTH) -> Column:
    """floor(SCALE * x) of each component; null unless the vector has ``width`` components, all finite and none beyond ``MOST``."""
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c) <= float(MOST // SCALE), F.lit(False)))
    return F.when((F.size(x) == width) & fits, F.transform(x, lambda c: F.floor(c * SCALE).cast("int")))


def _blocks(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, number = [], [], TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "vectors": pa.array([b"".join(vectors)], pa.binary())})

        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).astype("<i4").reshape(-1, width)
            for vec_id, vector in zip(batch.column(0).to_pylist(), flat):
                ids.append(vec_id)
                vectors.append(vector.tobytes())
                if len(ids) == BLOCK:
                    yield row()
                    ids, vectors, number = [], [], number + 1
        if ids:
            yield row()

    return cut


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, a column a centroid."""
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def expired(heap: list[tuple[float, int]], drift: float) -> list[int]:
    """Pops every entry that the cluster's drift has reached."""
    reached, places = drift + MARGIN * (1 + drift), []
    while heap and heap[0][0] <= reached:
        places.append(heapq.heappop(heap)[1])
    return places


def advance(vectors: np.ndarray, heaps: list[list[tuple[float, int]]] | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[list[list[tuple[float, int]]], np.ndarray, int]:
    """One round of one block: its heaps afterwards, what the sums and counts of the clusters gained, and how many vectors were measured.

    Without heaps every vector is new.
    """
    k, width = centroids.shape
    gained = np.zeros((k, width + 1), np.int64)
    if heaps is None:
        heaps, popped, before = [[] for _ in range(k)], np.arange(len(vectors)), np.full(len(vectors), -1)
    else:
        gone = [expired(heap, drift[c]) for c, heap in enumerate(heaps)]
        popped, before = np.array([p for places in gone for p in places], np.int64), np.repeat(np.arange(k), [len(places) for places in gone])
    if not len(popped):
        return heaps, gained, 0
    chosen = vectors[popped].astype(np.int64)
    squared = distances(chosen, centroids)
    cluster = squared.argmin(axis=1)  # of equal ones the first
    near = np.sqrt(squared[np.arange(len(popped)), cluster])
    squared[np.arange(len(popped)), cluster] = np.iinfo(np.int64).max
    other = np.sqrt(squared.min(axis=1)) if k > 1 else np.full(len(popped), math.inf)
    keys = other * (1 - MARGIN) - near * (1 + MARGIN) + drift[cluster]
    for c in range(k):
        mine = cluster == c
        fresh = list(zip(keys[mine].tolist(), popped[mine].tolist()))
        if len(fresh) * 8 > len(heaps[c]):
            heaps[c].extend(fresh)
            heapq.heapify(heaps[c])
        else:
            for entry in fresh:
                heapq.heappush(heaps[c], entry)
        for rows, sign in ((mine & (before != c), 1), (~mine & (before == c), -1)):
            gained[c, :width] += sign * chosen[rows].sum(axis=0)
            gained[c, width] += sign * int(rows.sum())
    return heaps, gained, len(popped)


def _round(centroids: np.ndarray, drift: np.ndarray):
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vectors, state in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                matrix = np.frombuffer(vectors.as_buffer(), "<i4").reshape(-1, width)
                heaps = None
                if state.is_valid:
                    heaps = [list(zip(h["keys"], h["places"])) for h in state.as_py()]
                heaps, gained, measured = advance(matrix, heaps, centroids, drift)
                kept = [{"keys": [e[0] for e in heap], "places": [e[1] for e in heap]} for heap in heaps]
                kind = pa.list_(pa.struct([("keys", pa.list_(pa.float64())), ("places", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block], pa.int64()), "heaps": pa.array([kept], kind), "gained": pa.array([gained.ravel().tolist()], pa.list_(pa.int64())), "measured": pa.array([measured], pa.int64())}
                )

    return run


def _assigned(centroids: np.ndarray):
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, state in zip(batch.column(0), batch.column(1), batch.column(2)):
                matrix = np.frombuffer(vectors.as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
                cluster = np.empty(len(matrix), np.int32)
                for c, heap in enumerate(state.as_py()):
                    cluster[heap["places"]] = c
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array(((matrix - centroids[cluster]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` as a table bucketed by block in the shared folder."""
    spark, path, table = df.sparkSession, scratch_path(df.sparkSession, name), f"coverline_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(table)
    kept = spark.table(table)
    kept._kept_at, kept._table = path, table
    return kept


def _forget(*tables: DataFrame) -> None:
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
        drop(t)


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> Clustering:
    """Vectors of ``rows`` (vec_id, embedding) in ``clusters`` groups, after ``rounds`` rounds and one more assignment.

    Vectors that are null, of another length, or hold null or non-finite components are left out, and so are components
    beyond 131,072, for which no squared distance fits in 64 bits. Rows that repeat a vec_id count each; a row without vec_id is
    clustered too but never starts a centroid. The start is the vectors with the smallest SHA-256 of ``3:<vec_id>``, then the
    smaller vector; fewer vectors make fewer clusters, and none give no rows. Equal distances go to the smaller number, and an empty
    cluster stays where it is. Other columns are not read.
    """
    spark = rows.sparkSession
    good = rows.select("vec_id", whole(F.col("embedding"), width).alias("vector")).where(F.col("vector").isNotNull())
    first = good.where(F.col("vec_id").isNotNull()).orderBy(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256), "vector").limit(clusters).select("vector").collect()
    if not first:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    centroids = [list(r.vector) for r in first]
    k = len(centroids)
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, good.count() // BUCKET))
    cut = good.mapInArrow(_blocks(width), "block long, ids array<long>, vectors binary")
    blocks = _bucketed(cut.repartition(buckets, "block"), "blocks", buckets)
    sums, drift, state, measured = [[0] * (width + 1) for _ in range(k)], np.zeros(k), None, []
    for r in range(rounds + 1):
        joined = blocks.select("block", "vectors", F.lit(None).cast(HEAPS).alias("heaps")) if state is None else blocks.select("block", "vectors").join(state.select("block", "heaps").hint("merge"), "block")
        after = _bucketed(joined.mapInArrow(_round(np.array(centroids, np.int64), drift), f"block long, heaps {HEAPS}, gained array<long>, measured long"), "heaps", buckets)
        if state is not None:
            _forget(state)
        state = after
        measured.append(state.agg(F.sum("measured")).first()[0])
        if r == rounds:
            break
        for at, total in state.select(F.posexplode("gained")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)"))).collect():  # clusters x (components + 1) rows
            sums[at // (width + 1)][at % (width + 1)] += int(total)
        moved = [[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(sums, centroids)]
        steps = [math.sqrt(sum((a - b) ** 2 for a, b in zip(new, old))) * (1 + MARGIN) for new, old in zip(moved, centroids)]
        drift = drift + [steps[c] + max((s for o, s in enumerate(steps) if o != c), default=0.0) for c in range(k)]
        centroids = moved
    both = blocks.select("block", "ids", "vectors").join(state.select("block", "heaps").hint("merge"), "block").select("ids", "vectors", "heaps")
    found = keep(both.mapInArrow(_assigned(np.array(centroids, np.int64)), "vec_id long, cluster int, distance long"), "clusters")
    _forget(blocks, state)
    return Clustering(found, centroids, measured)


def clustered(rows: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part in ``cluster``."""
    spark, done = rows.sparkSession, cluster(rows)
    names = F.broadcast(spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(done.centroids)], "cluster int, components string"))
    sums = done.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    # a row a cluster
    each = F.broadcast(sums.crossJoin(F.broadcast(sums.agg(F.sum("part").alias("whole")))))
    return done.rows.join(each, "cluster").join(names, "cluster").select(
        "vec_id", "cluster", "distance", F.col("part").cast("long").alias("cluster_inertia"), F.col("whole").cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256")
    )


def sql() -> str:
    """The same for DuckDB, a round at a time, every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c{r} k)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, arg_min(c, CAST(distance AS HUGEINT) * {CLUSTERS} + c) AS c, min(distance) AS distance FROM d{r} GROUP BY r)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (r), range(1, {WIDTH + 1}) AS g(i) GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c)")
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} k ON k.c = a.c
"""
