"""Op 11: centroid clustering with a LAESA pivot table.

Vectors become integers. Their distances to a few fixed pivots are computed once and
stored beside them. In each round the differences between a vector's pivot distances
and a centroid's bound their distance from below; centroids are tried in order of that
bound, and only those that the best distance so far does not rule out receive an
exact integer distance. Sums per centroid are combined by Spark; the driver holds the
centroids alone (clusters x components).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm import arrays
from netsieve.llm.components import discard, written

CLUSTERS = 16
ROUNDS = 3
DIMENSION = 64
SCALE = 64
#: Fixed pivots, and the first vectors in hash order among which they are chosen (a farthest-first choice).
PIVOTS = 8
PIVOT_SAMPLE = 128
#: Vectors handled at a time.
SLICE = 4096


def _safe(dimension: int) -> int:
    """Components below this magnitude have squared distances that fit 64 bits."""
    return 1 << ((62 - max(1, dimension - 1).bit_length()) // 2 - 1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python integers where 64 bits do not hold them."""
    bound = _safe(x.shape[-1])
    if x.dtype != object and max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < bound:
        d = x - y
        return np.einsum("...i,...i->...", d, d)
    d = x.astype(object) - y.astype(object)
    return (d * d).sum(-1)


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None, :]).astype(np.float64) for p in pivots], 1))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those already chosen."""
    chosen = [0]
    gap = pivot_distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, pivot_distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, far: np.ndarray):
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and the number of exact distances.

    ``table`` has the rows' distances to the pivots, ``far`` the centroids'.
    """
    n = len(x)
    lower = np.zeros((n, len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(lower, np.abs(table[:, p, None] - far[None, :, p]), out=lower)
    # Square roots of integers are off by their last bit at most.
    lower = np.maximum(lower * (1 - 1e-9) - 1e-9 * (table.max(1)[:, None] + far.max(1)[None, :]), 0)
    order = np.argsort(lower, axis=1, kind="stable")
    bound = np.take_along_axis(lower, order, 1) ** 2
    who = order[:, 0].copy()
    best = squared(x, centroids[who])
    tried = np.ones(n, np.int64)
    for r in range(1, len(centroids)):
        rows = np.flatnonzero(bound[:, r] <= best.astype(np.float64) * (1 + 1e-9))
        if not len(rows):
            break
        c = order[rows, r]
        d = squared(x[rows], centroids[c])
        tried[rows] += 1
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], c[better]
    return who, best, tried


def _with_table(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            p = pivot_distances(_matrix(part.column(1), pivots.shape[1]), pivots)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), arrays.list_array(p.ravel(), np.arange(len(p) + 1) * p.shape[1], pa.float64())],
                names=["id", "v", "p"])
    return run


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = pivot_distances(centroids, pivots)
        for part in _slices(batches):
            x = _matrix(part.column(1), centroids.shape[1])
            who, _, _ = nearest(x, _matrix(part.column(2), len(pivots)), centroids, far)
            small = np.abs(x).max(1) < 1 << 50  # sums of a slice stay in 64 bits; larger vectors go on alone
            ids = [c for c in range(len(centroids)) if (small & (who == c)).any()]
            alone = np.flatnonzero(~small)
            total = np.concatenate([np.array([x[small & (who == c)].sum(0) for c in ids], np.int64).reshape(-1, x.shape[1]), x[alone]])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.array(ids, np.int32), who[alone].astype(np.int32)])),
                pa.array(np.array([(small & (who == c)).sum() for c in ids] + [1] * len(alone), np.int64)),
                arrays.list_array(total.ravel(), np.arange(len(total) + 1) * x.shape[1], pa.int64())],
                names=["cluster", "n", "sums"])
    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = pivot_distances(centroids, pivots)
        for part in _slices(batches):
            who, best, tried = nearest(_matrix(part.column(1), centroids.shape[1]), _matrix(part.column(2), len(pivots)), centroids, far)
            fits = [int(d) if d < 1 << 63 else None for d in best] if best.dtype == object else best
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(fits, pa.int64()),
                                              pa.array(tried)], names=["id", "cluster", "distance", "n_exact"])
    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and
    n_exact (centroids that received an exact distance in the last assignment).

    Kept are vectors of ``dimension`` components, none null or non-finite; each component
    becomes floor(scale * x). Components must fit a long after that; vectors with larger ones are left out. The
    first centroids are the vectors with the smallest sha256 of ``seed:id`` (ties, as for
    repeated ids: by components; a null id counts as an empty one); fewer vectors than ``clusters`` give as
    many centroids. Every round assigns and moves the centroids, then vectors are
    assigned once more. Repeated rows are vectors of their own. A squared distance or sum beyond a long is
    null. Extra columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) == dimension) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < float(1 << 62)))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, F.transform(v, lambda e: F.floor(e * scale))).alias("v"))
    rows = rows.where("v is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    head = rows.select("v").orderBy(order, "v").limit(max(clusters, PIVOT_SAMPLE)).collect()
    out = f"id {id_type}, cluster int, distance long, n_exact long"
    if not head:
        found, centroids = spark.createDataFrame([], out), np.zeros((0, dimension), np.int64)
    else:
        sample = np.array([r.v for r in head], np.int64)
        centroids, pivots = sample[:clusters], choose_pivots(sample[:PIVOT_SAMPLE], PIVOTS)
        table = written(rows.mapInArrow(_with_table(pivots), f"id {id_type}, v array<long>, p array<double>"), "pivots")
        for _ in range(rounds):
            sums = (table.mapInArrow(_sums(centroids, pivots), "cluster int, n long, sums array<long>")
                    .select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i")
                    .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect())
            centroids = centroids.copy()
            for r in sums:
                centroids[r.cluster, r.i] = int(r.s) // r.n
        found = written(table.mapInArrow(_assign(centroids, pivots), out), "clusters")
        discard(table)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.when(F.count("distance") == F.count("*"), total).try_cast("long")
    per = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    every = None if None in per.values() or sum(per.values()) >= 1 << 63 else sum(per.values())
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(k, per.get(k), every, sha) for k, sha in enumerate(shas)],
                                 "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most ``clusters`` rows.
    return (found.join(F.broadcast(told), F.col("cluster") == F.col("c"))
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact"))
