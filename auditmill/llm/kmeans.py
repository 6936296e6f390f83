"""Centroid clustering with Hamerly's bounds: exact integer distances where the bounds can't decide.

Vectors are integers, floor(scale * x). Each keeps its cluster, an upper bound of the distance to its own
centroid and a lower bound of the distance to the second nearest. When centroids move, the upper bound
grows by the own centroid's drift and the lower one shrinks by the largest drift of the others. While the upper
bound is below the lower one, or below half the way to the nearest other centroid, the cluster can't change;
else the upper bound is made exact, and if that doesn't decide, the vector meets every centroid in integers.
Bounds are rounded outwards, so a tie is never decided by them.

Every round is one pass over the written vectors and bounds. Centroids are updated by the vectors that
moved alone: k times the width sums reach the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import forget, written

#: Components beyond this don't take part: squared distances of 64 of them would not fit in 63 bits.
LARGEST = 1 << 27
#: Integers up to which float64 products and their sums over 64 components are exact, so that BLAS can be used.
EXACT = 1 << 22
#: Bounds are widened by this share and this much.
SLACK, LEAST = 1e-12, 1e-6
_STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double"


def integer_vectors(embeddings: DataFrame, width: int, scale: float) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of each component as little-endian 32-bit integers.

    Kept are vectors with exactly `width` components, none null, non-finite or beyond LARGEST as an integer.
    Repeated rows and null vec_ids are vectors like others.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            x = lists.flatten().cast(pa.float64())
            if len(x) != width * b.num_rows:
                raise ValueError("a list of another width")
            n = np.floor(x.to_numpy(zero_copy_only=False).reshape(-1, width) * scale).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in n], pa.binary())], ["vec_id", "v"])

    x = F.col("embedding")
    # null, NaN and infinite components fail the comparison
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < float(LARGEST), F.lit(False)))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(F.when(F.size(x) == width, fits), F.lit(False)))
    return kept.mapInArrow(convert, "vec_id long, v binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        dot = (x.astype(float) @ c.astype(float).T).astype(np.int64)
        return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None]
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def own_distance(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = x - c[at]
    return (d * d).sum(1)


def _outwards(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return upper * (1 + SLACK) + LEAST, np.maximum(0.0, lower * (1 - SLACK) - LEAST)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), and bounds of the nearest and second nearest distance."""
    d = squared(x, c)
    near = d.argmin(1)  # the first of equals
    first = d[np.arange(len(d)), near]
    second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.full(len(d), 1 << 62)
    return near, *_outwards(np.sqrt(first.astype(float)), np.sqrt(second.astype(float)))


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to its nearest other, rounded down."""
    if len(c) < 2:
        return np.full(len(c), 2.0**31)
    d = np.sqrt(squared(c, c).astype(float))
    np.fill_diagonal(d, np.inf)
    return np.maximum(0.0, d.min(1) / 2 * (1 - SLACK) - LEAST)


def reassign(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids became c, each moved by drift; and how many vectors met every centroid."""
    most = int(drift.argmax())
    others = np.full(len(c), drift[most])
    others[most] = np.delete(drift, most).max(initial=0.0)
    upper, lower = _outwards(upper + drift[at], lower - others[at])
    safe = np.maximum(lower, half_gaps(c)[at])
    at = at.copy()
    open_ = np.flatnonzero(upper >= safe)
    if len(open_):
        exact = np.sqrt(own_distance(x[open_], c, at[open_]).astype(float))
        upper[open_] = exact * (1 + SLACK) + LEAST
        open_ = open_[upper[open_] >= safe[open_]]
    if len(open_):
        at[open_], upper[open_], lower[open_] = scan(x[open_], c)
    return at, upper, lower, len(open_)


def _first_state(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, upper, lower = scan(_matrix(b.column(1), c.shape[1]), c)
                yield _rows(b.column(0), b.column(1), at, np.full(len(at), -1), upper, lower)

    return vectors.mapInArrow(assign, _STATE)


def _rows(ids: pa.Array, v: pa.Array, at: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([ids, v, pa.array(at, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "was", "upper", "lower"])


def _next_state(state: DataFrame, c: np.ndarray, drift: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                was = b.column(2).to_numpy()
                at, upper, lower, _ = reassign(_matrix(b.column(1), c.shape[1]), was, b.column(4).to_numpy(), b.column(5).to_numpy(), c, drift)
                yield _rows(b.column(0), b.column(1), at, was, upper, lower)

    return state.select("vec_id", "v", "cluster", "was", "upper", "lower").mapInArrow(assign, _STATE)


def _moves(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How each cluster's sums and count changed, as Python integers: of the vectors that moved alone."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            for column, sign in ((b.column(1), 1), (b.column(2), -1)):
                at = column.to_numpy()
                there = at >= 0
                np.add.at(total, at[there], sign * x[there])
                np.add.at(count, at[there], sign)
        moved = np.flatnonzero((total != 0).any(1) | (count != 0))
        at = np.repeat(moved, width + 1)
        place = np.tile(np.arange(width + 1), len(moved))
        value = np.concatenate([total, count[:, None]], 1)[moved].ravel()
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], ["cluster", "place", "value"])

    found = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(sums, "cluster int, place int, value long")
    total = np.zeros((k, width + 1), object)
    for r in found.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # k * (width + 1) rows at most
        total[r.cluster, r.place] = int(r.value)
    return total[:, :width], total[:, width]


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and id, in that order; fewer if there are fewer. Null ids count as empty; ties go by the vector."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.stack([np.frombuffer(bytes(r.v), np.int32) for r in found]).astype(np.int64) if found else np.zeros((0, 0), np.int64)


def cluster(embeddings: DataFrame, k: int, rounds: int, width: int = 64, scale: float = 256.0, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """Clusters the rows of (vec_id, embedding): (vec_id, cluster, distance) with squared integer distances, and the final centroids.

    Which rows take part is said at `integer_vectors`, how centroids begin at `first_centroids`. Each round assigns
    every vector to its nearest centroid (ties: smaller number) and replaces every centroid that has vectors by the
    floor of their mean; then vectors are assigned once more. With fewer vectors than k there are fewer centroids;
    without any there are no rows.
    """
    vectors = written(integer_vectors(embeddings, width, scale), "vectors")
    c = first_centroids(vectors, k, salt)
    if not len(c):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    state = written(_first_state(vectors, c), "bounds")
    forget(vectors)
    total, count = np.zeros(c.shape, object), np.zeros(len(c), object)
    for _ in range(rounds):
        more, number = _moves(state, *c.shape)
        total, count = total + more, count + number
        new = c.copy()
        for j in range(len(c)):
            if count[j]:
                new[j] = [t // count[j] for t in total[j]]
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + SLACK) + LEAST
        drift[(new == c).all(1)] = 0.0
        c, old = new, state
        state = written(_next_state(old, c, drift), "bounds")
        forget(old)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            d = own_distance(_matrix(b.column(1), c.shape[1]), c, at)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long"), c


def cluster_table(embeddings: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part."""
    spark = embeddings.sparkSession
    rows, c = cluster(embeddings, k, rounds)
    by = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    inertia = {r.cluster: r.cluster_inertia for r in by}
    digests = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for j, row in enumerate(c)]
    table = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
