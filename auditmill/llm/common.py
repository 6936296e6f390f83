"""Shared pieces: words and shingles in numpy, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.shared import forget, written  # noqa: F401

#: Bytes of text that a Python worker treats at once; single longer texts are treated alone.
CHUNK_BYTES = 1 << 20
#: White space that parts words: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
U = np.uint64
_P, _SEED = 0x9E3779B97F4A7C15 | 1, 0x2545F4914F6CDD1D
_P_INV = pow(_P, -1, 1 << 64)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of so many rows at most, as texts can be very long. Kept if the session has a smaller number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


# ---------------------------------------------------------------- Arrow batches
def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with CHUNK_BYTES of text at most, or one row."""
    n = batch.num_rows
    if not n:
        return
    ends = text_bytes(batch.column(batch.schema.get_field_index(text)))[1][1:]
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and offsets from 0; nulls are empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.p, self.q = np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            n = max(n, 1 << 20)
            for name, base in (("p", _P), ("q", _P_INV)):
                x = np.full(n, base, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.p[:n], self.q[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; `span_hash` takes the hash of any span from them."""
    n = len(data)
    p, _ = POWERS.upto(n + 1)
    out = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each span of bytes; it depends on the bytes and their number alone."""
    _, q = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(U) * U(_SEED))


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the words' starts, and the number of each text's first word (with an end). between: bytes that part words."""
    low = LOWER[data]
    n = len(low)
    inside = ~between[low]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    if n:
        start[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    stop = inside.copy()
    if n:
        stop[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(stop) + 1
    return span_hash(prefix_hash(low), starts, ends), starts, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `size` consecutive words; of fewer words, of the whole sequence; without words, none."""
    hashed, _, first = words(data, offsets)
    consts = mix(np.arange(1, size + 1, dtype=U) * U(_SEED)) | U(1)
    n = max(0, len(hashed) - size + 1)
    rolled = np.zeros(n, U)
    for j in range(size):
        rolled += hashed[j : j + n] * consts[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix((hashed[a:b] * consts[: b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


# ---------------------------------------------------------------- connected components
def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates large-star and small-star steps (each a group-by and an equi-join, both of which
    Spark can split when a node has very many edges) until the edges are stars. Every step is a
    written table, so a lost executor repeats one step at most, and nothing reaches the driver
    but one checksum per round.
    """
    key = F.xxhash64("u", "v").cast("decimal(38,0)")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(key)).first())

    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        was, now = now, written(small, "small-star")
        forget(was)
        forget(large)
        then, seen = seen, mark(now)
        if then == seen:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
