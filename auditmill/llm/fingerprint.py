"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest hashes of a set of shingles (48 bits each), so sketches of parts merge into
the whole's: the k smallest of both. From two sketches follow the sets' resemblance and containment, from
one its number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import CHUNK_BYTES, U, shingle_sets, small_batches, text_bytes

SHINGLE = 5
K = 128
BITS = 48


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of a sorted set's hashes."""
    return np.unique(hashes[: k + 8] >> U(64 - BITS))[:k]


def sketches(texts: list[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    return [sketch(s, k) for s in shingle_sets(*text_bytes(pa.array(texts, pa.large_string())), shingle)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact if both sets are smaller than k. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    shared = np.intersect1d(a, b, assume_unique=True)
    return len(np.intersect1d(both, shared, assume_unique=True)) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1] + U(1)) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(U)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, fingerprint, n_distinct) of each row of (doc_id, text). Null texts are empty: an empty fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = sketches(texts, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(s) for s in found]), pa.array([distinct(s, k) for s in found])], names=["doc_id", "n_chars", "fingerprint", "n_distinct"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string, n_distinct double")


def _band(value: Column, bounds: list[int]) -> Column:
    """The number of bounds not above the value, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def _edits(k: int):
    """Streams rows in order; each is compared with its edited text and with the row after it."""

    def rows_of(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("band", "tail", "doc_id", "text"))):
                held.append(row)
                size += len(row[3])
                if size > CHUNK_BYTES:
                    yield held
                    held, size = [], 0
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple] = []  # the row whose successor is still to come, with its sketch
        for rows in rows_of(batches):
            own = sketches([r[3] for r in rows], k)
            line = left + list(zip(rows, own))
            left = line[-1:]
            pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[0][1]]  # what follows a band's tail is another band
            edited = []
            for (a, _), (b, _) in pairs:
                half = len(a[3]) // 2
                edited.append(a[3][: len(a[3]) - half] + b[3][:half])
            new = sketches(edited, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0][2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[0][3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([encode(a[1]) for a, _ in pairs], pa.string()),
                    pa.array([encode(s) for s in new], pa.string()),
                    pa.array([resemblance(a[1], s, k) for (a, _), s in zip(pairs, new)], pa.float64()),
                    pa.array([resemblance(a[1], b[1], k) for a, b in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def edit_test(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each document (doc_id, text) and of an edited text: its last half, from the next document's start.

    The next document is the one of the next smaller doc_id; after the last comes the first. Rows of one doc_id
    go by text, larger first; null doc_ids come last. Null texts are empty. One row for each row; an empty
    table gives none.

    Rows are dealt into bands of doc_ids at approximate quantiles, so that one shuffle of the texts is enough:
    a band's last row is followed by a copy of the next band's first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bands = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = rows.agg(F.percentile_approx("doc_id", [i / bands for i in range(1, max(2, bands))], 10_000)).first()[0]
    bounds = sorted(set(got or []))
    # bands by descending doc_id; rows without one are the last band
    rows = rows.select(F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - _band(F.col("doc_id"), bounds)).alias("band"), F.lit(False).alias("tail"), "doc_id", "text")
    top = rows.groupBy("band").agg(F.max("doc_id").alias("top"))
    tops = sorted((r.band, r.top) for r in top.collect())  # a row a band
    if not tops:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    follows = {b: tops[i - 1][0] for i, (b, _) in enumerate(tops)}
    heads = rows.where(F.col("doc_id").isin([t for _, t in tops if t is not None]) | F.col("doc_id").isNull())
    before = F.create_map(*[F.lit(x) for b, p in follows.items() for x in (b, p)])
    heads = heads.groupBy("band").agg(F.max("text").alias("text")).select(before[F.col("band")].alias("band"), F.lit(True).alias("tail"), F.lit(None).cast("long").alias("doc_id"), "text")
    line = rows.unionByName(heads).repartition(bands, "band").sortWithinPartitions("band", "tail", F.desc_nulls_last("doc_id"), F.desc("text"))
    return line.mapInArrow(_edits(k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
