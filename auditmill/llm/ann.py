"""Nearest neighbours by cross-polytope hashing, with exact reranking.

A table's hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the
nearest signed axis; with many vectors a hash is two such axes. Vectors of unlike length get one more
component, so that the largest inner product is the nearest direction. A query looks into a number of buckets
of each table, those whose axes it is nearest to. How many tables and buckets is measured, alike at every size:
on a bounded sample of queries, the cheapest pair that finds RECALL of the true neighbours. A bucket is scanned
in blocks: vectors of one block against all queries that look into it, by exact inner products.

Equal vectors are one: their smallest k + 1 ids stand for them, as no larger one can be among any k nearest.
So a vector that very many rows share costs as much as any other, as a candidate and as a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.common import written

K = 20
#: Tables that there are at most.
TABLES = 8
#: Share of the sample's true neighbours that the tables must find; queries of the sample.
RECALL, SAMPLE = 0.95, 200
#: Vectors of a bucket that are scanned in one block, and vectors a bucket has on average before hashes get a second axis.
BLOCK, FULL = 4096, 2048
#: Buckets of all tables up to which their sizes are broadcast: a few bytes each.
SMALL = 1 << 18
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hashes:
    """The tables' hashes of vectors of a width; longest: the length of the longest vector, 0 if all have about one length."""

    def __init__(self, width: int, axes: int, longest: float = 0.0, tables: int = TABLES):
        self.width, self.axes, self.longest, self.tables = width, axes, longest, tables
        self.size = 1 << max(1, (width + (longest > 0) - 1).bit_length())
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, axes, 3, self.size))
        self.buckets = (2 * self.size) ** axes

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Directions whose nearness is that of inner products with a query."""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.size))
        if self.longest and not query:
            y = x / self.longest
            out[:, : self.width] = y
            out[:, self.width] = np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))
        else:
            out[:, : self.width] = x / length
        return out

    def near(self, x: np.ndarray, table: int, axis: int, query: bool) -> np.ndarray:
        """Nearness of each vector to each signed axis."""
        y = self.unit(x, query)
        for signs in self.signs[table, axis]:
            y = hadamard(y * signs)
        return np.concatenate([y, -y], axis=1)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for a in range(self.axes):
            out = out * (2 * self.size) + self.near(x, table, a, False).argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, table: int, many: int) -> np.ndarray:
        """The buckets a query looks into, nearest first."""
        score = self.near(x, table, 0, True)
        top = np.argsort(-score, axis=1, kind="stable")
        if self.axes == 1:
            return top[:, :many]
        other = self.near(x, table, 1, True)
        side = min(2 * self.size, many)
        out = np.empty((len(x), min(many, side * side)), np.int64)
        for i in range(len(x)):
            a, b = top[i, :side], np.argsort(-other[i], kind="stable")[:side]
            sums = (score[i, a][:, None] + other[i, b]).ravel()
            best = np.argsort(-sums, kind="stable")[: out.shape[1]]
            out[i] = a[best // side] * (2 * self.size) + b[best % side]
        return out

    def rank_of(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, table: int) -> np.ndarray:
        """Which of a query's buckets, nearest first, holds each vector y; of: the number of y's query."""
        mine, score = self.bucket(y, table), self.near(x, table, 0, True)
        other = self.near(x, table, 1, True) if self.axes == 2 else None
        out = np.empty(len(y), np.int64)
        for q in np.unique(of):
            mine_of = np.flatnonzero(of == q)
            whole = score[q] if other is None else (score[q][:, None] + other[q]).ravel()
            # a bucket's rank: how many buckets come before it, in the order in which they are looked into
            for i in mine_of:
                out[i] = np.count_nonzero(whole > whole[mine[i]]) + np.count_nonzero(whole[: mine[i]] == whole[mine[i]])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; of equal ones the smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def top_block(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """For each query its k best of a block: (number, ids, scores)."""
    scores = queries @ vectors.T
    # products of a matrix differ in their last bits from those of single vectors, by less than this
    slack = 1e-12 * queries.shape[1] * np.abs(queries).max(axis=1) * np.abs(vectors).max()
    for i, row in enumerate(scores):
        at = np.arange(len(row))
        if len(row) > k:
            at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack[i])
        # the score that counts is one inner product of the two vectors, alike wherever it is taken
        exact = (vectors[at] * queries[i]).sum(axis=1)
        first = best(ids[at], exact, k)
        yield i, ids[at[first]], exact[first]


def _scan(k: int):
    """Streams blocks: a block's vectors, then the queries that look into its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors = None, [], []
        ready = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("tab", "bucket", "block", "query", "id")]
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols[:4]], axis=1)
            number, matrix = cols[4].to_numpy(zero_copy_only=False), _matrix(batch.column(batch.schema.get_field_index("v")))
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                key = tuple(keys[lo, :3])
                if key != group:
                    group, ids, vectors, ready = key, [], [], None
                if not keys[lo, 3]:
                    ids.append(number[lo:hi])
                    vectors.append(matrix[lo:hi])
                    continue
                if not ids:
                    continue
                ready = ready or (np.concatenate(ids), np.concatenate(vectors))
                for at in range(lo, hi, 256):
                    to = min(hi, at + 256)
                    out += [(int(number[at + i]), a.tolist(), s.tolist()) for i, a, s in top_block(matrix[at:to], *ready, k)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    return run


def _merged(k: int):
    """Streams each query's partial lists; gives its k best, ranked."""

    def ranked(query: int, ids: list, scores: list):
        i, s = np.concatenate(ids), np.concatenate(scores)
        i, first = np.unique(i, return_index=True)
        s = s[first]
        at = best(i, s, k)
        return [(query, r + 1, int(i[j]), float(s[j])) for r, j in enumerate(at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows):
            cols = list(zip(*rows)) or [()] * 4
            types = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["query_id", "rank", "vec_id", "score"])

        last, ids, scores = None, [], []
        for batch in batches:
            rows = []
            for q, i, s in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("query_id", "ids", "scores"))):
                if q != last and ids:
                    rows += ranked(last, ids, scores)
                    ids, scores = [], []
                last = q
                ids.append(np.array(i, np.int64))
                scores.append(np.array(s, np.float64))
                if len(ids) > 64:  # keep the best so far
                    i, s = np.concatenate(ids), np.concatenate(scores)
                    i, first = np.unique(i, return_index=True)
                    at = best(i, s[first], k)
                    ids, scores = [i[at]], [s[first][at]]
            yield give(rows)
        if ids:
            yield give(ranked(last, ids, scores))

    return run


def _merge(parts: DataFrame, k: int) -> DataFrame:
    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")


def exact(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k nearest of each of a bounded list of queries, by scanning all (id, v)."""
    given = vectors.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = given.value
        for batch in batches:
            out = [(int(q[i]), a.tolist(), s.tolist()) for i, a, s in top_block(x, batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), k) if batch.num_rows]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    return _merge(vectors.select("id", "v").mapInArrow(run, "query_id long, ids array<long>, scores array<double>"), k)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v double[]) of the rows that take part: an id, components that are finite and not all zero, and the most frequent width. Of rows that share an id the smallest vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("v") == (width.w if width else 0)).groupBy("id").agg(F.min("v").alias("v"))


def probes_needed(rows: DataFrame, queries: DataFrame, hashes: Hashes, n: int, many: int, k: int, recall: float) -> tuple[int, int]:
    """Tables, and buckets in each, that find `recall` of the sample's true neighbours with the fewest rows sent: n vectors a table, and each of `many` queries once a bucket."""
    sample = [(r.id, list(r.v)) for r in queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    truth = exact(rows, sample, k + 1).where("query_id <> vec_id and rank <= " + str(k + 1)).select("query_id", F.col("vec_id").alias("id"))
    near = truth.join(rows, "id").select("query_id", "v").collect()  # SAMPLE * (k + 1) vectors at most
    if not near:
        return 1, 1
    number = {q: i for i, (q, _) in enumerate(sample)}
    x, y = np.array([v for _, v in sample]), np.array([r.v for r in near])
    of = np.array([number[r.query_id] for r in near])
    first = np.full(len(near), hashes.buckets, np.int64)
    found = []
    for t in range(hashes.tables):
        first = np.minimum(first, hashes.rank_of(x, y, of, t))
        probes = int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))))]) + 1
        found.append((n * (t + 1) + many * probes * (t + 1), t + 1, probes))
    return min(found)[1:]


def search(vectors: DataFrame, every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k nearest rows, by inner product, of each row whose vec_id is divisible by `every`.

    vectors: (vec_id, embedding; more columns are ignored). Returns (query_id, rank from 1, vec_id, score). A
    query isn't its own neighbour; equal scores go by smaller vec_id. Rows that are null, zero, or hold null or
    non-finite components take no part, nor do rows without vec_id or of another width than most; of rows that
    share a vec_id the smallest vector takes part. With fewer than k candidates all are returned; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    every_row = written(usable(vectors), "vectors")
    # one row for equal vectors: the smallest id names it, the smallest k + 1 stand for it
    few = Window.partitionBy("v").orderBy("id")
    rows = every_row.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1)
    rows = written(rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("id"), "v", "ids"), "distinct")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest, shortest, width = rows.agg(F.count("*"), F.max(size), F.min(size), F.max(F.size("v"))).first()
    asked = every_row.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")
    asked = written(asked.join(rows.select("v", "id"), "v").select("query_id", "id"), "asked")
    queries = written(rows.select("id", "v").join(asked.select("id").distinct(), "id", "left_semi"), "queries")
    many = queries.count()
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashes = Hashes(width, 1, longest if longest > 1.001 * shortest else 0.0)
    if n > FULL * hashes.buckets:
        hashes = Hashes(width, 2, hashes.longest)
    tables, probes = probes_needed(rows, queries, hashes, n, many, k, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for t in range(tables if len(x) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(hashes.bucket(x, t)), batch.column(0), batch.column(1)], names=["tab", "bucket", "id", "v"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for t in range(tables if len(x) else 0):
                into = hashes.probes(x, t, probes)
                again = pa.array(np.repeat(np.arange(len(x)), into.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(into.size, t, np.int32)), pa.array(into.ravel()), batch.column(0).take(again), batch.column(1).take(again)], names=["tab", "bucket", "id", "v"])

    schema = "tab int, bucket long, id long, v array<double>"
    stored = written(rows.select("id", "v").mapInArrow(index, schema), "index")
    blocks = stored.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # a row a bucket, of which there are tables * hashes.buckets at most
    blocks = F.broadcast(blocks) if tables * hashes.buckets <= SMALL else blocks
    vec = stored.join(blocks, ["tab", "bucket"]).select("tab", "bucket", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"), "id", "v")

    def scanned(ask: DataFrame, vec: DataFrame) -> DataFrame:
        ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tab", "bucket", "block", F.lit(1).alias("query"), "id", "v")
        line = vec.unionByName(ask).repartition("tab", "bucket", "block").sortWithinPartitions("tab", "bucket", "block", "query", "id")
        return written(_merge(line.mapInArrow(_scan(k + 1), "query_id long, ids array<long>, scores array<double>"), k + 1), "nearest")

    found = scanned(queries.mapInArrow(look, schema).join(blocks, ["tab", "bucket"]), vec)
    # a query whose buckets held too few looks into all buckets of the first table
    got = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(k + 1, n))
    short = written(queries.join(got, queries.id == got.query_id, "left_anti"), "short")
    if not short.isEmpty():
        whole = short.crossJoin(blocks.where("tab = 0"))  # these queries against all rows, a block at a time
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(scanned(whole, vec.where("tab = 0")))
    # the vectors found, as the ids they stand for; of these the first k + 1, and of them all but the query itself
    members = found.select(F.col("query_id").alias("of"), F.col("vec_id").alias("id"), "score").join(rows.select("id", "ids"), "id")
    members = members.select("of", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("of").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = members.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    own = asked.join(lists, F.col("id") == F.col("of")).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")
