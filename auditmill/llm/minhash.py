"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

Signature: an initial permutation spreads the shingle hashes over a universe of 2**21 places, and one
further permutation, circularly shifted k places, gives the k-th coordinate. All coordinates of a
shingle therefore lie next to each other in one table, so a document's signature is the minimum over
rows of a sliding window. Coordinates are banded; documents of one set are one class, and only classes
are banded.

Pairs: the members of a bucket are compared with one pivot of it, not with each other. A bucket whose
members now lie in one component can add no link between components; the rest goes on with another
pivot, and what then is unsettled meets pair by pair, through an exact prefix filter on its rarest
shingles. So every pair that shares a bucket is compared on full sets, excluded by a bound, or already
connected, and a bucket with n copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import U, chunks, connected_components, mix, shingle_sets, signed, small_batches, text_bytes, written

SHINGLE = 5
#: At a similarity of 0.8 a pair shares no bucket with a probability of 3e-6, at 0.85 of 7e-9.
BANDS, ROWS = 32, 5
UNIVERSE = 1 << 21
#: Members that are compared with a pivot in one task.
STAR = 256
#: Rounds with a pivot before the remaining pairs are compared one by one.
PIVOT_ROUNDS = 2


@cache
def _table(width: int) -> np.ndarray:
    """Row i: the values of the second permutation at i, i+1, ..., i+width-1 (circularly)."""
    second = np.random.Generator(np.random.Philox(20240501)).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of 64-bit hashes."""
    places = (mix(hashes) & U(UNIVERSE - 1)).astype(np.int64)
    table = _table(width)
    out = np.full(width, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(out, table[places[at : at + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, the band's number included."""
    consts = mix(np.arange(1, rows + 1, dtype=U) * U(0x632BE59BD9B4E019)) | U(1)
    parts = (sig.reshape(bands, rows).astype(U) * consts).sum(axis=1, dtype=U)
    return mix(parts + mix(np.arange(bands, dtype=U) + U(77)))


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, off = text_bytes(part.column(1))
                sets = shingle_sets(data, off, shingle)
                keys = [band_keys(signature(s, bands * rows), bands, rows) if len(s) else s for s in sets]
                count = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([mix(s).sum(dtype=U) for s in sets], U)
                h2 = np.array([mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) for s in sets], U)
                flat = np.concatenate(keys) if keys else np.zeros(0, U)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(count), pa.array(signed(h1)), pa.array(signed(h2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(flat)))],
                    names=["id", "k", "n", "h1", "h2", "bands"],
                )

    return run


def _compare(shingle: int, num: int, den: int):
    """Streams stars: a centre's text, then the texts compared with it. Gives the pairs that are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, U)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(*text_bytes(part.column(part.schema.get_field_index("text"))), shingle)
                a, b = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
                left, right = [], []
                for x, y, s in zip(a, b, sets):
                    if x == y:
                        centre, own = x, s
                        continue
                    assert x == centre, "a star's centre comes first"
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and den * both >= num * (len(own) + len(s) - both):
                        left.append(x)
                        right.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int, shingle: int) -> DataFrame:
    """Of the pairs (a, b), a <> b, those with den * intersection >= num * union on their full shingle sets."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    pairs = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    rows = pairs.unionByName(pairs.select("a", F.col("a").alias("b"), "part").distinct())
    rows = rows.join(texts, rows.b == texts.id).select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.when(F.col("a") == F.col("b"), 0).otherwise(1), "b")
    return rows.mapInArrow(_compare(shingle, num, den), "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups documents (doc_id, text; more columns are ignored) whose shingle sets are alike: den * |A & B| >= num * |A | B|.

    Returns (doc_id, n_shingles, component_id), one row for each row of docs: component_id is the smallest
    doc_id that links reach, the row's own included. Null texts are empty; texts without words have no
    shingles and are linked with nothing. A row without doc_id is linked with nothing and has no component.
    Rows that repeat each give a row of the same component. Where one doc_id comes with several texts, each text is
    compared, and each row has its own text's component. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k"))
    sets = written(source.mapInArrow(_signatures(shingle, bands, rows), "id long, k long, n long, h1 long, h2 long, bands array<long>"), "signatures")
    place = F.struct("id", "k")
    classes = sets.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min(place).alias("of"), F.min_by("bands", place).alias("bands"))
    # a class goes by its set's hash, as a doc_id can stand with several texts
    classes = written(classes.select(F.xxhash64("h1", "h2", "n").alias("rep"), "h1", "h2", "n", "of", "bands"), "classes")
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keys.join(shared, "key"), "members")
    # the document that meets most others is the likeliest centre of its group
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = written(members.join(weight, "rep").select("key", "rep", "n", "weight"), "members")
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "of.id", "of.k")
    texts = source.join(wanted, ["id", "k"]).groupBy("rep").agg(F.min("text").alias("text")).withColumnRenamed("rep", "id")
    linked = linked_components(members, written(texts, "texts"), num, den, shingle)
    named = linked.join(classes.select("rep", "of.id"), linked.node == classes.rep).select("rep", "id", "component")
    least = named.join(named.groupBy("component").agg(F.min("id").alias("least")), "component").select("rep", "least")
    of_class = classes.join(least, "rep", "left").select("h1", "h2", "n", F.coalesce("least", "of.id").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return sets.join(of_class, ["h1", "h2", "n"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _near_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node within two links, for every node of an edge. Nodes of one label are connected; others may be."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    one = both.groupBy("u").agg(F.least("u", F.min("v")).alias("label"))
    two = both.join(one.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("far"))
    return two.select(F.col("u").alias("node"), F.least("u", "far").alias("component"))


def _relabelled(left: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with their labels; buckets whose members are all of one label can join nothing more, and go."""
    left = left.drop("comp").join(labels, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    split = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return left.join(split, "key", "left_semi")


def linked_components(members: DataFrame, texts: DataFrame, num: int, den: int, shingle: int) -> DataFrame:
    """(node, component) for class representatives that are linked, of members (key, rep, n, weight) of buckets and texts (id, text).

    Between rounds labels of two links are enough: they only save comparisons. Whole components are worked out
    once, and links found after that join them as wholes.
    """
    fits = F.least("n", "m") * den >= F.greatest("n", "m") * num
    left, edges, tried = members.withColumn("comp", F.col("rep")), None, None
    for _ in range(PIVOT_ROUNDS):
        pivot = left.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("rep").alias("a"), F.col("n").alias("m"), F.col("comp").alias("of"))).alias("p"))
        met = left.join(pivot.select("key", "p.a", "p.m", "p.of"), "key").where("rep <> a")
        pairs = written(met.where((F.col("comp") != F.col("of")) & fits).select("a", F.col("rep").alias("b")).distinct(), "pairs")
        found = written(confirmed(pairs, texts, num, den, shingle), "found")
        edges = found if edges is None else edges.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        # the pivot has met all of its bucket
        labels = written(_near_labels(edges), "labels")
        rest = left.join(pivot.select("key", "p.a"), "key").where("rep <> a").drop("a")
        left = written(_relabelled(rest, labels), "unsettled")
        if left.isEmpty():
            return written(connected_components(edges), "linked")
    whole = written(connected_components(edges), "components")
    left = written(_relabelled(left, whole), "unsettled")
    if left.isEmpty():
        return whole
    rest = _sharing_rare(left.select("rep", "n", "comp").distinct(), texts, num, den, shingle).where(fits)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(rest.join(done, ["a", "b"], "left_anti"), "pairs")
    found = written(confirmed(rest, texts, num, den, shingle), "found")
    ends = [whole.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    over = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = written(connected_components(over), "joined")
    top = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = whole.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(moved.unionByName(joined.join(whole, "node", "left_anti")), "linked")


def _sharing_rare(docs: DataFrame, texts: DataFrame, num: int, den: int, shingle: int) -> DataFrame:
    """Pairs of the documents (rep, n, comp) in different components that can be alike: an exact prefix filter.

    With shingles in one order, rarest first, two sets that are alike enough share one of their first
    n - ceil(num * n / den) + 1, and at the first they share enough shingles are still to come in both. So near copies that differ by edits of their own meet nobody. In a shingle's
    group those of its largest component are met by the others only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(*text_bytes(part.column(1)), shingle)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(flat)))], names=["rep", "tokens"])

    rows = texts.join(docs.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "text").mapInArrow(run, "rep long, tokens array<long>")
    rows = written(rows.select("rep", F.explode("tokens").alias("token")), "tokens")
    often = rows.groupBy("token").agg(F.count("*").alias("df"))
    first = rows.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    first = first.join(docs, "rep").withColumn("t", F.expr(f"slice(t, 1, cast(n - ceil({num} * n / {den}) + 1 as int))"))
    first = first.select("rep", "n", "comp", F.posexplode("t").alias("at", "x")).where("x.df > 1").select("rep", "n", "comp", "at", F.col("x.token").alias("token"))
    first = written(first, "rare")
    sizes = first.groupBy("token", "comp").agg(F.count("*").alias("c"))
    most = sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    most = most.select("token", F.col("top.comp").alias("main"))
    here = first.join(most, "token")
    few = here.where("comp <> main").select("token", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("comp").alias("of"), F.col("at").alias("to"))
    bound = (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) * (num + den)) >= (F.col("n") + F.col("m")) * num
    return here.join(few, "token").where((F.col("comp") != F.col("of")) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("rep"))) & bound).select("a", "m", F.col("rep").alias("b"), "n")


