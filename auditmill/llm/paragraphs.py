"""Removal of paragraphs that other texts repeat, exactly or nearly.

Paragraphs are cut where the text itself says so, so that a passage is cut alike wherever it stands: at line
ends, after sentences of LONG words, and after about every second other sentence of SOME words, as a hash of
its last word decides. Each paragraph, a word long or more, has a MinHash signature of its five-word shingles
(of fewer words, the whole sequence is one); bands
are single coordinates, as few as reach the recall wanted: at a similarity of 0.8 three bands miss a pair
with a probability of 0.8 %, and unlike paragraphs hardly share a shingle at all. Paragraphs that share a
band's value are compared on their full sets (see minhash: with pivots, and an exact filter for the rest),
and connected components of links are classes. Of a class the first paragraph stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm import minhash
from auditmill.llm.common import U, WHITE, chunks, mix, prefix_hash, signed, small_batches, span_hash, text_bytes, words, written

SHINGLE = 5
BANDS = 3
LEAST, SOME, LONG = 1, 5, 12
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paragraphs of texts laid end to end: words' hashes and spans, and each paragraph's text, first word and end."""
    hashed, starts, first = words(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return hashed, starts, starts, none, none, none
    blank = np.flatnonzero(WHITE[data])
    edge = np.append(blank, len(data))
    ends = edge[np.searchsorted(edge, starts)]
    text = np.searchsorted(first, np.arange(n), "right") - 1
    ends = np.minimum(ends, offsets[text + 1])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(n, bool)
    last[:-1] = (text[1:] != text[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
    stop = np.flatnonzero(last | _ENDS[data[ends - 1]])
    size = np.diff(np.concatenate([[-1], stop]))
    cuts = stop[last[stop] | (size >= LONG) | ((size >= SOME) & (hashed[stop] & U(1) == 0))]
    begin = np.concatenate([[0], cuts[:-1] + 1])
    return hashed, starts, ends, text[begin], begin, cuts + 1


def _paragraphs(bands: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sets of so few shingles are alike only if they are equal: one key, of the whole set, finds them all
        alone = 0
        while alone * den < num * (alone + 1) and alone < den:
            alone += 1
        consts = mix(np.arange(1, SHINGLE + 1, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)
        for batch in batches:
            for part in chunks(batch, "text"):
                data, off = text_bytes(part.column(2))
                hashed, starts, ends, text, a, b = cut(data, off)
                number = np.arange(len(a)) - np.searchsorted(text, text)
                if not len(a):
                    continue
                m = max(0, len(hashed) - SHINGLE + 1)
                rolled = np.zeros(m, U)
                for j in range(SHINGLE):
                    rolled += hashed[j : j + m] * consts[j]
                rolled = mix(rolled)
                content = span_hash(prefix_hash(hashed), a, b)
                # shingles of each paragraph, laid end to end; of fewer words than a shingle's, the whole sequence is one
                many = np.maximum(b - a - SHINGLE + 1, 1)
                to = np.cumsum(many)
                at = np.arange(to[-1]) - np.repeat(to - many, many) + np.repeat(a, many)
                short = b - a < SHINGLE
                whole = np.repeat(short, many)
                mine = np.empty(to[-1], U)
                mine[~whole] = rolled[at[~whole]]
                mine[whole] = content[short]
                own = np.repeat(np.arange(len(a), dtype=U), many)
                order = np.sort((own << U(40)) | (mine >> U(24)))
                fresh = np.ones(len(order), bool)
                fresh[1:] = order[1:] != order[:-1]
                n = np.bincount((order[fresh] >> U(40)).astype(np.int64), minlength=len(a))
                table = minhash._table(bands)
                low = np.minimum.reduceat(table[(mix(mine) & U(minhash.UNIVERSE - 1)).astype(np.int64)], to - many, axis=0)
                # the table's values are coordinates of few bits: with the shingle that has the least, they make a key of 64
                keys = _band_keys(mine, to - many, many, bands, low)
                few = n < alone
                keys[few, 0] = mix(np.add.reduceat(np.where(fresh, mix(order & U((1 << 40) - 1)), U(0)), to - many)[few] + U(bands))
                # a sequence that is one shingle has no equal but itself
                each = np.where(short, 0, np.where(few, 1, bands))
                used = np.arange(bands) < each[:, None]
                ends_at = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(signed(keys[used])))
                cols = [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array((starts[a] - off[text]).astype(np.int32)), pa.array((ends[b - 1] - off[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array((b - a).astype(np.int32)), pa.array(signed(content)), pa.array(n), lists], names=["doc_id", "k", "idx", "a", "b", "words", "h", "n", "bands"])

    return run


def _band_keys(mine: np.ndarray, begin: np.ndarray, many: np.ndarray, bands: int, low: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of the shingle with the least value, and the band's number."""
    table = minhash._table(bands)
    place = (mix(mine) & U(minhash.UNIVERSE - 1)).astype(np.int64)
    out = np.zeros((len(begin), bands), U)
    for k in range(bands):
        least = table[place, k] == np.repeat(low[:, k], many)
        # of shingles that share a place the one with the smallest hash
        value = np.where(least, mine, np.iinfo(np.uint64).max)
        out[:, k] = mix(np.minimum.reduceat(value, begin) ^ mix(np.full(1, k + 1, U)))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            data, off = text_bytes(part.column(part.schema.get_field_index("text")))
            raw = data.tobytes()
            ids, out = [], []
            for o, want in zip(off.tolist(), part.column(part.schema.get_field_index("want")).to_pylist()):
                for w in want:
                    ids.append(w["h"])
                    out.append(raw[o + w["a"] : o + w["b"]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])


def classes(docs: DataFrame, num: int = 80, den: int = 100, bands: int = BANDS) -> DataFrame:
    """Every paragraph that is not alone in its class: (doc_id, k, idx, a, b, words, class, first).

    a and b are its bytes in the text, first tells whether it is its class's first by (doc_id, idx). Paragraphs
    are linked if den * |A & B| >= num * |A | B| on their shingle sets. Null texts are empty, and have none.
    Rows without doc_id come last in order; of rows that repeat each is a place of its own, but their
    paragraphs share one place in the order, so the first of a class can stand in all of them.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    schema = "doc_id long, k long, idx int, a int, b int, words int, h long, n long, bands array<long>"
    units = written(rows.select("doc_id", "k", "text").mapInArrow(_paragraphs(bands, num, den), schema), "paragraphs")
    keys = units.select(F.explode("bands").alias("key"), F.col("h").alias("rep"), "n")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    members = written(keys.join(shared, "key", "left_semi").distinct(), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("weight"))
    members = written(members.join(weight, "rep").select("key", "rep", "n", "weight"), "members")
    want = units.join(weight.select(F.col("rep").alias("h")), "h", "left_semi").groupBy("h").agg(F.min(F.struct("k", "a", "b")).alias("of"))
    want = want.select("of.k", F.struct("h", "of.a", "of.b").alias("w")).groupBy("k").agg(F.collect_list("w").alias("want"))
    texts = rows.select("k", "text").join(want.select("k"), "k", "left_semi").groupBy("k").agg(F.min("text").alias("text"))
    texts = written(texts.join(want, "k").select("text", "want").mapInArrow(_texts, "id long, text string"), "texts")
    linked = minhash.linked_components(members, texts, num, den, SHINGLE)
    again = units.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    of = again.join(linked, again.h == linked.node, "full_outer").select(F.coalesce("h", "node").alias("h"), F.coalesce("component", "h").alias("class"))
    found = units.join(of, "h").select("doc_id", "k", "idx", "a", "b", "words", "class")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "idx")
    first = found.groupBy("class").agg(F.min(place).alias("at"))
    return found.join(first, "class").withColumn("first", (place == F.col("at")) | place.eqNullSafe(F.col("at"))).withColumn("first_doc_id", F.col("at.doc_id")).drop("at")


def by_document(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each row of docs (doc_id, text): n_repeated and n_removed paragraphs, the removed ones' bytes, and whose they repeat.

    doc_id, n_repeated long (paragraphs whose class has others), n_removed long (those that aren't the first),
    removed_words long, spans string ("a-b" in bytes of the text, comma-joined, in order), class_doc_ids
    array<long> (the doc_ids of the first paragraphs of its classes, sorted). Each row is told of its own text, also
    where a doc_id is null or stands with several texts; rows that repeat have the same values, and each other's
    paragraphs as repeats. Null, empty and blank texts have no paragraphs. An empty table gives no rows.
    """
    found = classes(docs, num, den)
    gone = F.array_sort(F.collect_set(F.when(~F.col("first"), F.struct("a", "b", "words"))))
    per = found.groupBy("doc_id", "k").agg(gone.alias("gone"), F.size(F.collect_set("idx")).alias("n_repeated"), F.array_sort(F.collect_set("first_doc_id")).alias("class_doc_ids"))
    per = per.withColumnRenamed("doc_id", "of")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k"))
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["of"]) & (rows["k"] == per["k"]), "left")
    gone = F.coalesce("gone", F.expr("cast(array() as array<struct<a:int,b:int,words:int>>)"))
    removed = F.aggregate(gone, F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return out.select(
        "doc_id", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), F.size(gone).cast("long").alias("n_removed"), removed.alias("removed_words"),
        F.array_join(F.transform(gone, lambda s: F.concat_ws("-", s["a"], s["b"])), ",").alias("spans"), F.coalesce("class_doc_ids", F.array().cast("array<long>")).alias("class_doc_ids"),
    )
