"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions alone.

Each document's fractional number of copies is its source's target over its source's size. Copies are made
integral in pairs: mass, in words, moves from one document of a pair to the other, in a direction drawn so
that neither's expected copies change, until one of them is integral; the other goes on. So all words a
source takes stay at its target but for the last document's rounding. Pairs are made within chunks of a
bounded number of documents, the largest first; each chunk leaves one fractional document, and those go up
a tree of chunks until each source has one. That one goes to the nearer number of copies, and at most two
others are turned if their sizes make up for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.common import written

#: Documents in a chunk on average.
CHUNK = 128
#: Documents of a source that are turned at the end where that brings it nearer to its target.
CORRECTIONS = 2
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def word_count(text: Column) -> Column:
    """The number of words: places where a word begins. White space becomes one space, so that a cheap split is enough."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(plain, F.lit("[^ ]++")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size, ...), one row a source.

    Weights go by source in code point order, null last, and repeat. A target is the source's share by weight
    of `share` times all sizes, but `most` times its size at most; what is over is shared again by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # one row a source: a table of sources, not of documents
    rows = written(sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))), "sources")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * most
    level, full = 0.0, -1
    while True:
        held = cap <= level * F.col("weight")
        got = rows.agg(
            F.coalesce(F.sum(F.when(held, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)), F.count_if(held)
        ).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], max(level, (total - got[0]) / got[1])
    return rows.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _unit(*of: Column) -> Column:
    """A draw in [0, 1) that a rerun repeats."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _round_chunk(items: Column) -> Column:
    """Pairs the fractional items of a chunk one after the other.

    items: structs (size, key, copies), largest first. The result holds those done, and the one left over.
    The running item meets the next: mass moves up to one of the two bounds; each direction has the
    probability that keeps both items' expected copies.
    """
    state = F.struct(
        F.expr("cast(null as struct<size:bigint,key:bigint,id:bigint,copies:double>)").alias("open"),
        F.expr("cast(array() as array<struct<id:bigint,size:bigint,copies:double>>)").alias("done"),
    )

    def step(acc: Column, x: Column) -> Column:
        # words that must move for a to reach its floor and b its ceiling, or the other way round
        return F.when(
            acc["open"].isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))
        ).otherwise(_pair(acc["open"], x, acc["done"]))

    return F.aggregate(items, state, step)


def _pair(a: Column, b: Column, done: Column) -> Column:
    def parts(x: Column) -> tuple[Column, Column]:
        return x["copies"] - F.floor(x["copies"]), F.ceil(x["copies"]) - x["copies"]

    (a_down, a_up), (b_down, b_up) = parts(a), parts(b)
    down = F.least(a_down * a["size"], b_up * b["size"])  # words from a to b
    up = F.least(a_up * a["size"], b_down * b["size"])  # words from b to a
    goes_down = _unit(a["key"], b["key"]) * (down + up) < up

    def moved(x: Column, words: Column) -> Column:
        c = x["copies"] + words / x["size"]
        near = F.round(c)
        return F.when(F.abs(c - near) < 1e-9, near).otherwise(c)

    shift = F.when(goes_down, down).otherwise(-up)
    # the one that reached its bound, by construction and not by a comparison of doubles
    a_first = F.when(goes_down, a_down * a["size"] <= b_up * b["size"]).otherwise(a_up * a["size"] <= b_down * b["size"])
    whole_a = F.when(goes_down, F.floor(a["copies"])).otherwise(F.ceil(a["copies"])).cast("double")
    whole_b = F.when(goes_down, F.ceil(b["copies"])).otherwise(F.floor(b["copies"])).cast("double")

    def open_as(x: Column, copies: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["key"].alias("key"), x["id"].alias("id"), copies.alias("copies"))

    new_a, new_b = moved(a, -shift), moved(b, shift)
    return F.when(
        a_first, F.struct(open_as(b, new_b).alias("open"), F.concat(done, F.array(F.struct(a["id"].alias("id"), a["size"].alias("size"), whole_a.alias("copies")))).alias("done"))
    ).otherwise(F.struct(open_as(a, new_a).alias("open"), F.concat(done, F.array(F.struct(b["id"].alias("id"), b["size"].alias("size"), whole_b.alias("copies")))).alias("done")))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))


def copies(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Integral copies for each row of (doc_id, source, size): doc_id, source, size, source_size, target, copies long.

    A row without words takes no part in rounding: it gets one copy if its source has a target, else none.
    Null sources are a source of their own, the last; null doc_ids are documents like others; rows that
    repeat are documents of their own. An empty table gives no rows. Reruns on the same rows agree.
    """
    sizes = written(sizes, "sizes")
    of = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most)
    of = written(of.select(F.col("source").alias("of"), "source_size", "docs", "target"), "targets")
    rows = sizes.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", share_of)
    fixed = (F.col("size") == 0) | (F.floor("copies") == F.col("copies"))
    given = F.when(F.col("size") == 0, F.when(F.col("target") > 0, 1.0).otherwise(0.0)).otherwise(F.col("copies"))
    done = rows.where(fixed).select("source", "doc_id", "size", given.alias("copies"))
    rows = rows.where(~fixed).withColumns({"key": F.xxhash64("doc_id", "size"), "chunks": F.ceil(F.col("docs") / CHUNK)})
    rows = rows.withColumn("chunk", F.pmod(F.col("key"), F.col("chunks")))
    level = rows.select("source", "chunk", F.struct("size", "key", F.col("doc_id").alias("id"), "copies").alias("x"))
    left = int(of.agg(F.max(F.ceil(F.col("docs") / CHUNK))).first()[0] or 0)
    while left:
        items = F.sort_array(F.collect_list("x"), asc=False)
        folded = written(level.groupBy("source", "chunk").agg(items.alias("xs")).select("source", "chunk", _round_chunk(F.col("xs")).alias("r")), "rounded")
        done = done.unionByName(folded.select("source", F.explode("r.done").alias("d")).select("source", F.col("d.id").alias("doc_id"), F.col("d.size").alias("size"), F.col("d.copies").alias("copies")))
        level = folded.where("r.open is not null").select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), F.col("r.open").alias("x"))
        left = 0 if left == 1 else -(-left // CHUNK)
    # each source's last document goes to the nearer number of copies
    done = done.unionByName(level.select("source", F.col("x.id").alias("doc_id"), F.col("x.size").alias("size"), F.round("x.copies").alias("copies")))
    done = written(done.withColumns({"copies": F.col("copies").cast("long"), "row": F.monotonically_increasing_id()}), "integral")
    for _ in range(CORRECTIONS):
        done = _corrected(done, of)
    return done.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of", "docs", "row")


def _corrected(done: DataFrame, of: DataFrame) -> DataFrame:
    """Turns one document's copies in each source to the other whole number where that brings its words nearer to the target."""
    now = done.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
    now = now.join(of, F.col("source").eqNullSafe(F.col("of"))).where("source_size > 0").select("of", (F.col("words") - F.col("target")).alias("over"), (F.col("target") / F.col("source_size")).alias("share"))
    rows = done.join(now, F.col("source").eqNullSafe(F.col("of"))).where("size > 0")
    turns = F.when(F.col("over") > 0, F.col("copies") > F.floor("share")).otherwise(F.col("copies") < F.ceil("share"))
    off = F.abs(F.abs("over") - F.col("size"))
    best = rows.where(turns & (off < F.abs("over") - 0.5)).groupBy("of").agg(F.min(F.struct(off.alias("off"), "doc_id", "row", F.when(F.col("over") > 0, -1).otherwise(1).alias("step"))).alias("b"))
    turned = done.join(best.select(F.col("b.row").alias("row"), "b.step"), "row", "left")
    return written(turned.withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step"), "corrected")


def mix_table(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    return copies(_sized(docs)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they were, whatever else there is."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(v) for c, v in names.items()], docs["doc_id"].cast("long").alias("doc_id"), word_count(docs["text"].cast("string")).alias("size"))
    taken = mix_table(docs).select(F.col("doc_id").alias("id"), F.col("size").alias("words"), F.col("source").alias("from"), "copies")
    # rows that repeat share out their copies in turn
    own = Window.partitionBy("doc_id", "size", "src").orderBy(F.lit(0))
    rows = rows.withColumn("src", F.col(names["source"]).cast("string")).withColumn("nth", F.row_number().over(own))
    taken = taken.withColumn("k", F.row_number().over(Window.partitionBy("id", "words", "from").orderBy("copies")))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("words")) & F.col("src").eqNullSafe(F.col("from")) & (F.col("nth") == F.col("k"))
    out = rows.join(taken, on).where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(v).alias(c) for c, v in names.items()])
