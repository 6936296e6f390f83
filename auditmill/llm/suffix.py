"""Removal of long byte strings that start at two or more places of a corpus.

Which strings meet. Every 400-byte window has an anchor: the place of its smallest 32-byte gram (leftmost
if several tie). Equal windows have their anchors at the same offset, so a window needs to be compared only
with windows whose bytes around the anchor (the core, 216 bytes that every window of a block contains) are
the same. Neighbouring windows of one anchor and block form a segment. A text's segments with the same
bytes are one row with all their places, so a text that repeats a line many times has few rows. Only segments
whose core occurs again go on; segments with the same bytes are one, with a count.

What decides. Segments are dealt by core into shards; a core with more segments than a task should hold is
dealt over several tasks. A shard's segments are laid end to end; a suffix array is built by prefix doubling
that refines only groups not yet sorted (Larsson and Sadakane), down to the window's length and no further;
Kasai's common prefixes of neighbours then tell which windows are repeated. A core that more than one shard
holds gives, from each, its distinct windows as a sorted run; the runs are cut at the same places, and each
range is merged by binary search. A window stands in its run as two numbers of 64 bits, so that a run's size
doesn't grow with the window's length: windows of one core that agree in both are taken for equal, as are
segments that agree in their core's number, their own and their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import U, chunks, mix, prefix_hash, signed, small_batches, span_hash, text_bytes, written

LENGTH = 400
GRAM = 32
#: Bytes of segments that one suffix array covers.
SHARD_BYTES = 1 << 20
#: Bytes of one core's segments that a task gets; a larger core is dealt over several.
TASK_BYTES = 16 << 20
#: Window starts that are sampled at once, and bits for a place among them.
SLICE, PLACE = 1 << 22, 23


# ---------------------------------------------------------------- suffix arrays
def packed(text: np.ndarray) -> np.ndarray:
    """The next eight bytes at each place as one number, most significant first; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U)
    for k in range(8):
        out = (out << U(8)) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes, and each suffix's rank; suffixes equal so far share one."""
    n = len(text)
    key = packed(text)
    order = np.argsort(key, kind="stable").astype(np.int64)
    slots = np.arange(n)
    sorted_key = key[order]
    rank, h = np.empty(n, np.int64), 8
    while True:
        # slots: those not yet settled, in order; a group starts where the key changes
        fresh = np.ones(len(slots), bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        begin = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[order[slots]] = begin
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = slots[~alone]
        if h >= depth or not len(slots):
            return order, rank
        step = min(h, depth - h)
        at = order[slots]
        later = at + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        both = (rank[at].astype(U) << U(32)) | second.astype(U)
        by = np.argsort(both, kind="stable")
        order[slots] = at[by]
        sorted_key = both[by]
        h += step


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before it, `limit` at most.

    Kasai's bound, a suffix k places later shares at most k bytes less with its own neighbour, is used at
    halving strides, so that all suffixes of a stride are extended at once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    eight = packed(text)
    shared = np.zeros(n, np.int64)
    stride = 256
    at = np.arange(0, n, stride)
    while True:
        live = at[before[at] >= 0]
        while len(live):
            x, y = live + shared[live], before[live] + shared[live]
            on = (np.maximum(x, y) < n) & (shared[live] < limit)
            live, x, y = live[on], x[on], y[on]
            diff = eight[x] ^ eight[y]
            equal = np.full(len(diff), 8, np.int64)
            for k in range(8):
                equal[(diff >> U(56 - 8 * k) & U(255) != 0) & (equal == 8)] = k
            shared[live] += np.minimum(equal, n - np.maximum(x, y))
            live = live[equal == 8]
        if stride == 1:
            return np.minimum(shared, limit)[order]
        stride //= 2
        at = np.arange(stride, n, 2 * stride)
        # suffixes that tie within the limit can stand the other way round later on; then nothing is known
        then = before[at - stride] + stride
        sound = (before[at - stride] >= 0) & (then < n) & (before[at] >= 0)
        sound &= slot[np.minimum(then, n - 1)] < slot[at]
        shared[at] = np.where(sound, np.maximum(shared[at - stride] - stride, 0), 0)


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at `starts`: which of them have an equal among them, and the number of each one's class."""
    order, _ = suffix_array(text, length)
    shared = common_prefixes(text, order, length)
    mine = np.zeros(len(text), bool)
    mine[starts] = True
    slots = np.flatnonzero(mine[order])
    # two windows share what all neighbours between them share
    if not len(slots):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    least = np.minimum.reduceat(shared[: slots[-1] + 1], np.concatenate([[0], slots[:-1] + 1]))
    least[0] = 0
    same = least >= length
    twice = same.copy()
    twice[:-1] |= same[1:]
    flag, group = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    flag[order[slots]] = twice
    group[order[slots]] = np.cumsum(~same)
    return flag[starts], group[starts]


# ---------------------------------------------------------------- anchors and segments
def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """All windows, in runs of one anchor and block: text number, first window, windows, core hash, hash of the bytes."""
    n, half = len(data), (length - gram) // 2
    out = []
    prefix = prefix_hash(data)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    for base in range(0, max(0, n - length + 1), SLICE):
        many = min(SLICE, n - length + 1 - base)  # windows that start here
        grams = np.arange(base, base + many + length - gram)
        least = (span_hash(prefix, grams, grams + gram) >> U(PLACE) << U(PLACE)) | (grams - base).astype(U)
        width = 1
        while 2 * width <= length - gram + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = length - gram + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        start = np.arange(base, base + many)
        inside = start + length <= end_of[start]
        start = start[inside]
        anchor = (least[:many][inside] & U((1 << PLACE) - 1)).astype(np.int64) + base
        left = anchor - start > half
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(start) > 1) | (np.diff(anchor) != 0) | (left[1:] != left[:-1])
        new[1:] |= end_of[start[1:]] != end_of[start[:-1]]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        lo, p, left = start[first], anchor[first], left[first]
        # every window of the block contains the core
        a = np.where(left, p - half - 1, p)
        b = np.where(left, p + gram, p + length - half)
        core = span_hash(prefix, a, b) ^ mix(left.astype(U) + U(9))
        own = span_hash(prefix, lo, lo + count + length - 1) ^ mix((p - lo).astype(U) + U(3))
        out.append((np.searchsorted(offsets, lo, "right") - 1, lo, count, core, own))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    text, lo, count, core, own = map(np.concatenate, zip(*out))
    return text, lo - offsets[text], count, core, own


def places(text: np.ndarray, lo: np.ndarray, count: np.ndarray, core: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Rows for segments that agree in text, bytes and length: the first one's index, and where the others start (null if there are none)."""
    n = len(text)
    order = np.argsort(mix(core ^ mix(own + text.astype(U))), kind="stable")
    same = np.zeros(n, bool)
    same[1:] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (text, count, core, own)])
    head = np.flatnonzero(~same)
    more = np.diff(np.append(head, n)) - 1
    by = np.argsort(order[head])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    others = order[same][np.argsort(rank[(np.cumsum(~same) - 1)[same]], kind="stable")]
    ends = np.concatenate([[0], np.cumsum(more[by])]).astype(np.int32)
    return order[head][by], pa.ListArray.from_arrays(pa.array(ends), pa.array(lo[others].astype(np.int32)), mask=pa.array(more[by] == 0))


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, off = text_bytes(part.column(2))
                text, lo, count, core, own = segments(data, off, length)
                one, more = places(text, lo, count, core, own)
                k1, k2 = (part.column(i).to_numpy(zero_copy_only=False)[text[one]] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.array(lo[one].astype(np.int32)), more, pa.array(count[one].astype(np.int32)), pa.array(signed(core[one])), pa.array(signed(own[one]))],
                    names=["k1", "k2", "lo", "more", "n", "core", "seg"],
                )

    return run


# ---------------------------------------------------------------- shards
_RUNS = "core long, seg long, n int, runs array<struct<a:int,b:int>>, run int, prints array<long>, again array<long>, where array<struct<seg:long,n:int,w:int>>"
_SPAN, _WHERE = pa.struct([("a", pa.int32()), ("b", pa.int32())]), pa.struct([("seg", pa.int64()), ("n", pa.int32()), ("w", pa.int32())])
_RUN_TYPES = [("core", pa.int64()), ("seg", pa.int64()), ("n", pa.int32()), ("runs", pa.list_(_SPAN)), ("run", pa.int32()), ("prints", pa.list_(pa.int64())), ("again", pa.list_(pa.int64())), ("where", pa.list_(_WHERE))]


def window_prints(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers of each window: the polynomial hash of its bytes, and that of its bytes exchanged for others."""
    other = np.random.Generator(np.random.Philox(20240502)).permutation(256).astype(np.uint8)
    return tuple(signed(span_hash(prefix_hash(t), starts, starts + length)) for t in (text, other[text] ^ np.uint8(0x5B)))


def _shards(length: int, shard_bytes: int):
    """Streams segments sorted by core and share; gives each segment's repeated windows as runs, and sorted runs of the windows of cores that one shard can't hold."""

    def solve(rows: list[tuple], number: int | None):
        core, _, seg, n, body = (list(x) for x in zip(*((c, *r) for (c, *_), *r in rows)))
        text = np.frombuffer(b"".join(body), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(b) for b in body])[:-1]]).astype(np.int64)
        starts = np.concatenate([np.arange(a, a + k) for a, k in zip(at.tolist(), n)])
        twice, group = repeated_windows(text, starts, length)
        out, k = [], 0
        none = dict.fromkeys(name for name, _ in _RUN_TYPES)
        for c, s, m in zip(core, seg, n):
            edge = np.diff(np.concatenate([[0], twice[k : k + m].view(np.int8), [0]]))
            runs = [{"a": int(x), "b": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            out.append(none | {"core": c, "seg": s, "n": m, "runs": runs})
            k += m
        if number is not None:
            _, one = np.unique(group, return_index=True)
            prints, again = window_prints(text, starts[one], length)
            by = np.lexsort((again, prints))
            owner = np.repeat(np.arange(len(n)), n)[one[by]]
            inner = (np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n))[one[by]]
            where = [{"seg": seg[i], "n": n[i], "w": w} for i, w in zip(owner.tolist(), inner.tolist())]
            out.append(none | {"core": core[0], "run": number, "prints": prints[by].tolist(), "again": again[by].tolist(), "where": where})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(_RUN_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole cores share a shard; those that are dealt over tasks, or turn out too large, give runs
        held: list[tuple] = []
        size, own, cut = 0, 0, 0  # bytes held, of them of the last core and share; shards that these have filled
        last = None
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("core", "share", "shares", "seg", "n", "body"))):
                core, share, shares, *rest = row
                if (core, share) != last:
                    alone = held and (cut or last_shares > 1)
                    if held and (alone or shares > 1 or size > shard_bytes):
                        yield solve(held, (last[1] << 16) + cut if alone else None)
                        held, size = [], 0
                    last, last_shares, own, cut = (core, share), shares, 0, 0
                elif own > shard_bytes:
                    mine = [r for r in held if r[0] == last]
                    if len(mine) < len(held):
                        yield solve(held[: len(held) - len(mine)], None)
                    yield solve(mine, (share << 16) + cut)
                    held, size, own, cut = [], 0, 0, cut + 1
                held.append(((core, share), None, *rest))
                size += len(rest[2])
                own += len(rest[2])
        if held:
            yield solve(held, (last[1] << 16) + cut if cut or last_shares > 1 else None)

    return run


_PAIR = np.dtype([("p", np.int64), ("q", np.int64)])


def merge_runs(known: tuple[np.ndarray, np.ndarray], run: np.ndarray, base: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Merges a sorted run (pairs of numbers) into what is known by binary search; also gives the numbers of entries that met an equal."""
    pairs, number = known
    # the first numbers find the place; where several entries share one, the second tell them apart
    lo, hi = (np.searchsorted(pairs["p"], run["p"], side) for side in ("left", "right"))
    at, hit = lo.copy(), np.zeros(len(run), bool)
    for i in np.flatnonzero(hi > lo).tolist():
        at[i] = lo[i] + np.searchsorted(pairs["q"][lo[i] : hi[i]], run["q"][i])
        hit[i] = at[i] < hi[i] and pairs["q"][at[i]] == run["q"][i]
    met = np.concatenate([number[at[hit]], base + np.flatnonzero(hit)])
    new = ~hit
    return (np.insert(pairs, at[new], run[new]), np.insert(number, at[new], base + np.flatnonzero(new))), met


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted runs by core and range; gives windows that two runs share."""
    last, known, where = None, None, []
    names = ["core", "seg", "n", "a", "b"]
    for batch in batches:
        rows = []
        for core, part, prints, again, places in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("core", "part", "prints", "again", "where"))):
            if (core, part) != last:
                last, known, where = (core, part), (np.zeros(0, _PAIR), np.zeros(0, np.int64)), []
            run = np.empty(len(prints), _PAIR)
            run["p"], run["q"] = prints, again
            known, met = merge_runs(known, run, len(where))
            where += places
            rows += [(core, where[i]["seg"], where[i]["n"], where[i]["w"], where[i]["w"] + 1) for i in met.tolist()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])], names=names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted segments out of each text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            data, off = text_bytes(part.column(part.schema.get_field_index("text")))
            raw = data.tobytes()
            want = part.column(part.schema.get_field_index("want")).to_pylist()
            rows = [(w["core"], w["seg"], w["n"], raw[o + w["lo"] : o + w["lo"] + w["bytes"]]) for o, ws in zip(off.tolist(), want) for w in ws]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.binary()])], names=["core", "seg", "n", "body"])


def _unite(length: int):
    """Unites each text's removed spans, windows a to b of a segment at all its places: their number and bytes, and the starts and ends of them in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = batch.num_rows, batch.column(2)
            row = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
            lo, more, a, b = (found.flatten().field(c) for c in ("lo", "more", "a", "b"))
            lo, a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lo, a, b))
            # the first place of each, then the others
            again = np.repeat(np.arange(len(lo)), more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at, of = np.concatenate([lo, more.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]), np.concatenate([np.arange(len(lo)), again])
            # a text's numbers begin at a multiple of 2**32, which no place reaches
            start, end = ((row[of] << 32) + at + x for x in (a[of], b[of] + length - 1))
            by = np.argsort(start, kind="stable")
            start, reach = start[by], np.maximum.accumulate(end[by])
            first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])[: len(start)])
            edges = np.stack([start[first], reach[np.append(first[1:], len(start))[: len(first)] - 1]], axis=1)
            owner = edges[:, 0] >> 32
            edges -= owner[:, None] << 32
            count, size = np.bincount(owner, minlength=n), np.zeros(n, np.int64)
            np.add.at(size, owner, edges[:, 1] - edges[:, 0])
            ends = np.concatenate([[0], np.cumsum(2 * count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(edges.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(count.astype(np.int64)), lists], names=["k1", "k2", "n_removed", "n_spans", "edges"])

    return run


def _found(docs: DataFrame, text: str, length: int, shard_bytes: int, task_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """Each row's columns under other names, so that none can clash, with what is removed and what is kept."""
    small_batches(docs.sparkSession)
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # no name of docs can clash with ours
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    source = docs.select(*[docs[c].alias(v) for c, v in names.items()], body.alias("text"))
    source = source.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    long = source.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    found = written(long.mapInArrow(_sample(length), "k1 long, k2 long, lo int, more array<int>, n int, core long, seg long"), "segments")
    many = 1 + F.coalesce(F.array_size("more"), F.lit(0))
    # joins by core are with written tables and nothing after them is grouped by core, so Spark can split a core that has very many rows
    again = written(found.groupBy("core").agg(F.sum(many).alias("c")).where("c > 1").select("core"), "again")
    # copies of a text have the same keys, so they are one row from here on, with their number; a place in a text has one core
    mine = found.join(again, "core", "left_semi").groupBy("k1", "k2", "lo", "more", "seg", "n").agg(F.min("core").alias("core"), F.count("*").alias("c"))
    mine = written(mine, "candidates")
    parts = written(mine.groupBy("core", "seg", "n").agg(F.sum(F.col("c") * many).alias("c"), F.min(F.struct("k1", "k2", "lo")).alias("of")), "parts")
    several = written(parts.groupBy("core").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes")).where("kinds > 1"), "several")
    # written, so that its size is known when the join with it is planned: it is small or empty
    large = written(several.select("core", F.ceil(F.col("bytes") / task_bytes).cast("int").alias("shares")).where("shares > 1"), "large")
    want = parts.join(several, "core", "left_semi").select("of.k1", "of.k2", F.struct("core", "seg", "n", "of.lo", (F.col("n") + length - 1).alias("bytes")).alias("w"))
    want = want.groupBy("k1", "k2").agg(F.collect_list("w").alias("want"))
    # grouped before the join, so that each task sends one of a text's copies
    texts = long.groupBy("k1", "k2").agg(F.min("text").alias("text"))
    bodies = texts.join(want, ["k1", "k2"]).select("text", "want").mapInArrow(_slices, "core long, seg long, n int, body binary")
    # cores that are dealt over several tasks are few: each has more than task_bytes of distinct segments
    shares = F.coalesce("shares", F.lit(1))
    bodies = bodies.join(large, "core", "left").select("core", F.pmod(F.xxhash64("seg", "n"), shares).cast("int").alias("share"), shares.alias("shares"), "seg", "n", "body")
    shards = bodies.repartition("core", "share").sortWithinPartitions("core", "share", "seg", "n").mapInArrow(_shards(length, shard_bytes), _RUNS)
    shards = written(shards, "shards")
    inside = shards.where("run is null").select("core", "seg", "n", F.explode("runs").alias("r")).select("core", "seg", "n", "r.a", "r.b")
    # sorted runs of a core are cut by the leading bits of their entries: the cuts are the same for all runs
    cut = shards.where("run is not null").select("core", "run", F.explode(F.arrays_zip("prints", "again", "where")).alias("x"))
    cut = cut.select("core", "run", F.shiftright("x.prints", 58).alias("part"), F.col("x.prints").alias("p"), F.col("x.again").alias("q"), F.col("x.where").alias("w"))
    cut = cut.groupBy("core", "run", "part").agg(F.array_sort(F.collect_list(F.struct("p", "q", "w"))).alias("s"))
    cut = cut.select("core", "part", "run", F.col("s.p").alias("prints"), F.col("s.q").alias("again"), F.col("s.w").alias("where"))
    across = cut.repartition("core", "part").sortWithinPartitions("core", "part", "run").mapInArrow(_merge, "core long, seg long, n int, a int, b int")
    full = parts.where("c > 1").select("core", "seg", "n", F.lit(0).alias("a"), F.col("n").alias("b"))
    runs = inside.unionByName(across).unionByName(full)
    spans = mine.join(runs, ["core", "seg", "n"]).select("k1", "k2", F.struct("lo", "more", "a", "b").alias("s"))
    spans = spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")).mapInArrow(_unite(length), "k1 long, k2 long, n_removed long, n_spans long, edges array<int>")
    out = source.join(written(spans, "spans"), ["k1", "k2"], "left")
    raw = F.col("text").cast("binary")
    # what stays: before the first span, between spans, after the last
    pieces = F.expr("transform(sequence(0, n_spans), i -> struct(if(i = 0, 0, edges[int(2 * i - 1)]) as a, if(i = n_spans, octet_length(text), edges[int(2 * i)]) as b))")
    kept = F.when(F.col("n_spans").isNull(), raw).otherwise(F.aggregate(pieces, F.lit(b""), lambda acc, p: F.concat(acc, F.substring(raw, p.a + 1, p.b - p.a))))
    return out.withColumns({"n_bytes": F.octet_length("text").cast("long"), "n_removed": F.coalesce("n_removed", F.lit(0)).cast("long"), "n_spans": F.coalesce("n_spans", F.lit(0)).cast("long"), "kept": kept}), names


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Adds to docs: n_bytes, n_removed, n_spans (long), kept (binary): the text's UTF-8 bytes without repeated strings.

    A byte goes if a string of `length` bytes covers it that also starts at another place of the column, the
    same text included. Null texts are empty; texts shorter than `length` stay whole; rows that repeat lose
    everything that is long enough. Other columns come through; those named as the added ones are replaced.
    An empty table gives no rows.
    """
    out, names = _found(docs, text, length, shard_bytes, task_bytes)
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    return out.select(*[F.col(v).alias(c) for c, v in names.items() if c not in added], *added)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with each text cut down to what `repeated_spans` keeps; a character that lost a byte goes as a whole. Null texts stay null; an empty table stays one."""
    out, names = _found(docs, text, length, SHARD_BYTES, TASK_BYTES)
    out = out.withColumn("kept", F.col("kept").cast("string"))
    clean = F.when(F.expr("is_valid_utf8(kept)"), F.col("kept")).otherwise(F.replace(F.expr("make_valid_utf8(kept)"), F.lit("\ufffd"), F.lit("")))
    return out.select(*[(F.when(F.col("n_removed") > 0, clean).otherwise(F.col(v)) if c == text else F.col(v)).alias(c) for c, v in names.items()])
