"""Packing of tokenized documents into sequences by minimum bin slack.

Documents longer than a sequence are cut so that only the first piece is shorter. How pieces go together
depends on their lengths alone, and there are at most 1024 lengths: the plan is made from a table of counts
by length, which doesn't grow with the input. Per bin, the longest length left is taken, and bitset
subset-sum over the lengths still available finds the fullest bin with it; that combination is removed as
often as the counts allow. Pieces are then dealt to the plan's places by their rank among those of their
length, which is counted in blocks so that no task has to hold all pieces of one length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.common import chunks, small_batches, text_bytes, written

CAPACITY = 1024
END = 2
#: Pieces of one length and block on average; ranks are counted within blocks.
BLOCK = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str):
    """The byte-level BPE of a tokenizers file; special tokens' strings are ordinary text. tiktoken runs the same merges several times faster."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))
    if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE")
    # the usual byte alphabet of byte-level BPE: printable bytes stand for themselves, others for 256, 257, ...
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def splitting(path: str):
    """Encodes as the unchanged tokenizers file does: a text is split at the file's added tokens, which become their ids."""
    ordinary = encoder(path).encode_ordinary
    added = json.load(open(path, encoding="utf-8")).get("added_tokens", [])
    for t in added:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"{path} has an added token with conditions on its surroundings: {t['content']}")
    ids = {t["content"]: t["id"] for t in added}
    if not ids:
        return ordinary
    # the leftmost, and of those the longest
    cut = re.compile(f"({'|'.join(map(re.escape, sorted(ids, key=len, reverse=True)))})")

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return ordinary(text)
        out = []
        for i, part in enumerate(parts):
            out += [ids[part]] if i % 2 else ordinary(part)
        return out

    return encode


def _pieces(path: str, capacity: int, end: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = splitting(path) if added else encoder(path).encode_ordinary
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array(encode(text or ""), "<u4")
                    ids = np.append(ids, np.uint32(end))
                    n, at = len(ids), 0
                    size = n % capacity or capacity
                    piece = 0
                    while at < n:
                        rows.append((doc, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                        at, size, piece = at + size, capacity, piece + 1
                cols = list(zip(*rows)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, longest first, of the fullest bin that holds the longest length there is; of equally full bins, one with long lengths."""
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = counts[length] - (length == first)
        # so many copies at once as powers of two, so that a length takes few steps
        many = 1
        left = min(left, room // length)
        while left > 0:
            take = min(many, left)
            more = (reach | (reach << (take * length))) & mask
            if more != reach:
                steps.append((reach, length, take))
                reach = more
            left -= take
            many *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = [first]
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            out += [length] * take
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), until nothing is left."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        lengths = fullest(counts, capacity)
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        out.append((lengths, times))
    return out


def _places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: where a range of ranks begins, the sequence of its first rank, the offset."""
    at: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            found.setdefault(x, []).append((at.get(x, 0), base, offset))
            at[x] = at.get(x, 0) + times
            offset += x
        base += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in found.items()}


def _deal(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                begin, base, offset = table[int(x)]
                k = np.searchsorted(begin, rank[mine], "right") - 1
                seq[mine] = base[k] + rank[mine] - begin[k]
                off[mine] = offset[k]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, added: bool = True) -> DataFrame:
    """Packs documents (doc_id, text; more columns are ignored) into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece int, start, length, ids_crc32, sequence_id, offset long. A null
    or empty text is its end token alone. A null doc_id stays null; rows that repeat are documents of their
    own. An empty table gives no rows. The tokenizer file's added tokens become their ids, as the file itself
    says; without added their strings are ordinary text.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(rows.mapInArrow(_pieces(path, capacity, end, added), schema), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    # a rank is the pieces of that length in earlier blocks and those before it in its own block
    blocks = max(1, -(-max(counts.values(), default=1) // BLOCK))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)))
    before = pieces.groupBy("length", "block").agg(F.count("*").alias("c"))
    before = before.withColumn("base", F.sum("c").over(Window.partitionBy("length").orderBy("block")) - F.col("c")).drop("c")
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "block"]).withColumn("rank", (F.col("own") + F.col("base")).cast("long"))
    return ranked.mapInArrow(_deal(places), f"{schema}, sequence_id long, offset long")
