"""Texts that repeat a line within themselves, and copies of them: few rows, the same spans."""

import random

import numpy as np
import pyarrow as pa
from test_llm_operators import removed

from auditmill.llm import suffix

LINE = "A line that stands very often, on and on. "


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    prose = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = [rnd.choice(prose)[rnd.randrange(90) :] + LINE * rnd.randrange(30) + rnd.choice(prose)[: rnd.randrange(300)] for _ in range(40)]
    return out + [LINE * 200, "a" * 3000, "ab" * 900, "é" * 500, "", "short"] + out[:3] * 4


def test_places_of_a_text_are_one_row():
    """A text of one line 200 times has a row for each kind of segment, with all its places."""
    batch = pa.RecordBatch.from_pydict({"k1": [1, 2, 2], "k2": [1, 2, 2], "text": [LINE * 200, "a" * 3000, "a" * 3000]})
    rows = pa.Table.from_batches(suffix._sample(60)(iter([batch]))).to_pylist()
    data, off = suffix.text_bytes(batch.column(2))
    text, lo, count, core, own = suffix.segments(data, off, 60)
    assert len(text) > 1000 and len(rows) < 30
    got = sorted((r["k1"], at, r["n"], r["core"], r["seg"]) for r in rows for at in [r["lo"], *(r["more"] or [])])
    k1 = np.array([1, 2, 2])[text]
    assert got == sorted(zip(k1.tolist(), lo.tolist(), count.tolist(), suffix.signed(core).tolist(), suffix.signed(own).tolist()))
    assert all(r["more"] is None or r["lo"] < min(r["more"]) and r["more"] == sorted(r["more"]) for r in rows)


def test_united_spans():
    """Against bytes marked one by one; spans that touch are one, texts don't run into each other."""
    rnd = random.Random(3)
    found = [[{"lo": min(at := sorted(rnd.sample(range(400), rnd.randrange(1, 4)))), "more": at[1:] or None, "a": (a := rnd.randrange(5)), "b": a + rnd.randrange(1, 6)} for _ in range(rnd.randrange(1, 9))] for _ in range(50)]
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("more", pa.list_(pa.int32())), ("a", pa.int32()), ("b", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64())] * 2 + [pa.array(found, kind)], names=["k1", "k2", "spans"])
    for part in (batch, batch.slice(7, 20), batch.slice(0, 0)):
        (out,) = suffix._unite(10)(iter([part]))
        for spans, r in zip(part.column(2).to_pylist(), out.to_pylist(), strict=True):
            gone = np.zeros(500, np.int8)
            for s in spans:
                for at in [s["lo"], *(s["more"] or [])]:
                    gone[at + s["a"] + 1 : at + s["b"] + 10] = 1
            assert r["edges"] == np.flatnonzero(np.diff(gone)).tolist()[: len(r["edges"])] and len(r["edges"]) == 2 * r["n_spans"] == (np.diff(gone) != 0).sum() and r["n_removed"] == gone.sum()


def test_repeated_lines(spark):
    """All bytes as by brute force, with whole cores and with cores dealt over tasks."""
    import hashlib

    want = removed(texts(), 60)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for shard, task in ((1 << 20, 16 << 20), (300, 900)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.repeated_spans(docs, length=60, shard_bytes=shard, task_bytes=task).collect()}
        assert [got[i] for i in range(len(want))] == want
