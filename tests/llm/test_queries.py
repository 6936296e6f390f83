"""The registered queries and the pipeline over whole tables: against DuckDB where SQL can express them, else by what must hold of every row."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from auditmill.llm import mixing, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert sorted(([r[c] for c in cols] for r in df.collect()), key=str) == sorted(([r[rel.columns.index(c)] for c in cols] for r in rel.fetchall()), key=str)


def test_paragraphs(spark, texts):
    got = rows(spark, "op3_paragraphs")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        raw = texts[r.doc_id].encode()
        assert r.n_removed == len(spans) <= r.n_repeated and r.removed_words == sum(len(raw[a:b].split()) for a, b in spans)
        assert all(a < b <= len(raw) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_extract(spark, duck):
    """The pages' articles stand between their tags."""
    import html
    import re

    got = {r.page_id: r for r in rows(spark, "op4_extract")}
    for page_id, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h[1-6]|div|ul|li)>", inner)]
        want = " ".join(b for b in blocks if b)
        assert (got[page_id].text, got[page_id].n_chars) == (want, len(want))


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op5_fingerprint")}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        after, half = texts[order[(i + 1) % len(order)]], len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + after[:half]
        assert got[d].n_chars == len(texts[d]) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == 1.0 or got[d].fingerprint != got[d].edited_fingerprint
        assert 0 <= got[d].near_next <= 1 and (texts[d] != after or got[d].near_next == 1)


def test_neighbours(spark, duck):
    import numpy as np

    ids, vectors = zip(*duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
    x, place, found = np.array(vectors, float), {v: i for i, v in enumerate(ids)}, defaultdict(list)
    for r in rows(spark, "op6_ann"):
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = []
    for q in (v for v in ids if v % 20 == 0):
        score = (x * x[place[q]]).sum(axis=1)
        best = [ids[i] for i in np.lexsort((np.array(ids), -score)) if ids[i] != q][:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] == score[place[m[1]]] for m in mine)
        hits.append(len(set(best) & {m[1] for m in mine}) / 20)
    assert np.mean(hits) >= 0.9


def test_mixing(spark):
    by = defaultdict(list)
    for r in rows(spark, "op7_mixing"):
        by[r.source].append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size
    for found in by.values():
        assert abs(sum(r.taken for r in found) - found[0].target) <= max(r.size for r in found)


def test_toxicity(spark, texts):
    for r in rows(spark, "op8_toxicity"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def check_packed(found):
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_packing(spark, texts):
    found = rows(spark, "op9_packing")
    total = sum(r.length for r in found)
    assert check_packed(found) <= 1 + 1.02 * max(total / 1024, sum(r.length > 512 for r in found))
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert set(pieces) == set(texts)
    for p in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(p)):
            assert (piece, start) == (k, at) and (length == 1024 or k == 0)
            at += length


def test_licenses(spark):
    for r in rows(spark, "op10_licenses"):
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_pipeline(spark, duck):
    """Each stage on what the one before kept, against the same operators' queries and plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        kept.append(docs.collect())
    toxic = {r.doc_id for r in rows(spark, "op8_toxicity") if r.predicted}
    everyone = {r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()}
    assert {r.doc_id for r in kept[0]} == everyone - toxic

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {r.doc_id: shingles(r.text) for r in kept[0]}
    left = {r.doc_id for r in kept[1]}
    alike = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and alike(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert left == {top(d) for d in sets}
    seen = Counter()
    raw = {r.doc_id: r.text.encode() for r in kept[1]}
    for t in raw.values():
        seen.update(t[i : i + 200] for i in range(len(t) - 199))
    for r in kept[2]:
        t, gone = raw[r.doc_id], [False] * len(raw[r.doc_id])
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        assert r.text == bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    taken = {(r.doc_id, r.copies) for r in mixing.mix_table(spark.createDataFrame(kept[2], docs.schema)).collect() if r.copies}
    assert set(Counter(r.doc_id for r in kept[3]).items()) == taken
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    check_packed(packed)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in kept[3])
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)
