"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names: each operator has a result."""

import pytest

from auditmill.llm import ann, extract, fingerprint, licenses, minhash, mixing, packing, paragraphs, stages, suffix, toxicity

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(9000))
TEXTS = [None, "", " \t\n", "one", "a b c d", "same text of six words here", "same text of six words here", "MIT License", LONG, LONG + " end", "é" * 500, "a" * 900, "idiot. You idiot!"]
#: Names that operators use within.
EXTRA = "n long, k1 long, score double, size long, bands string, kept string, id string, n_removed string, edges string, `_0` string, copies long, component string"


def frame(spark, rows=None):
    if rows is None:
        rows = [(i, t, "en" if i % 2 else None, [None, "s1", "s2"][i % 3], len(t) if t else None) for i, t in enumerate(TEXTS)]
        rows += [rows[5], rows[5], (None, "text without an id", None, None, None), (None, None, None, None, None)]
    extra = tuple([None] * len(EXTRA.split(",")))
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


OPERATORS = {
    "minhash": minhash.near_duplicates, "suffix": suffix.repeated_spans, "suffix_text": suffix.without_repeats, "paragraphs": paragraphs.by_document, "fingerprint": fingerprint.edit_test, "fingerprints": fingerprint.fingerprints,
    "mixing": mixing.mix_table, "packing": packing.pack, "licenses": licenses.scan, "toxicity": lambda d: toxicity.score(d, toxicity.unlearned()),
}
#: Operators that give a row for each row.
ONE_EACH = set(OPERATORS) - {"packing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = frame(spark)
    got = OPERATORS[name](docs).collect()
    if name in ONE_EACH:
        assert len(got) == docs.count()


def by_id(df, *columns):
    """The columns' values for each doc_id, rows that repeat side by side."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return {d: sorted(v, key=str) for d, v in out.items()}


def test_odd_values(spark):
    """What each operator says of null, empty, blank and repeated rows: TEXTS 0 to 2 hold no word, 5 stands three times, 6 is its copy."""
    docs = frame(spark)
    got = by_id(minhash.near_duplicates(docs), "n_shingles", "component_id")
    assert [got[i] for i in range(5)] == [[(0, i)] for i in range(3)] + [[(1, 3)], [(1, 4)]]
    assert got[5] == [(2, 5)] * 3 and got[6] == [(2, 5)] and got[9] == [(got[9][0][0], 8)] and got[None] == [(0, None), (1, None)]
    got = by_id(suffix.repeated_spans(docs), "n_bytes", "n_removed", "n_spans")
    assert got[0] == got[1] == [(0, 0, 0)] and got[2] == [(3, 0, 0)] and got[5] == [(len(TEXTS[5]), 0, 0)] * 3 and got[11] == [(900, 900, 1)]
    assert got[8] == [(len(LONG), len(LONG), 1)] and got[9] == [(len(LONG) + 4, len(LONG), 1)] and got[None] == [(0, 0, 0), (18, 0, 0)]
    texts = by_id(suffix.without_repeats(docs), "text")
    assert texts[0] == [None] and texts[1] == [""] and texts[9] == [" end"] and texts[11] == [""]
    got = by_id(paragraphs.by_document(docs), "n_repeated", "n_removed")
    assert got[0] == got[1] == got[2] == got[3] == [(0, 0)] and got[6] == [(1, 1)] and all(n[0] >= 1 for n in got[5]) and len(got[5]) == 3
    got = by_id(fingerprint.edit_test(docs), "n_chars", "fingerprint")
    assert got[0] == got[1] == [(0, "")] and got[2] == [(3, "")] and len(set(got[5])) == 1 and got[5][0][1] == got[6][0][1] != ""
    got = by_id(fingerprint.fingerprints(docs), "n_chars", "n_distinct")
    assert got[0] == got[1] == [(0, 0.0)] and got[3] == [(3, 1.0)] and got[5] == [(len(TEXTS[5]), 2.0)] * 3
    got = by_id(mixing.mix_table(docs), "size", "taken")
    assert [got[i][0] for i in range(3)] == [(0, 0)] * 3 and all(t <= 2 * n and t % n == 0 for v in got.values() for n, t in v if n)
    got = by_id(packing.pack(docs), "length")
    assert got[0] == got[1] == [1] and got[None][0] == 1 and len(got[5]) == 3 and len(set(got[5])) == 1 and sum(got[9]) == sum(got[8]) + 1
    got = by_id(licenses.scan(docs), "n_words", "n_base", "first_word", "labels", "score")
    assert got[0] == got[1] == got[2] == [(0, 0, None, "", 0.0)] and got[7][0][:4] == (2, 1, 0, "mit") and got[7][0][4] == 1.0 and got[None][0][:2] == (0, 0)
    got = by_id(toxicity.score(docs, toxicity.unlearned()), "score", "predicted")
    assert got[0] == got[1] == got[2] == got[3] and got[0][0][1] == 0 and got[12][0][1] == 1 and got[8][0][1] == 0 and len(got[5]) == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>"), (3, "u", "plain words"), (3, "u", "plain words"), (4, "u", "<article><p>" + "A long text. " * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "'x' as h", "0 as y", "null as x0")
    got = extract.extract(df).collect()
    assert [r.text for r in got[:3]] == ["", "", ""] and got[3].text == got[4].text and got[5].n_chars == 9000 * 13 - 1
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (2, [0.0, 2.0]), (1, [2.0, 0.0])]
    # of the two vectors of vec_id 1 the smaller one takes part
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as ids", "4 as score", "5 as query_id", "6 as bucket")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 1.0), (20, 1.0), (2, 0.0)], 20: [(0, 1.0), (1, 1.0), (2, 0.0)]}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, k, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark)
    name, stage = stages.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
