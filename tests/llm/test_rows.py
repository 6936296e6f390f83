"""Several texts under one doc_id, and null doc_ids: every row is told of its own text."""

from auditmill.llm import minhash, paragraphs

A = " ".join(f"alpha{i}" for i in range(120))
B = " ".join(f"beta{i}" for i in range(120))
NEAR = B.replace("beta60", "other")
LINE = "This very line of text stands in more than one of them."


def test_no_link_is_lost(spark):
    """7 and 5 are alike whatever other text stands under id 1."""
    rows = [(1, A), (1, B), (7, B), (5, NEAR), (9, "Something else altogether in this one."), (None, B)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 116, 1), (1, 116, 1), (5, 116, 1), (7, 116, 1), (9, 2, 9), (None, 116, None)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(2, A), (2, B), (7, B), (5, NEAR), (3, A)], "doc_id long, text string")).collect()}
    assert got == {(2, 2), (7, 2), (5, 2), (3, 2)}
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(4, A), (3, A), (4, B), (5, NEAR)], "doc_id long, text string")).collect()}
    assert got == {(3, 3), (4, 3), (4, 4), (5, 4)}


def test_many_links_and_late_ones(spark):
    """Chains of texts, each like the next alone: components are whole, whatever round finds their links."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for c in range(3):
        words = [f"{w}c{c}" for w in base]
        for k in range(12):
            rows.append((100 * c + k, " ".join(words)))
            for j in range(4):
                words[(k * 31 + j * 7) % 400] = f"new{c}_{k}_{j}"
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: shingles(t) for d, t in rows}
    component = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]) and component[x] != component[y]:
                    component[x] = component[y] = min(component[x], component[y])
                    changed = True
    for rounds in (1, 2):
        was, minhash.PIVOT_ROUNDS = minhash.PIVOT_ROUNDS, rounds
        try:
            got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, num=90).collect()}
        finally:
            minhash.PIVOT_ROUNDS = was
        assert got == component


def test_paragraphs_by_row(spark):
    alone = "Nothing of this is anywhere else at all."
    rows = [(None, alone), (None, f"{LINE}\nAnd one line more."), (1, LINE), (2, "First, a line of its own.\n" + LINE), (2, "Short text of thirty-seven chars here"), (3, LINE), (3, LINE), (4, None), (5, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'x' as gone", "2 as idx")
    got = sorted(((r.doc_id, r.n_repeated, r.n_removed, r.removed_words, r.spans, r.class_doc_ids) for r in paragraphs.by_document(df).collect()), key=str)
    size = len(LINE)
    assert got == sorted([
        (None, 0, 0, 0, "", []), (None, 1, 1, 12, f"0-{size}", [1]), (1, 1, 0, 0, "", [1]), (2, 1, 1, 12, f"26-{26 + size}", [1]), (2, 0, 0, 0, "", []),
        (3, 1, 1, 12, f"0-{size}", [1]), (3, 1, 1, 12, f"0-{size}", [1]), (4, 0, 0, 0, "", []), (5, 0, 0, 0, "", []),
    ], key=str)
