"""Paragraphs of few words, split here line by line, without the operator's own cut."""

import random
from collections import Counter

from auditmill.llm import paragraphs


def test_short_lines(spark):
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    common = [" ".join(rnd.choices(words, k=n)) for n in (1, 2, 3, 4, 5, 6, 7)]
    texts = []
    for _ in range(40):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(9, 11))) for _ in range(3)] + rnd.sample(common, 3)
        rnd.shuffle(lines)
        texts.append("\n".join(line.title() if rnd.random() < 0.3 else line for line in lines))
    texts += ["", "Alone", common[0], " ".join(common[1].split()).upper()]
    lines = [[line.lower() for line in t.split("\n") if line] for t in texts]
    often, seen, want = Counter(line for t in lines for line in t), set(), {}
    for d, t in enumerate(lines):
        repeated = [line for line in t if often[line] > 1]
        removed = [line for line in repeated if line in seen or seen.add(line)]
        want[d] = (len(repeated), len(removed), sum(len(line.split()) for line in removed))
    got = paragraphs.by_document(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_repeated, r.n_removed, r.removed_words) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 60
