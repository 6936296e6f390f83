"""How files are looked up in the postings: words by weight, until each template is closed; and all alignments that hold."""

import random

import numpy as np

from auditmill.llm import licenses


def laid(index, texts):
    """Vocabulary numbers of texts laid end to end, and where each begins."""
    number = {w: i for i, w in enumerate(index.vocabulary)}
    split = [licenses.WORD.findall(t.lower()) for t in texts]
    return np.array([number.get(w, -1) for ws in split for w in ws], np.int64), np.cumsum([0, *map(len, split)])


def by_hand(index, numbers):
    """Every template at every place of one text, partly before and after it too."""
    for t, (label, _, _, base) in enumerate(index.templates):
        ids, at, size = index.ids[t], index.key_at[t], index.key_size[t]
        line = np.concatenate([np.full(len(ids), -1), numbers, np.full(len(ids), -1)])
        for start in range(len(line) - len(ids) + 1):
            hit = line[start : start + len(ids)] == ids
            if hit[at : at + size].all() and index.idf[ids][hit].sum() >= licenses.ENOUGH * index.total[t]:
                yield start - len(ids) + at, label, index.idf[ids][hit].sum() / index.total[t], base


def changed(rnd):
    ws = rnd.choice(licenses.NOTICES)[1].split()
    for _ in range(rnd.choice([0, 1, 3, 8])):
        ws[rnd.randrange(len(ws))] = rnd.choice(["other", "the", "license", "software", "of"])
    a, b = sorted(rnd.sample(range(len(ws) + 1), 2)) if rnd.random() < 0.5 else (0, len(ws))
    return " ".join([*rnd.choices(["the", "mit", "general", "word", "License"], k=rnd.randint(0, 4)), *ws[a:b]])


def test_all_alignments_whatever_the_weights():
    """Weights as they come: license words rare, common, all alike."""
    rnd = random.Random(5)
    texts = ["", "mit license", "the " * 50, *(" ".join(changed(rnd) for _ in range(rnd.randint(1, 3))) for _ in range(150))]
    vocabulary = licenses.Index().vocabulary
    for df in ({}, {w: rnd.randint(0, 1000) for w in vocabulary}, dict.fromkeys(vocabulary, 7), dict.fromkeys(vocabulary, 1000)):
        index = licenses.Index(df, 1000)
        numbers, first = laid(index, texts)
        got = [(t, start - first[t], label, round(share, 9), base) for t, start, label, share, base in index.scan(numbers, first)]
        want = [(t, start, label, round(share, 9), base) for t in range(len(texts)) for start, label, share, base in by_hand(index, numbers[first[t] : first[t + 1]])]
        assert sorted(got) == sorted(want) and len(got) > 100


def test_words_go_by_weight_and_stop():
    rnd = random.Random(9)
    index = licenses.Index({w: rnd.randint(0, 1000) for w in licenses.Index().vocabulary}, 1000)
    texts = [n[1] for n in licenses.NOTICES] + ["mit license", "license mit apache", "no such thing"]
    numbers, first = laid(index, texts)
    has = np.zeros((len(texts), len(index.vocabulary)), bool)
    for f in range(len(texts)):
        mine = numbers[first[f] : first[f + 1]]
        has[f, mine[mine >= 0]] = True
    asked = index.looked_up(has)
    assert not asked[-1].any() and (asked & ~has[:, :, None]).sum() == 0
    for f in range(len(texts)):
        for t in np.flatnonzero(asked[f].any(axis=0)):
            own = [w for w in index.order if has[f, w] and index.part[w, t]]
            many = int(asked[f, :, t].sum())
            # the file's words of most weight in the template, up to the first of its key phrase at the latest
            assert set(np.flatnonzero(asked[f, :, t])) == set(own[:many])
            assert not any(index.key[w, t] for w in own[: many - 1])
            rest = sum(index.part[w, t] for w in own[many:])
            assert index.key[own[many - 1], t] or rest < licenses.ENOUGH * index.total[t]
    # each notice is looked up in its own postings
    for k in range(len(licenses.NOTICES)):
        assert asked[k, :, len(licenses.BASE) + k].any()


def test_many_files_at_once():
    """Files beyond one block of the walk give what each gives alone."""
    rnd = random.Random(3)
    texts = [changed(rnd) if i % 3 else "plain words" for i in range(2 * licenses.FILES + 5)]
    index = licenses.Index()
    numbers, first = laid(index, texts)
    got = sorted((t, s - first[t], label) for t, s, label, _, _ in index.scan(numbers, first))
    alone = sorted((t, s, label) for t, text in enumerate(texts) for _, s, label, _, _ in index.scan(*laid(index, [text])))
    assert got == alone
