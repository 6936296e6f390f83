"""Toxicity by a weighted finite-state grammar over clauses, with weights learned from labels.

A text's words are tagged (insult, threat, target, negation, report, other; quotation marks are tags too). A
clause ends at . ! ? ; or a line's end and is read whole, once, by two weighted transducers: one from right to
left, which raises insults and threats that a target follows ("kill them all"), and one from left to right, the
composition of three: a target before an insult or threat raises it and a threat without any target is
weakened; a negation before it weakens it; a report verb governs the rest of its clause and a quotation what
stands within it, and weakens that. Quotation marks count in pairs within a line; one left over counts for
nothing. What is left in the clause is its match. A text's score is a logistic model of its clauses' matches.

The insult lexicon is learned: stems (beginnings of words) and whole words that occur in toxic texts and
hardly in others, picked greedily until they cover the toxic texts. It is fitted on a bounded sample
(TOXIC_ROWS and CLEAN_ROWS labelled texts, whole), whose words are counted and tagged by the executors: the
driver sees entries of the lexicon that are in question, the toxic texts that hold them, and a row of numbers
for each text. Scoring covers every text in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import LOWER, U, chunks, forget, prefix_hash, small_batches, span_hash, text_bytes, written

#: The labelled texts that the model is fitted on at most.
TOXIC_ROWS, CLEAN_ROWS = 3000, 9000
#: Score from which a text is toxic.
TOXIC = 0.3
STEMS = (4, 5, 6)
#: Toxic texts that an entry of the lexicon must be the first to cover.
LEAST_GAIN = 3
#: Toxic texts that must have a word or stem for it to be looked at.
LEAST_SEEN = 4
#: Clean texts for each toxic one that may have it, both kinds being equally many.
RARE = 0.02
TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORD = re.compile(r"[a-z\u0080-\U0010ffff]+")
#: Bytes between words: all of ASCII but lower-case letters (upper case is lowered before).
BREAK = np.ones(256, bool)
BREAK[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True

# Words of the grammar.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb imbecile vermin bastard".split()
THREATS = "kill hurt destroy beat murder burn stab shoot strangle punch smash".split()
TARGETS = "you your yours they them their he she him her these those people this that du ihr sie tu vous ils usted ustedes ellos".split()
NEGATIONS = "not no never neither nor without isn aren wasn don doesn didn nicht kein keine nie pas jamais sin nunca".split()
REPORTS = "said says say called wrote claimed quoted quote told heard reported according sagte schrieb dit dijo".split()


#: I insult, K threat, T target, N negation, R report, Q quotation mark, o other; J and L: insult or threat with a
#: target, k: threat without one, i: negated, q: reported.
SYMBOLS = "oTNRQIKJLkiq"
#: Words between a target, or a negation, and what it bears on: fewer than these.
REACH, NEGATES = 3, 2
Step = Callable[[int, str], tuple[int, str, float]]


def target_step(state: int, symbol: str) -> tuple[int, str, float]:
    """A target near what comes next makes it a targeted one; the state counts down from it."""
    if symbol == "T":
        return REACH, symbol, 1.0
    if symbol == "Q":
        return state, symbol, 1.0
    after = max(0, state - 1)
    if state and symbol in "IK":
        return after, {"I": "J", "K": "L"}[symbol], 1.5 if symbol == "I" else 1.0
    return after, symbol, 1.0


def aimless_step(state: int, symbol: str) -> tuple[int, str, float]:
    """A threat that no target stood by is weak."""
    return (0, "k", 0.3) if symbol == "K" else (0, symbol, 1.0)


def negation_step(state: int, symbol: str) -> tuple[int, str, float]:
    """A negation shortly before weakens a match."""
    if symbol == "N":
        return NEGATES, symbol, 1.0
    if symbol == "Q":
        return state, symbol, 1.0
    if state and symbol in "IKJLk":
        return max(0, state - 1), "i", 0.5
    return max(0, state - 1), symbol, 1.0


def report_step(state: int, symbol: str) -> tuple[int, str, float]:
    """A report (bit 0) lasts to the clause's end, a quotation (bit 1) to its closing mark; both weaken what they hold."""
    if symbol == "R":
        return state | 1, symbol, 1.0
    if symbol == "Q":
        return state ^ 2, symbol, 1.0
    return (state, "q", 0.5) if state and symbol in "IKJLki" else (state, symbol, 1.0)


class Transducer:
    """A deterministic weighted transducer over SYMBOLS, as tables by (state, symbol): next state, symbol out, factor."""

    def __init__(self, *steps: Step):
        """The composition of steps, each reading what the one before has written; its states are those that can be reached from all zero."""
        number, todo, rows = {(0,) * len(steps): 0}, [(0,) * len(steps)], []
        for at in todo:
            row = []
            for symbol in SYMBOLS:
                after, put, factor = [], symbol, 1.0
                for step, state in zip(steps, at):
                    state, put, f = step(state, put)
                    after.append(state)
                    factor *= f
                if tuple(after) not in number:
                    number[tuple(after)] = len(number)
                    todo.append(tuple(after))
                row.append((number[tuple(after)], SYMBOLS.index(put), factor))
            rows.append(row)
        self.rows = rows

    def run(self, symbols: list[int], weights: list[float]) -> tuple[list[int], list[float]]:
        state, out, got, rows = 0, [], [], self.rows
        for s, w in zip(symbols, weights):
            state, put, factor = rows[state][s]
            out.append(put)
            got.append(w * factor)
        return out, got


BACKWARD = Transducer(target_step)
FORWARD = Transducer(target_step, aimless_step, negation_step, report_step)
FEATURES = ("plain", "targeted", "threat", "weakened", "clauses", "heaviest")
#: The feature that a symbol's weight goes to.
FEATURE_OF = {SYMBOLS.index(s): f for s, f in zip("IJLkiq", (0, 1, 2, 3, 3, 3))}


def clause_matches(symbols: list[int], weights: list[float]) -> tuple[list[int], list[float]]:
    """What both transducers make of one clause's symbols (places in SYMBOLS)."""
    symbols, weights = BACKWARD.run(symbols[::-1], weights[::-1])
    return FORWARD.run(symbols[::-1], weights[::-1])


def quotation_marks(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that are part of a quotation mark, and the places of those marks that have a partner on their line."""
    n = len(low)
    padded = np.concatenate([low, np.zeros(2, np.uint8)])
    two, three = padded[1 : n + 1], padded[2:]
    wide = (low == 0xE2) & (two == 0x80) & (three >= 0x9C) & (three <= 0x9F)
    angle = (low == 0xC2) & ((two == 0xAB) | (two == 0xBB))
    mark = (low == 0x22) | wide | angle
    part = mark.copy()
    part[1:] |= wide[:-1] | angle[:-1]
    part[2:] |= wide[:-2]
    return part, np.flatnonzero(mark)


class Grammar:
    """Tags words by hash: the lexicon's stems by the hash of a word's first bytes, other words by that of the whole."""

    def __init__(self, lexicon: dict[str, float], model: list[float] | None = None):
        self.lexicon, self.model = lexicon, model
        self.stems: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, dict[str, float]] = {}
        whole: dict[str, float] = {}
        for k, w in lexicon.items():
            if k.endswith("$"):
                whole[k[:-1]] = w
            else:
                by_size.setdefault(len(k.encode()), {})[k] = w
        for size, stems in by_size.items():
            self.stems[size] = self._table(stems)
        self.whole = self._table(whole)
        kinds = {w: SYMBOLS.index(s) for s, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("K", THREATS)) for w in ws}
        self.kinds = self._table(kinds)

    @staticmethod
    def _table(ws: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        hashes = []
        for w in ws:
            data = np.frombuffer(w.encode(), np.uint8)
            hashes.append(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])
        hashes, weights = np.array(hashes, U), np.array(list(ws.values()), float)
        by = np.argsort(hashes)
        return hashes[by], weights[by]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The weight of each hash in the table; 0 if it isn't there."""
        if not len(table[0]):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return np.where(table[0][at] == hashes, table[1][at], 0.0)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of FEATURES for each text."""
        low = LOWER[data]
        out = np.zeros((len(offsets) - 1, len(FEATURES)))
        part, marks = quotation_marks(low)
        inside = ~BREAK[low] & ~part
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        stop[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if not len(starts):
            return out
        prefix = prefix_hash(low)
        size = ends - starts
        insult = np.zeros(len(starts))
        for n, table in self.stems.items():
            long = np.flatnonzero(size >= n)
            insult[long] = np.maximum(insult[long], self._find(table, span_hash(prefix, starts[long], starts[long] + n)))
        full = span_hash(prefix, starts, ends)
        insult = np.maximum(insult, self._find(self.whole, full))
        kind = self._find(self.kinds, full).astype(np.int64)
        kind[insult > 0] = SYMBOLS.index("I")
        text = np.searchsorted(offsets, starts, "right") - 1
        # clauses: runs of words of one text without an end mark between them
        ends_before = np.concatenate([[0], np.cumsum(CLAUSE_END[low])])
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (ends_before[starts[1:]] > ends_before[ends[:-1]]) | (text[1:] != text[:-1])
        first = np.append(np.flatnonzero(fresh), len(starts))
        hits = np.flatnonzero((insult > 0) | (kind == SYMBOLS.index("K")))
        if not len(hits):
            return out
        quoted = self._quoted(low, offsets, marks, starts)
        mark = SYMBOLS.index("Q")
        for c in np.unique(np.searchsorted(first, hits, "right") - 1).tolist():
            a, b = int(first[c]), int(first[c + 1])
            symbols, weights = kind[a:b].tolist(), np.where(insult[a:b] > 0, insult[a:b], 1.0).tolist()
            if marks.size:
                within = quoted[a:b]
                at = np.flatnonzero(np.diff(within.astype(np.int8), prepend=0)).tolist()
                for i in reversed(at):
                    symbols.insert(i, mark)
                    weights.insert(i, 1.0)
            row, total = out[text[a]], 0.0
            for s, w in zip(*clause_matches(symbols, weights)):
                if s in FEATURE_OF:
                    row[FEATURE_OF[s]] += w
                    total += w
            row[4] += total > 0
            row[5] = max(row[5], total)
        return np.log1p(out)

    @staticmethod
    def _quoted(low: np.ndarray, offsets: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether each word stands within a quotation: an odd number of marks with a partner on their line before it."""
        lines = np.cumsum(low == 10)[marks] + np.searchsorted(offsets, marks, "right") * (len(low) + 1)
        _, begin, many = np.unique(lines, return_index=True, return_counts=True)
        alone = (begin + many - 1)[many % 2 == 1]
        return np.searchsorted(np.delete(marks, alone), starts) % 2 == 1

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.features(data, offsets)
        return 1 / (1 + np.exp(-np.clip(self.model[0] + x @ np.array(self.model[1:]), -30, 30)))


# ---------------------------------------------------------------- learning
def _keys(text: str) -> set[str]:
    """Whole words (marked at their end) and stems of a text."""
    out = set()
    for w in set(WORD.findall(text.translate(TO_LOWER))):
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:n] for n in STEMS if len(w) >= n)
    return out


def _wanted(bad: int, good: int, rate: float) -> bool:
    return bad >= LEAST_SEEN and good <= RARE * bad * rate


def pick(seen: dict[str, tuple[int, int]], pairs: np.ndarray, rate: float) -> dict[str, float]:
    """The lexicon, greedily, with each entry's weight.

    seen: (toxic, clean) texts of each candidate, in the order of its numbers; pairs: rows (candidate, toxic
    text); rate: clean texts for each toxic one.
    """
    names = list(seen)
    # of equally good ones a whole word, then the longest stem: no wider than the labels ask for
    by = np.array(sorted(range(len(names)), key=lambda i: (not names[i].endswith("$"), -len(names[i]), names[i])), np.int64)
    place = np.empty(len(names), np.int64)
    place[by] = np.arange(len(names))
    entry, text = place[pairs[:, 0]], pairs[:, 1]
    cost = np.array([3.0 * seen[names[i]][1] for i in by])
    lexicon, covered = {}, np.zeros(int(text.max(initial=-1)) + 1, bool)
    while len(entry):
        gain = np.bincount(entry[~covered[text]], minlength=len(names)) - cost
        best = int(gain.argmax())
        if gain[best] < LEAST_GAIN:
            break
        k = names[by[best]]
        lexicon[k] = _weight(*seen[k], rate)
        covered[text[entry == best]] = True
        more = gain[entry] >= LEAST_GAIN
        entry, text = entry[more], text[more]
    return lexicon


def _weight(bad: int, good: int, rate: float) -> float:
    return round(min(6.0, math.log((bad + 0.5) / (good / rate + 0.5))), 4)


def with_known(lexicon: dict[str, float], counts: dict[str, tuple[int, int]], rate: float) -> dict[str, float]:
    """Adds the known insults that the labels don't speak against."""
    for w in (w + "$" for w in INSULTS):
        bad, good = counts.get(w, (0, 0))
        if w not in lexicon and good <= RARE * bad * rate:
            lexicon[w] = _weight(bad, good, rate) if bad else 2.0
    return lexicon


def unlearned() -> Grammar:
    """What stands without labels of both kinds: the fixed words alone."""
    return Grammar({w + "$": 3.0 for w in INSULTS}, [-3.0, 1.5, 1.0, 1.0, 0.5, 0.5, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> list[float]:
    """Damped Newton steps with a ridge on all but the intercept; the other weights stay at 0 or above, and a step that doesn't help is halved."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        for _ in range(30):
            new = w + step
            new[1:] = np.maximum(new[1:], 0)
            if loss(new) <= now:
                break
            step = step / 2
        else:
            break
        gained, w, now = now - loss(new), new, loss(new)
        if gained < 1e-9:
            break
    return [float(v) for v in w]


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from: crc32 of the doc_id's digits leaves 2 modulo 4. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean texts of each word and stem, batch by batch."""
    for batch in batches:
        for part in chunks(batch, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                seen[toxic].update(_keys(text))
            names = [*seen[0], *seen[1]]
            many = [[*seen[0].values(), *[0] * len(seen[1])], [*[0] * len(seen[0]), *seen[1].values()]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(many[1], pa.int64()), pa.array(many[0], pa.int64())], names=["key", "bad", "good"])


def _held(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(shared.value)}
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(number[k], d) for d, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist()) for k in _keys(text) & number.keys()]
                entry, doc = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(doc, pa.int64())], names=["entry", "doc"])

    return run


def _rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = grammar.features(*text_bytes(part.column(2)))
                cols = [pa.array(x[:, i]) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "toxic", *FEATURES])

    return run


def learn(drawn: DataFrame) -> Grammar:
    """Fits lexicon and logistic model to (doc_id, toxic int, text), a bounded number of rows. Without both kinds the fixed words stand alone."""
    spark = drawn.sparkSession
    small_batches(spark)
    drawn = written(drawn.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")), "drawn")
    many = {r.toxic: r.n for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(many) < 2:
        return unlearned()
    rate = many[0] / many[1]
    counts = drawn.mapInArrow(_counted, "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    known = F.col("key").isin([w + "$" for w in INSULTS])
    counts = counts.where(known | ((F.col("bad") >= LEAST_SEEN) & (F.col("good") <= F.lit(RARE * rate) * F.col("bad"))))
    # grows with the distinct words of the drawn texts alone, of which few are rare in clean ones
    got = {r.key: (r.bad, r.good) for r in counts.orderBy("key").collect()}
    seen = {k: v for k, v in got.items() if _wanted(*v, rate)}
    shared = spark.sparkContext.broadcast(list(seen))
    held = drawn.where("toxic = 1").mapInArrow(_held(shared), "entry int, doc long").toArrow()
    _, text = np.unique(held.column(1).to_numpy(), return_inverse=True)
    pairs = np.stack([held.column(0).to_numpy().astype(np.int64), text], axis=1) if held.num_rows else np.zeros((0, 2), np.int64)
    grammar = Grammar(with_known(pick(seen, pairs, rate), got, rate))
    schema = ", ".join(["doc_id long, toxic int", *(f"{f} double" for f in FEATURES)])
    rows = drawn.mapInArrow(_rows(grammar), schema).orderBy("doc_id").toArrow()
    shared.unpersist()
    forget(drawn)
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES])
    grammar.model = logistic(x, rows.column("toxic").to_numpy().astype(float))
    return grammar


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learns from the labelled documents that aren't held out, a bounded number of either kind, drawn by a hash of their ids."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    drawn = draw[0].unionByName(draw[1])
    # at most TOXIC_ROWS + CLEAN_ROWS pairs of numbers: a broadcast of a fixed size
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    return learn(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text; more columns are ignored).

    Null and empty texts score as a text without matches; null doc_ids and rows that repeat come through; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                got = grammar.scores(*text_bytes(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got), pa.array((got >= TOXIC).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score as toxic; labels are learned from, never looked up. All columns stay as they are."""
    small_batches(docs.sparkSession)
    grammar, names = fit(docs, labels), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, f"_{at}"):
                yield part.filter(pa.array(grammar.scores(*text_bytes(part.column(at))) < TOXIC))

    # other names on the way, as columns may share one
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
