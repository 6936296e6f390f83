"""Repair and formatting of conversations: against brute force, over odd rows, and in blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from auditmill.llm import chat, repair

SCHEMA = "conv_id long, turn long, role string, text string"
#: Names that the operators use within.
CLASHING = ("1 as nth", "'x' as piece", "2 as fault", "true as there", "'y' as turns", "3 as record", "null as rows", "4 as kind")


def faults(rows):
    """Each row's first fault, read plainly."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """The cheapest edits by trying all: inserts of up to two turns in every gap."""
    gaps, found = ["", "u", "a", "ua", "au"], (10**9, "", ())
    for fillers in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("KUAD", repeat=len(rows)):
            cost, audit, turns = 2 * len(fillers[0]), "I" * len(fillers[0]), [(x, "") for x in fillers[0]]
            for (role, text), fault, edit, filler in zip(rows, faults(rows), edits, fillers[1:]):
                if edit != "D" and fault in ("blank", "duplicate"):
                    break
                cost += {"K": 0, "D": 3}.get(edit, 2) + (edit != "D" and fault == "truncated") + 2 * len(filler)
                audit += ("R" if edit in "UA" else edit) + "I" * len(filler)
                turns += [(role if edit == "K" else edit.lower(), text)] * (edit != "D") + [(x, "") for x in filler]
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (cost, audit) < found[:2]:
                    found = (cost, audit, tuple(turns))
    names = {"u": "user", "a": "assistant"}
    return found[0], found[1], "\n".join(f"{names.get(r, r)}:{t}" for r, t in found[2])


def random_rows(rng, n):
    texts = ["", " \t", "Fine.", "Yes!", "cut off", "Why? ", "é…"]
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(n)]


def repaired(spark, conversations):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    return {r.conv_id: r for r in repair.digest(repair.repair(repair.as_there(spark.createDataFrame(rows, SCHEMA)))).collect()}


def test_repair_by_brute_force(spark):
    rng = random.Random(5)
    conversations = {c: random_rows(rng, 1 + c % 3) for c in range(150)}
    got = repaired(spark, conversations)
    for c, rows in conversations.items():
        cost, audit, whole = best(rows)
        f, pairs = faults(rows), ["".join(x[0][:1] for x in p) for p in zip(rows, rows[1:])]
        want = (cost, audit, hashlib.sha256(whole.encode()).hexdigest(), f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs))
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256, got[c].blank, got[c].duplicate, got[c].truncated, got[c].illegal) == want, rows


def test_repair_in_blocks(spark, monkeypatch):
    """Blocks of any length give the same edits as one fold."""
    rng = random.Random(6)
    conversations = {c: random_rows(rng, rng.choice([5, 17, 40])) for c in range(25)}
    whole = repaired(spark, conversations)
    monkeypatch.setattr(repair, "BLOCK", 4)
    assert repaired(spark, conversations) == whole


def test_repair_odd_rows(spark):
    rows = [
        (1, 3, "user", "Hello."), (1, None, "system", "Be kind."), (1, 5, "assistant", None), (1, 5, "assistant", "Hm."),
        (None, None, None, None), (None, 2, None, "x."), (2, None, "user", "a."), (3, 9, "user", "Same."), (3, 9, "user", "Same."),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in repair.repair(repair.as_there(df.selectExpr("*", *CLASHING))).collect()}
    assert (got[1].gaps, got[1].blank, got[1].audit, got[1].cost) == (1, 1, "KKDK", 3) and [t.role for t in got[1].turns] == ["system", "user", "assistant"]
    assert (got[None].gaps, got[None].blank, got[None].illegal, got[None].audit) == (0, 1, 1, "DD")  # deleting costs 3, a new role and an answer 4
    assert (got[2].gaps, got[2].cost, got[2].audit) == (0, 2, "KI") and got[2].turns[1].asDict() == {"role": "assistant", "text": ""}
    assert (got[3].gaps, got[3].duplicate, got[3].audit, got[3].cost) == (0, 1, "KDI", 5)
    assert repair.digest(repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text. {c} {t}?") for c in range(40) for t in range(5)] + [(None, None, None, None), (-1, 0, "system", "x")]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.there))
    kinds = set()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [("", "", False)], 1: [(role, "", True)], 2: [(role, re.sub("[.!?]", "", text), True)], 3: [(role, text, True)] * 2, 4: [("user", text, True)]}
        assert got[c, t] == want.get(kind, [(role, text, True)])
        kinds.add(kind)
    assert kinds >= {0, 1, 2, 3, 4}
    # a conversation that lost all rows stays
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.digest(repair.repair(repair.damaged(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)))).first()
    assert tuple(got)[:8] == (lost, 0, 0, 0, 0, 0, 0, "") and got.repaired_sha256 == hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- formatting
NASTY = ["", "\\", "\\\\", "\\h", "\\\\h", "#", "###", "####", "#####x", "</turn>", "</turn>\n", "<</turn>", "\\### Assistant: </turn> ok", "### user: hi</turn>\n", "a\u2028b", "é😀 ##", ": : :", "\n", "\\l/turn>", "\x00\x1f", "\\c"]
ROLES = ["user", "assistant", "system", "tool: x", "###", "\\c", "", "human", "gpt"]


def nasty(rng, n):
    return [(c, t, rng.choice(ROLES if c % 2 else ROLES[:3]), "".join(rng.choices(NASTY, k=rng.randrange(4)))) for c in range(n) for t in range(rng.randrange(1, 40) if c % 5 == 0 else rng.randrange(1, 5))]


def check_digest(rows, got):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        turns = [x[2:] for x in sorted(by[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss)), turns


@pytest.mark.parametrize("chars", [chat.JSON_CHARS, 6])
def test_round_trip(spark, monkeypatch, chars):
    """With few characters a record, most rows stay typed: the way back is the same."""
    monkeypatch.setattr(chat, "JSON_CHARS", chars)
    rows = nasty(random.Random(chars), 60) + [(None, None, None, None), (None, 1, "assistant", "x"), (77, 1, "user", "same"), (77, 1, "user", "same")]
    pieces = chat.format_table(spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASHING))
    check_digest(rows, chat.digest(pieces).collect())
    used = {r.layout for r in pieces.select("layout").distinct().collect()}
    assert None not in used and used >= ({"role-text", "messages"} if chars == 6 else {"messages", "from-value"})
    assert chat.digest(chat.format_table(spark.createDataFrame([], SCHEMA))).collect() == []


def test_mask_covers_answers_alone(spark):
    row = chat.formatted(spark.createDataFrame([([("user", "a: #"), ("assistant", "###</turn>"), ("assistant", "")],)], "turns array<struct<role:string,text:string>>")).first()
    assert row.formatted == "### user: a: #</turn>\n### assistant: \\h##\\l/turn></turn>\n### assistant: </turn>\n"
    assert [row.formatted[m.start : m.start + m.length] for m in row.loss_mask] == ["\\h##\\l/turn>", ""]
    assert len(re.findall("###", row.formatted)) == 3  # no mark within a text


RECORDS = {
    "messages": ('{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "extra": [1]}]}', [("user", "q"), ("assistant", "a")]),
    "parts": ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"text": "y"}]}]}', [("user", "x\ny")]),
    "from-value": ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}]}', [("user", "q"), ("assistant", "")]),
    "role-text": ('{"turns": [{"role": "tool", "text": "7"}], "meta": {"a b:c": 1.5, "w`x": []}}', [("tool", "7")]),
    "instruction": ('{"instruction": "do", "input": "this", "output": "done"}', [("user", "do\n\nthis"), ("assistant", "done")]),
    "instruction-response": ('{"instruction": "do", "context": "", "response": "done", "category": "x"}', [("user", "do"), ("assistant", "done")]),
    "completion": ('{"prompt": "p", "completion": "c", "system": "s"}', [("system", "s"), ("user", "p"), ("assistant", "c")]),
    "prompt-response": ('{"prompt": "p", "response": "c"}', [("user", "p"), ("assistant", "c")]),
    "question": ('{"question": "q", "answer": "a", "context": "c"}', [("user", "c\n\nq"), ("assistant", "a")]),
}
UNKNOWN = ['{"text": "no turns"}', "[1, 2]", "not json", None, "null", '"x"', "{}", '{"messages": []}', '{"a": 1, "a": 2}', '{"messages": [["user", "q"]]}']


def test_layouts(spark):
    rows = [(n, j) for n, (j, _) in RECORDS.items()] + [(f"unknown {i}", j) for i, j in enumerate(UNKNOWN)]
    got = {r.name: r for r in chat.canonical(spark.createDataFrame(rows, "name string, record string").selectExpr("*", "1 as layouts", "2 as value"), "record").collect()}
    for name, (_, turns) in RECORDS.items():
        assert got[name].layout == name and [tuple(t) for t in got[name].turns] == turns
    for i in range(len(UNKNOWN)):
        assert got[f"unknown {i}"].layout is None and got[f"unknown {i}"].turns is None


def test_paths_and_fingerprints(spark):
    """A value's paths are those of its own shape; the order of fields doesn't matter, an added field does."""
    texts = ['{"b": [{"y": 1, "x": "s"}], "a": {"c": [[true]]}}', '{"a": {"c": [[false]]}, "b": [{"x": "t"}, {"y": 2}]}', '{"a": {"c": [[true]]}, "b": [{"x": "s", "y": 1}], "z": null}', '{"a b": {"c:d": 1.25, "e>f": "OBJECT<"}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chat.value_paths(F.parse_json("t")).alias("p"))
    got = [r for r in df.withColumn("f", chat.fingerprint(F.col("p"))).orderBy("i").collect()]
    assert got[0].p == got[1].p == ["a.c[][]", "b[].x", "b[].y"] and got[2].p == ["a.c[][]", "b[].x", "b[].y", "z"] and got[3].p == ["`a b`.`c:d`", "`a b`.`e>f`"]
    assert got[0].f == got[1].f != got[2].f


def test_typed_tables(spark):
    df = spark.createDataFrame([("s", "p", "r"), (None, "p", None)], "system string, prompt string, response string")
    got = chat.canonical_table(df).collect()
    assert [[tuple(t) for t in r.turns] for r in got] == [[("system", "s"), ("user", "p"), ("assistant", "r")], [("user", "p"), ("assistant", "")]] and got[0].fingerprint == got[1].fingerprint
    df = spark.createDataFrame([([("user", [("x",), (None,)])],), (None,)], "messages array<struct<role:string,content:array<struct<text:string>>>>")
    got = chat.canonical_table(df).collect()
    assert [tuple(t) for t in got[0].turns] == [("user", "x\n")] and got[1].turns is None and got[0].layout == "parts"
    with pytest.raises(ValueError, match="a, b"):
        chat.canonical_table(spark.createDataFrame([(1, 2)], "a int, b int"))
