"""Repair of conversations' structure: the cheapest edits that make roles alternate, as a fold over sorted turns.

Windows flag each row's first fault: blank, duplicate (role and text seen earlier in the conversation) or
truncated (no end mark at its end). The conversation's rows are then collected in order and folded by
aggregate(). The fold carries four (cost, audit) structs, the cheapest edits that leave the roles so far
empty, at a system turn, at a user turn, or at an assistant turn; each step takes the least of what may
come next, so ties go to the ASCII-least audit. Of two audits of one cost and state neither begins the
other (more inserts cost more), so the least stays the least whatever follows.

Long conversations are folded in blocks, each from all four states, and the blocks' results are joined by
a second fold: an audit is then copied once a block, not once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits; an undeleted truncated row costs CUT more.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Rows that are folded before their audits are joined.
BLOCK = 256
#: Cost of a state that can't be reached.
_NEVER = 1 << 40
_BLANK = "[^\\x20\\x09-\\x0D]"
_STATES = ("none", "system", "user", "assistant")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults planted by crc32('conv_id:turn') mod 20.

    0 drops the row, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 sets its role to user. Nulls
    count as one space in the key, the role and the text; conv_id and turn themselves stay null. A conversation
    keeps a row with `there` false for each row dropped, so that none is lost.
    """
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn"))) % 20
    rows = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") == 0, "").otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").when(F.col("kind") == 0, "").otherwise(F.col("role")),
        "there": F.col("kind") != 0,
        "again": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.drop("kind", "again")


def flagged(rows: DataFrame) -> DataFrame:
    """Adds to rows (conv_id, turn, role, text, there) each row's initial, its first fault and whether its pair with the row before is illegal.

    Rows go by turn, nulls first, then role and text. All windows keep within a conversation, by which rows are dealt once.
    """
    rows = rows.repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("conv_id", "there").orderBy(*order)
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("initial", F.substring("role", 1, 1))
    rows = rows.withColumn("pair", F.concat(F.lag("initial").over(within), F.col("initial")))
    rows = rows.withColumn("nth", F.row_number().over(same))
    last = F.element_at(F.regexp_extract_all(F.col("text"), F.lit(f"({_BLANK})[\\x20\\x09-\\x0D]*$"), 1), 1)
    fault = (
        F.when(~F.col("text").rlike(_BLANK), "blank").when(F.col("nth") > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    return rows.withColumns({"fault": fault, "illegal": F.col("there") & ~F.coalesce(F.col("pair"), F.lit("su")).isin("su", "ua", "au")})


def _option(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _add(state: Column, cost: Column | int, edit: str | Column) -> Column:
    edit = F.lit(edit) if isinstance(edit, str) else edit
    return _option(state["cost"] + (F.lit(cost) if isinstance(cost, int) else cost), F.concat(state["audit"], edit))


def _state(*options: Column) -> Column:
    return F.struct(*[o.alias(n) for o, n in zip(options, _STATES)])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _with_inserts(state: Column) -> Column:
    """The four states when empty turns may be inserted: a user turn after anything but a user turn, then an assistant's."""
    user = lambda s: F.least(s["user"], *[_add(s[n], INSERT, "I") for n in ("none", "system", "assistant")])
    return _let(state, lambda s: _let(user(s), lambda u: _state(s["none"], s["system"], u, F.least(s["assistant"], _add(u, INSERT, "I")))))


def _start(at: str) -> Column:
    return _with_inserts(_state(*[_option(F.lit(0 if n == at else _NEVER), F.lit("")) for n in _STATES]))


def _step(state: Column, row: Column) -> Column:
    """One row is kept, given another role or deleted; then come inserts."""
    must_go = row["fault"].isin("blank", "duplicate")
    cut = F.when(row["fault"] == "truncated", CUT).otherwise(0)
    never = _option(F.lit(_NEVER), F.lit(""))

    def stays(before: Column, initial: str) -> Column:
        """Kept if its role is the one wanted, else given that role."""
        is_it = row["initial"] == initial
        return _add(before, cut + F.when(is_it, 0).otherwise(REROLE), F.when(is_it, "K").otherwise("R"))

    gone = {n: _add(state[n], DELETE, "D") for n in _STATES}
    user = F.least(gone["user"], *[stays(state[n], "u") for n in ("none", "system", "assistant")])
    return _with_inserts(_state(
        gone["none"],
        F.when(~must_go & (row["initial"] == "s"), F.least(gone["system"], _add(state["none"], cut, "K"))).otherwise(gone["system"]),
        F.when(must_go, gone["user"]).otherwise(user),
        F.least(gone["assistant"], F.when(must_go, never).otherwise(stays(state["user"], "a"))),
    ))


def _join(state: Column, block: Column) -> Column:
    """state, then a block's edits; block is an array of results, one for each state that it may start from."""

    def to(n: str) -> Column:
        return F.least(*[_add(state[m], block[i][n]["cost"], block[i][n]["audit"]) for i, m in enumerate(_STATES)])

    return _state(*[to(n) for n in _STATES])


def cheapest(rows: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array, not empty, of structs (initial, fault): the ASCII-least audit of those of least cost.

    Roles must come to nothing, or to an optional system turn and one or more pairs of user and assistant.
    """
    starts = F.array(*[_start(n) for n in _STATES])
    blocks = F.transform(
        F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK)),
        lambda at: F.transform(F.when(at == 1, F.slice(starts, 1, 1)).otherwise(starts), lambda start: F.aggregate(F.slice(rows, at, BLOCK), start, _step)),
    )
    return _let(blocks, lambda b: _let(F.aggregate(F.slice(b, 2, F.size(b)), b[0][0], _join), lambda s: F.least(s["none"], s["assistant"])))


def repaired_turns(rows: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit makes of an array of structs (role, text, initial, ...).

    Whatever stays alternates user and assistant after a system turn that is kept, so a turn's place gives its role.
    """
    edits = F.transform(F.filter(F.split(audit, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("at"), c.alias("edit")))
    blank = lambda e: F.struct(e["at"].alias("at"), e["edit"].alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))
    own = F.zip_with(
        F.filter(edits, lambda e: e["edit"] != "I"), rows,
        lambda e, r: F.struct(e["at"].alias("at"), e["edit"].alias("edit"), r["role"].alias("role"), r["text"].alias("text")),
    )
    inserted = F.transform(F.filter(edits, lambda e: e["edit"] == "I"), blank)
    stay = F.filter(F.array_sort(F.concat(own, inserted)), lambda x: x["edit"] != "D")
    begins = F.coalesce((F.try_element_at(stay, F.lit(1))["edit"] == "K") & (F.substring(F.try_element_at(stay, F.lit(1))["role"], 1, 1) == "s"), F.lit(False))

    def turn(x: Column, i: Column) -> Column:
        role = F.when((i + F.when(begins, 1).otherwise(0)) % 2 == 0, "user").otherwise("assistant")
        return F.struct(F.when(x["edit"] == "K", x["role"]).otherwise(role).alias("role"), x["text"].alias("text"))

    return F.transform(stay, turn)


def repair(rows: DataFrame) -> DataFrame:
    """Repairs conversations of rows (conv_id, turn, role, text, there), `there` false for rows that only keep a conversation in the result.

    Returns per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, turns (the
    repaired ones, array of role and text). Null conv_ids are one conversation; null turns come first; rows that
    repeat are rows of their own, all but the first duplicates; a conversation without rows has zeros, an empty
    audit and no turns; an empty table gives no rows. A conversation is one row of the result, so its rows meet in
    one task: memory there is that of one conversation, however many there are.
    """
    rows = flagged(rows)
    turn = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "role", "text", "nth", "initial", F.coalesce("fault", F.lit("")).alias("fault"), "illegal")
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("there"), turn))).alias("rows"))
    dated = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    count = lambda f: F.size(F.filter("rows", f)).cast("long")
    faulty = lambda kind: count(lambda r: r["fault"] == kind)
    by = by.withColumn("best", F.when(F.size("rows") > 0, cheapest(F.transform("rows", lambda r: F.struct(r["initial"].alias("initial"), r["fault"].alias("fault"))))).otherwise(_option(F.lit(0), F.lit(""))))
    return by.select(
        "conv_id",
        F.coalesce(F.array_max(dated) - F.array_min(dated) + 1 - F.size(F.array_distinct(dated)), F.lit(0)).cast("long").alias("gaps"),
        *[faulty(k).alias(k) for k in ("blank", "duplicate", "truncated")],
        count(lambda r: r["illegal"]).alias("illegal"),
        F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit"),
        repaired_turns(F.col("rows"), F.col("best.audit")).alias("turns"),
    )


def as_there(conversations: DataFrame) -> DataFrame:
    """Rows of a conversations table as `repair` takes them: null roles and texts are one space."""
    return conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(True).alias("there"))


def digest(repaired: DataFrame) -> DataFrame:
    """The columns of a repair with the repaired turns as one hash."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")
