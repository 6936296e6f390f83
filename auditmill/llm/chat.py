"""Chat formatting: records of many layouts become canonical turns, and turns become marked text, with DataFrame functions alone.

A record's nested field paths (`messages[].role`, `prompt`) are hashed; a layout is a declarative mapping that
asks for some paths, and the first layout whose hashed paths a record has converts it. The hash of all its
paths is the record's fingerprint, by which unknown shapes can be counted. Paths come from a table's schema
(once, for typed columns) or from the value itself (for JSON, where each record may have its own shape).

The template marks each turn as `### role: text</turn>` and a line end. Within roles and texts `\\`, the
first of three `#`, `<` of `</turn>` and (in roles) `:` become `\\\\`, `\\h`, `\\l` and `\\c`, so no marker can
stand in a text, and the way back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: Rows of a conversation that one record of `as_records` holds.
PIECE = 16
#: Code points of text in a JSON record; with more, rows stay typed (a variant holds 16 MB).
JSON_CHARS = 1 << 21
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
#: Other names of the three roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


# ---------------------------------------------------------------- layouts
@dataclass(frozen=True)
class Layout:
    """A mapping to turns: either a list with a role and a text in each item, or fixed turns out of single fields.

    needs: paths that a record must have. items: path of the list; role and text: paths within an item (text may be
    a list of parts with `text`). names: roles by other names. turns: (role, fields joined by an empty line).
    """

    name: str
    needs: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    names: dict[str, str] = field(default_factory=dict)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("parts", ("messages[].role", "messages[].content[].text"), "messages", "role", "content[].text"),
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("from-value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", ROLE_NAMES),
    Layout("role-text", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Layout("instruction", ("instruction", "output"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction-response", ("instruction", "response"), turns=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)))),
    Layout("completion", ("prompt", "completion"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), turns=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a type, lists as `[]`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value: Column) -> Column:
    """Sorted leaf paths of a variant, from its own schema: a fold over the schema's words with a stack of open paths.

    A name that needs quotes keeps them. Null without a value; empty for a value that is no object or list.
    """
    word = F.lit("(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\\([0-9,]*\\))?")
    words = F.regexp_extract_all(F.schema_of_variant(value), word, 0)
    strings = "cast(array() as array<string>)"
    start = F.struct(F.lit("").alias("at"), F.expr(strings).alias("open"), F.expr(strings).alias("paths"))
    top = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))

    def make(at: Column, opened: Column, paths: Column) -> Column:
        return F.struct(at.alias("at"), opened.alias("open"), paths.alias("paths"))

    def step(s: Column, w: Column) -> Column:
        name = F.substr(w, F.lit(1), F.length(w) - 2)
        into = F.concat(s["at"], F.lit("[]"))
        shut = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return (
            F.when(w.endswith(": "), make(F.when(top(s["open"]) == "", name).otherwise(F.concat(top(s["open"]), F.lit("."), name)), s["open"], s["paths"]))
            .when(w == "OBJECT<", make(s["at"], F.concat(s["open"], F.array(s["at"])), s["paths"]))
            .when(w == "ARRAY<", make(into, F.concat(s["open"], F.array(into)), s["paths"]))
            .when(w == ">", make(s["at"], shut, s["paths"]))
            .when(s["at"] == "", s)
            .otherwise(make(s["at"], s["open"], F.concat(s["paths"], F.array(s["at"]))))
        )

    return F.array_sort(F.array_distinct(F.aggregate(words, start, step, lambda s: s["paths"])))


def fingerprint(paths: Column) -> Column:
    """The hash of a record's paths; null without paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def choose(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the first layout whose hashed paths are all among a record's; null where none is."""
    hashed = F.transform(paths, lambda p: F.xxhash64(p))
    out = F.lit(None).cast("string")
    for layout in reversed(layouts):
        has = F.lit(True)
        for p in layout.needs:
            has = has & F.array_contains(hashed, F.xxhash64(F.lit(p)))
        out = F.when(has, layout.name).otherwise(out)
    return out


def _renamed(role: Column, names: dict[str, str]) -> Column:
    out = role
    for old, new in names.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def _turns(value: Column, layout: Layout, typed: bool) -> Column:
    """Turns of a record by a layout; value is a struct column (typed) or a variant."""
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.items:
        listed, _, part = layout.text.partition("[].")
        if typed:
            items = value[layout.items]
        else:
            kind = f"array<struct<{layout.role}:string,{listed}:{f'array<struct<{part}:string>>' if part else 'string'}>>"
            items = F.try_variant_get(value, f"$.{layout.items}", kind)
        text = lambda x: F.array_join(F.transform(x[listed], lambda y: F.coalesce(y[part].cast("string"), F.lit(""))), "\n") if part else x[listed].cast("string")
        return F.transform(items, lambda x: turn(_renamed(x[layout.role].cast("string"), layout.names), text(x)))
    made = []
    for role, paths in layout.turns:
        found = [value[p].cast("string") if typed else F.try_variant_get(value, f"$.{p}", "string") for p in paths]
        text = F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull() & (x != "")), "\n\n")
        # an optional turn (system) is there if its field is; the others always are
        made.append(F.when(found[0].isNotNull() if role == "system" else F.lit(True), turn(F.lit(role), text)))
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns (array of role, text) to records held as JSON in one column.

    Each record has its own shape. A record that is null, no JSON, larger than a variant (16 MB) or of no known
    layout keeps its row, with a null layout and null turns. Null roles and texts within a turn are empty; fields
    that a layout doesn't name are left out. An empty table stays one; other columns go through.
    """
    out = records.withColumn("_v", F.try_parse_json(F.col(record)))
    out = out.withColumn("_paths", value_paths(F.col("_v")))
    out = out.withColumns({"fingerprint": fingerprint(F.col("_paths")), "layout": choose(F.col("_paths"), layouts)})
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        turns = F.when(F.col("layout") == layout.name, _turns(F.col("_v"), layout, False)).otherwise(turns)
    return out.withColumn("turns", turns).drop("_v", "_paths")


def of_schema(kind: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Layout, Column]:
    """The layout of typed rows, and the fingerprint that all of them have. ValueError, with the paths, if none fits."""
    paths = sorted(set(schema_paths(kind)))
    layout = next((x for x in layouts if set(x.needs) <= set(paths)), None)
    if layout is None:
        raise ValueError(f"no layout for a table with the paths {', '.join(paths)}")
    return layout, fingerprint(F.array(*[F.lit(p) for p in paths]))


def canonical_table(table: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns to a table of typed columns, whose schema alone gives the paths: one fingerprint for all rows.

    A table of no known layout raises ValueError with its paths. Rows whose list is null have null turns.
    """
    layout, marked = of_schema(table.schema, layouts)
    held = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    for p in {p for _, ps in layout.turns for p in ps} - set(table.columns):
        held = held.withField(p, F.lit(None).cast("string"))
    return table.withColumns({"fingerprint": marked, "layout": F.lit(layout.name), "turns": _turns(held, layout, True)})


# ---------------------------------------------------------------- template
def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=##)", "\\\\h")
    out = F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    """What `escaped` was given: pairs of backslashes part the text, and between them each backslash begins one escape."""

    def plain(part: Column) -> Column:
        for mark, char in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(mark), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), plain), "\\")


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds formatted (string) and loss_mask (array of start and length, in code points of it) to rows with turns.

    The mask covers each text of loss_role, as it stands in the output, and nothing of the template. Rows with null
    turns get null; rows with no turns get an empty string and an empty mask.
    """
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(SEP)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"),
    ))
    rows = turns.withColumn("_parts", parts)
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("mask"))

    def step(s: Column, p: Column) -> Column:
        start, size = s["at"] + F.length(p["head"]), F.length(p["body"])
        return F.struct(
            (start + size + len(CLOSE)).alias("at"),
            F.when(p["loss"], F.concat(s["mask"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(s["mask"]).alias("mask"),
        )

    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return rows.withColumns({"formatted": text, "loss_mask": F.aggregate("_parts", state, step, lambda s: s["mask"])}).drop("_parts")


def read_back(rows: DataFrame) -> DataFrame:
    """Adds read_turns and loss_text to rows with formatted and loss_mask, from these two alone."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, SEP)
        return F.struct(
            unescaped(F.substr(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescaped(F.substr(piece, at + len(SEP))).alias("text"),
        )

    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    loss = F.transform("loss_mask", lambda m: unescaped(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    return rows.withColumns({"read_turns": F.transform(pieces, turn), "loss_text": F.array_join(loss, "")})


# ---------------------------------------------------------------- a table of turns
def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, record, typed): a table of single turns as records of up to PIECE turns, in the layouts that such data comes in.

    A pair is a prompt or an instruction with its answer, a pair after a system turn has that as a field, and all
    else is a list of messages, under either of two names. Longer conversations have several records, pieces in
    order. record is JSON, or null where the text is too long for that; typed then has the list of turns (else null).
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    rows = rows.withColumn("piece", F.expr(f"(nth - 1) div {PIECE}"))
    by = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text"))).alias("t"), F.sum(F.length("text") + F.length("role")).alias("chars"))
    t, roles, odd = F.col("t"), F.array_join(F.transform("t", lambda x: x["role"]), " "), F.pmod(F.xxhash64("conv_id", "piece"), F.lit(2)) == 1
    text = lambda i: t[i]["text"]
    # roles by other names only where none of the others has such a name
    known = F.forall(t, lambda x: x["role"].isin("system", "user", "assistant"))
    named = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(F.col("chars") > JSON_CHARS, F.lit(None).cast("string"))
        .when(roles == "user assistant", F.when(odd, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))).otherwise(F.to_json(F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output")))))
        .when(roles == "system user assistant", F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(odd & known, F.to_json(F.struct(F.transform(t, lambda x: F.struct(named(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"], x["text"].alias("content"))).alias("messages"))))
    )
    typed = F.struct(F.transform(t, lambda x: F.struct(x["role"], x["text"])).alias("turns"))
    return by.select("conv_id", "piece", record.alias("record"), F.when(F.col("chars") > JSON_CHARS, typed).alias("typed"))


def format_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, layout, fingerprint, formatted, loss_mask): a table of turns through its records' layouts, formatted piece by piece.

    Rows go by turn, nulls first, then role and text; rows that repeat are turns of their own; null roles and texts
    are empty; null conv_ids are one conversation. Pieces of a conversation, put together in order, are its text.
    """
    records = as_records(conversations)
    layout, marked = of_schema(records.schema["typed"].dataType)
    out = canonical(records, "record")
    long = F.col("record").isNull()
    out = out.withColumns({
        "layout": F.when(long, layout.name).otherwise(F.col("layout")),
        "fingerprint": F.when(long, marked).otherwise(F.col("fingerprint")),
        "turns": F.when(long, _turns(F.col("typed"), layout, True)).otherwise(F.col("turns")),
    })
    return formatted(out).select("conv_id", "piece", "layout", "fingerprint", "formatted", "loss_mask")


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces hold, read back from them."""
    back = read_back(pieces)
    text = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.struct("piece", text.alias("text"), "loss_text").alias("p"), F.size("read_turns").alias("n"), F.length("formatted").alias("chars"), "layout")
    by = back.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    whole = lambda f: F.array_join(F.transform("ps", lambda p: p[f]), "")
    return by.select(
        "conv_id", "n_turns", F.sha2(whole("text"), 256).alias("turns_sha256"), F.length(whole("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss_text"), 256).alias("loss_sha256"), "formatted_chars",
    )


def marked_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    says = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
