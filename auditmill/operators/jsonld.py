"""Structured data: types, required fields, offers, placeholders; quality gate for JSON-LD blocks.

Blocks are read as VARIANT and judged by column expressions (`with_findings`). Python walks (`validate`, `lint`)
see only blocks that VARIANT doesn't read (broken ones, repeated keys), that may hold marks of unfilled
templates at some depth, or that nest lists and graphs beyond three levels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from auditmill.shared import parts

# Types that no longer earn rich results, fields that types need, and marks of unfilled templates.
DEPRECATED = ("HowTo", "SpecialAnnouncement", "ClaimReview", "VehicleListing", "EstimatedSalary", "LearningVideo", "CourseInfo")
REQUIRED = {
    "Article": ("headline", "datePublished", "author", "image"), "NewsArticle": ("headline", "datePublished", "author", "image"), "BlogPosting": ("headline", "datePublished", "author", "image"),
    "Product": ("name", "image", "offers"), "BreadcrumbList": ("itemListElement",), "FAQPage": ("mainEntity",), "Organization": ("name", "url"), "LocalBusiness": ("name", "address", "telephone"),
    "Event": ("name", "startDate", "location"), "VideoObject": ("name", "thumbnailUrl", "uploadDate"), "Recipe": ("name", "image", "recipeIngredient"),
    "JobPosting": ("title", "datePosted", "hiringOrganization", "jobLocation"), "Course": ("name", "provider"), "Person": ("name",), "WebSite": ("name", "url"), "RealEstateListing": ("name", "url", "datePosted"),
}
PLACEHOLDERS = [re.compile(p, re.I) for p in (r"\[business name\]", r"\[your [^\]]+\]", r"replace[_-]", r"\btodo\b", r"\bfixme\b")]

_FINDING = pa.struct([("rule", pa.string()), ("severity", pa.string()), ("type", pa.string()), ("field", pa.string()), ("value", pa.string()), ("points", pa.int32())])


def required_fields(spark: SparkSession) -> DataFrame:
    """(type, field): one row for each field a type needs."""
    return spark.createDataFrame([(t, f) for t, fs in REQUIRED.items() for f in fs], "type string, field string")


def _types(item: dict) -> list[str]:
    t = item.get("@type")
    return [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []


def placeholders(value, path: str = "") -> list[tuple[str, str]]:
    """(innermost key, value) of texts that a template left unfilled, in order; at any depth."""
    found, open_ = [], [(path, value)]
    while open_:
        key, x = open_.pop()
        if isinstance(x, dict):
            open_ += x.items()
        elif isinstance(x, list):
            open_ += [(key, y) for y in x]
        elif isinstance(x, str) and any(p.search(x) for p in PLACEHOLDERS):
            found.append((key, x))
    return sorted(found)


def _objects(data, deep: bool) -> list[dict]:
    """Objects of a block: itself, a list's, a graph's. deep: through lists and graphs of any depth."""
    graph = data.get("@graph") if isinstance(data, dict) else None
    if not deep:
        own = [data] if isinstance(data, dict) and (not isinstance(graph, list) or "@type" in data) else []
        return own + [x for x in (data if isinstance(data, list) else graph if isinstance(graph, list) else []) if isinstance(x, dict)]
    out, open_ = [], [data]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            out.append(x)
            x = x.get("@graph")
        if isinstance(x, list):
            open_ += reversed(x)
    return out


def _read(raw: str | None):
    """A block's value; nesting beyond what the parser takes is invalid, as other faults are."""
    try:
        return json.loads(raw or "")
    except RecursionError:
        raise ValueError("nested too deep") from None


def validate(raw: str | None) -> list[dict]:
    """What is wrong with a block, with the points it costs."""
    row = lambda rule, severity, kind="", field="", value="", points=0: {"rule": rule, "severity": severity, "type": kind, "field": field, "value": value, "points": points}
    try:
        data = _read(raw)
    except ValueError:
        return [row("invalid-json", "error", points=30)]
    out = []
    for item in _objects(data, False):
        kinds = _types(item)
        if not kinds:
            out.append(row("missing-type", "warning"))
        for t in kinds:
            if t in DEPRECATED:
                out.append(row("deprecated", "warning", t, points=5))
            if t == "FAQPage":
                out.append(row("limited", "warning", t))
            out += [row("missing-field", "error", t, f, points=5) for f in REQUIRED.get(t, ()) if item.get(f) in (None, "")]
            if t == "Product" and item.get("offers"):
                for offer in item["offers"] if isinstance(item["offers"], list) else [item["offers"]]:
                    if isinstance(offer, dict):
                        price = "lowPrice" if "AggregateOffer" in _types(offer) else "price"
                        out += [row("offer-field", "error", t, f, points=3) for f in (price, "priceCurrency") if offer.get(f) in (None, "")]
        out += [row("placeholder", "error", kinds[0] if kinds else "", k, v, 10) for k, v in placeholders(item)]
    return out


def lint(raw: str | None) -> list[dict]:
    """The quality gate's findings: severity block or warn."""
    row = lambda rule, severity, kind="", field="", value="": {"rule": rule, "severity": severity, "type": kind, "field": field, "value": value, "points": 0}
    try:
        data = _read(raw)
    except ValueError:
        return [row("invalid-json", "warn")]
    out = []
    for item in _objects(data, True):
        kinds, bare_graph = _types(item), "@graph" in item and "@type" not in item
        if not kinds and not bare_graph:
            out.append(row("missing-type", "warn"))
        out += [row("deprecated", "block", t) for t in kinds if t in DEPRECATED]
        if "@context" not in item and not bare_graph:
            out.append(row("missing-context", "warn", kinds[0] if kinds else ""))
    # over the whole block, so that what stands in a graph counts once
    return out + [row("placeholder", "block", "", k, v) for k, v in placeholders(data)]


@F.arrow_udf(from_arrow_type(pa.list_(_FINDING)))
def findings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (raw,) in parts(batch):
            yield pa.array([None if r is None else validate(r) for r in raw.to_pylist()], pa.list_(_FINDING))


@F.arrow_udf(from_arrow_type(pa.list_(_FINDING)))
def lint_findings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (raw,) in parts(batch):
            yield pa.array([None if r is None else lint(r) for r in raw.to_pylist()], pa.list_(_FINDING))


# what stands in each text that a placeholder pattern finds, in lower case; and letters that patterns take for i and s
_MARKS = ("business name]", "[your ", "replace_", "replace-", "todo", "fixme", "\u0130", "\u0131", "\u017f")


def parsed(raw) -> "F.Column":
    """A block as VARIANT; null where it isn't one JSON value, or has a repeated key.

    The parser leaves unread what follows a value. So the value is parsed in a list before its text's own hash,
    which must come as the second of two elements: then nothing else followed it.
    """
    own = F.xxhash64(raw)
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), own.cast("string"), F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(pair) == 2) & (F.try_variant_get(pair[1], "$", "bigint") == own), pair[0])


def _list(v):
    return F.try_variant_get(v, "$", "array<variant>")


def _map(v):
    return F.try_variant_get(v, "$", "map<string,variant>")


def _maps(vs):
    """The objects of a list, as maps."""
    return F.filter(F.transform(vs, _map), lambda m: m.isNotNull())


def _text(v):
    return F.try_variant_get(v, "$", "string")


def _kinds(m):
    t = F.try_element_at(m, F.lit("@type"))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    many = F.transform(F.filter(_list(t), is_text), _text)
    return F.when(is_text(t), F.array(_text(t))).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def _lacks(m, field):
    """Whether a field is absent, null or an empty text."""
    return F.coalesce(_text(F.try_element_at(m, field)), F.lit("")) == ""


def _row(rule: str, severity: str, kind=None, field=None, points: int = 0):
    empty = F.lit("")
    cells = {"rule": F.lit(rule), "severity": F.lit(severity), "type": empty if kind is None else kind, "field": empty if field is None else field, "value": empty, "points": F.lit(points)}
    return F.struct(*[c.alias(n) for n, c in cells.items()])


def _if(condition, *found):
    """These findings where the condition holds, else none."""
    return F.filter(F.array(*found), lambda _: condition)


def _in_types(of, table):
    return F.coalesce(F.try_element_at(F.create_map(*[x for t, fs in table.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))]), of), F.array().cast("array<string>"))


def _offers(m):
    """An object's offers that are objects; a lone one that is empty counts as none."""
    v = F.try_element_at(m, F.lit("offers"))
    return _maps(F.coalesce(_list(v), F.filter(F.array(v), lambda x: F.size(_map(x)) > 0)))


def _object_findings(x):
    """Findings of one object and its types (m, kinds)."""
    m, kinds = x["m"], x["kinds"]

    def offer_fields(o, kind):
        price = F.when(F.array_contains(_kinds(o), "AggregateOffer"), "lowPrice").otherwise("price")
        return F.transform(F.filter(F.array(price, F.lit("priceCurrency")), lambda f: _lacks(o, f)), lambda f: _row("offer-field", "error", kind, f, 3))

    def of_kind(t):
        needed = F.filter(_in_types(t, REQUIRED), lambda f: _lacks(m, f))
        offers = F.filter(_offers(m), lambda _: t == "Product")
        return F.concat(
            _if(t.isin(*DEPRECATED), _row("deprecated", "warning", t, points=5)),
            _if(t == "FAQPage", _row("limited", "warning", t)),
            F.transform(needed, lambda f: _row("missing-field", "error", t, f, 5)),
            F.flatten(F.transform(offers, lambda o: offer_fields(o, t))),
        )

    return F.concat(_if(F.size(kinds) == 0, _row("missing-type", "warning")), F.flatten(F.transform(kinds, of_kind)))


def _gate_findings(x):
    m, kinds = x["m"], x["kinds"]
    bare_graph = F.map_contains_key(m, "@graph") & ~F.map_contains_key(m, "@type")
    return F.concat(
        _if((F.size(kinds) == 0) & ~bare_graph, _row("missing-type", "warn")),
        F.transform(F.filter(kinds, lambda t: t.isin(*DEPRECATED)), lambda t: _row("deprecated", "block", t)),
        _if(~F.map_contains_key(m, "@context") & ~bare_graph, _row("missing-context", "warn", F.coalesce(F.get(kinds, F.lit(0)), F.lit("")))),
    )


def _inner(vs):
    """What lists, and graphs of objects, hold: one level down."""
    none = F.array().cast("array<variant>")
    graph = lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")
    return F.flatten(F.transform(vs, lambda v: F.coalesce(_list(v), graph(v), none)))


def with_findings(blocks: DataFrame, gate: bool = False) -> DataFrame:
    """blocks (raw; other columns stay) with `found`: what the audit, or the quality gate, finds in each block.

    Null blocks and empty ones are invalid JSON. A block that VARIANT can't read, or that may hold a placeholder,
    goes to the Python walk, all others don't.
    """
    rows = blocks.withColumn("_v", parsed(F.col("raw")))
    # escapes may hide a mark: then the value's own text is looked at
    text = F.when(F.contains("raw", F.lit("\\")), F.to_json("_v")).otherwise(F.col("raw"))
    rows = rows.withColumn("_t", F.concat(text, F.lower(text)))
    marked = reduce(or_, [F.contains("_t", F.lit(mark)) for mark in _MARKS])
    rows = rows.withColumn("_v", F.when(~marked, F.col("_v"))).drop("_t")
    if gate:
        rows = rows.withColumn("_a", F.when(F.col("_v").isNotNull(), F.array("_v")))
        rows = rows.withColumn("_b", _inner(F.col("_a"))).withColumn("_c", _inner(F.col("_b"))).withColumn("_d", _inner(F.col("_c")))
        rows = rows.withColumn("_m", F.when(F.size(_inner(F.col("_d"))) == 0, _maps(F.concat("_a", "_b", "_c", "_d")))).drop("_a", "_b", "_c", "_d")
    else:
        graph = F.try_variant_get("_v", "$['@graph']", "array<variant>")
        own = F.filter(F.array(_map(F.col("_v"))), lambda m: m.isNotNull() & (graph.isNull() | F.map_contains_key(m, "@type")))
        inner = F.coalesce(_list(F.col("_v")), graph, F.array().cast("array<variant>"))
        rows = rows.withColumn("_m", F.when(F.col("_v").isNotNull(), F.concat(own, _maps(inner))))
    rows = rows.withColumn("_m", F.transform("_m", lambda m: F.struct(m.alias("m"), _kinds(m).alias("kinds"))))
    rows = rows.withColumn("found", F.flatten(F.transform("_m", _gate_findings if gate else _object_findings)))
    walked = (lint_findings if gate else findings)(F.when(F.col("found").isNull(), F.coalesce("raw", F.lit(""))))
    return rows.withColumn("found", F.coalesce("found", walked)).drop("_v", "_m")


def finding_rows(blocks: DataFrame, key: str, gate: bool = False) -> DataFrame:
    """blocks (key, raw) -> (key, f): a row a finding, and one with a null f for a block without any.

    Outer, as the condition that Spark derives for a plain explode would repeat the whole expression below it.
    """
    return with_findings(blocks.select(key, "raw"), gate).select(key, F.explode_outer("found").alias("f"))


def audit(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, raw) -> a row a page: blocks, errors, warnings, score; pages without blocks aren't here and score 0."""
    found = finding_rows(blocks, key)
    per = found.groupBy(key).agg(F.count_if(F.col("f.severity") == "error").alias("errors"), F.count_if(F.col("f.severity") == "warning").alias("warnings"), F.greatest(F.lit(0), 100 - F.coalesce(F.sum("f.points"), F.lit(0))).cast("long").alias("score"))
    return per.join(blocks.groupBy(key).agg(F.count("*").alias("blocks")), key)


def lint_verdict(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, raw) -> a row a page: block and warn findings, and whether the gate stops it: any finding of severity block."""
    found = finding_rows(blocks, key, gate=True)
    count = lambda s: F.count_if(F.col("f.severity") == s)
    return found.groupBy(key).agg(count("block").alias("block"), count("warn").alias("warn"), (count("block") > 0).alias("blocked"))


def missing_fields(objects: DataFrame) -> DataFrame:
    """objects (id, type, present array<string>): one row for each field a type needs and the object lacks.

    Native: a join with the table of needed fields, which has a fixed size, and an anti-condition.
    """
    return objects.join(F.broadcast(required_fields(objects.sparkSession)), "type").where(~F.array_contains("present", F.col("field"))).select("id", "type", "field")


def present_fields(raw) -> "F.Column":
    """Names of an object's top-level fields that are neither null nor empty, through VARIANT."""
    return F.map_keys(F.map_filter(_map(F.try_parse_json(raw)), lambda k, x: F.coalesce(_text(x), F.lit("")) != ""))
