"""Audits as tables of rules: what must hold, how bad it is, what it costs. Each is evaluated in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.functions import urls as U

CRITICAL, WARNING, INFO, PASS = "CRITICAL", "WARNING", "INFO", "PASS"
RANK = {CRITICAL: 0, WARNING: 1, INFO: 2, PASS: 3}


@dataclass
class Rule:
    id: str
    severity: str
    category: str
    when: Column
    message: str | Column
    points: Column | int = 0
    details: Column | None = None


def apply(df: DataFrame, rules: list[Rule], base: Column | int = 100) -> DataFrame:
    """df with issues (array of structs) and score: base less the points of the rules that hold, not below 0."""
    found, lost = [], F.lit(0)
    for r in rules:
        message = r.message if isinstance(r.message, Column) else F.lit(r.message)
        details = r.details if r.details is not None else F.lit("")
        one = F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), message.alias("message"), details.cast("string").alias("details"))
        found.append(F.when(F.coalesce(r.when, F.lit(False)), one))
        points = r.points if isinstance(r.points, Column) else F.lit(r.points)
        lost = lost + F.when(F.coalesce(r.when, F.lit(False)), points).otherwise(0)
    base = base if isinstance(base, Column) else F.lit(base)
    return df.withColumn("issues", F.filter(F.array(*found), lambda x: x.isNotNull())).withColumn("score", F.greatest(F.lit(0), base - lost).cast("long"))


def issues(audited: DataFrame, *keys: str) -> DataFrame:
    return audited.select(*keys, F.explode("issues").alias("i")).select(*keys, "i.*")


def severity_counts(found: DataFrame, *by: str) -> DataFrame:
    """critical, warning, info, passed; what is none of the others counts as info."""
    s = F.col("severity")
    return found.groupBy(*by).agg(F.count_if(s == CRITICAL).alias("critical"), F.count_if(s == WARNING).alias("warning"), F.count_if(~s.isin(CRITICAL, WARNING, PASS)).alias("info"), F.count_if(s == PASS).alias("passed"))


def trips(found: DataFrame, level: str) -> DataFrame:
    """One row: whether findings reach the level at which a run is to fail. For level "change" the findings are drift's, and a significant one is enough."""
    if level == "change":
        return found.agg(F.coalesce(F.bool_or("significant"), F.lit(False)).alias("failed"))
    bad = {"critical": [CRITICAL], "warning": [CRITICAL, WARNING]}[level]
    return found.agg(F.coalesce(F.bool_or(F.col("severity").isin(*bad)), F.lit(False)).alias("failed"))


# ---------------------------------------------------------------- HTTP headers
def _directives(values: Column, words: tuple[str, ...]) -> Column:
    """Whether a comma list has a directive; before the last colon an agent may stand."""
    return F.exists(F.flatten(F.transform(values, lambda v: F.split(F.lower(v), ","))), lambda d: F.trim(F.regexp_extract(d, "([^:]*)$", 1)).isin(*words))


def headers(fetch: DataFrame) -> DataFrame:
    """fetch: requested_url, final_url, status, headers map<string,array<string>> (lower-case names), redirects array<struct<url,status>>, ttfb_ms."""
    s, hops = F.col("status"), F.coalesce(F.size("redirects"), F.lit(0))
    h = lambda n: F.coalesce(F.try_element_at("headers", F.lit(n)), F.array().cast("array<string>"))
    soft = F.size(F.filter("redirects", lambda r: r["status"].isin(302, 307)))
    https = F.lower(F.col("final_url")).startswith("https://")
    return apply(fetch, [
        Rule("R-H1", PASS, "Status", s == 200, "The page answers with 200"),
        Rule("R-H2", CRITICAL, "Status", s == 404, "The page isn't found"),
        Rule("R-H3", WARNING, "Status", s == 410, "The page is gone"),
        Rule("R-H4", CRITICAL, "Status", s >= 500, "The server fails"),
        Rule("R-H5", CRITICAL, "Status", (s >= 400) & (s < 500) & ~s.isin(404, 410), "The request is refused"),
        Rule("R-H6", WARNING, "Redirects", hops > 2, "Long redirect chain", details=hops),
        Rule("R-H7", WARNING, "Redirects", soft > 0, "Temporary redirects", details=soft),
        Rule("R-H8", INFO, "Redirects", U.host_of(F.col("requested_url")) != U.host_of(F.col("final_url")), "Redirects to another host"),
        Rule("R-H9", CRITICAL, "Indexability", _directives(h("x-robots-tag"), ("noindex", "none")), "X-Robots-Tag forbids indexing"),
        Rule("R-H10", WARNING, "Indexability", _directives(h("x-robots-tag"), ("nofollow", "none")), "X-Robots-Tag forbids following"),
        Rule("R-H11", INFO, "Canonical", F.exists(h("link"), lambda v: F.lower(v).rlike('rel="?canonical')), "Canonical given as a header"),
        Rule("R-H12", WARNING, "Performance", F.size(h("content-encoding")) == 0, "Not compressed"),
        Rule("R-H13", WARNING, "Performance", F.col("ttfb_ms") > 800, "Slow first byte", details=F.col("ttfb_ms")),
        Rule("R-H13b", PASS, "Performance", F.col("ttfb_ms").between(1, 200), "Fast first byte", details=F.col("ttfb_ms")),
        Rule("R-H14", INFO, "Security", https & (F.size(h("strict-transport-security")) == 0), "No HSTS"),
    ])


# ---------------------------------------------------------------- page audits over parsed facts
def technical(pages: DataFrame) -> DataFrame:
    """pages: url, facts."""
    f = lambda n: F.col(f"facts.{n}")
    script = T.classify_with_hint(F.concat_ws(" ", f("title"), f("description"), F.array_join(f("h1"), " ")), f("lang"))
    df = pages.withColumns({"title_width": T.display_width(f("title")), "description_width": T.display_width(f("description")), "script": script})
    low, high = T.by_script(F.col("script"), T.DESCRIPTION_MIN), T.by_script(F.col("script"), T.DESCRIPTION_MAX)
    no_alt = F.size(F.filter(f("images"), lambda i: i.alt.isNull() | (F.trim(i.alt) == "")))
    return apply(df.withColumn("missing_alt", no_alt), [
        Rule("R-T1", CRITICAL, "Title", f("title") == "", "No title", 20),
        Rule("R-T2", WARNING, "Title", (f("title") != "") & ~F.col("title_width").between(T.TITLE_MIN, T.TITLE_MAX), "Title too short or too long", 5, F.col("title_width")),
        Rule("R-T3", WARNING, "Description", f("description") == "", "No description", 10),
        Rule("R-T4", INFO, "Description", (f("description") != "") & ((F.col("description_width") < low) | (F.col("description_width") > high)), "Description too short or too long", 0, F.col("description_width")),
        Rule("R-T5", CRITICAL, "Indexability", F.contains(F.lower(f("robots")), F.lit("noindex")), "Robots meta forbids indexing", 40),
        Rule("R-T6", WARNING, "Canonical", f("canonical") == "", "No canonical", 10),
        Rule("R-T7", CRITICAL, "Mobile", f("viewport") == "", "No viewport", 15),
        Rule("R-T8", WARNING, "Headings", f("h1_count") == 0, "No h1", 10),
        Rule("R-T8b", INFO, "Headings", f("h1_count") > 1, "Several h1", 0, f("h1_count")),
        Rule("R-T9", WARNING, "Images", no_alt > 0, "Images without alternative text", 5, no_alt),
    ])


def skipped_levels(headings: Column) -> Column:
    """Headings that are more than one level below the one before."""
    levels = F.transform(headings, lambda h: h.level)
    later = F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1)))
    return F.size(F.filter(F.zip_with(later, F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: a - b), lambda d: d > 1))


def content(pages: DataFrame, keyword: str | None = None) -> DataFrame:
    """pages: facts. Adds length, script, minutes, paragraphs by shape, density."""
    f = lambda n: F.col(f"facts.{n}")
    df = pages.withColumn("script", f("body_script"))
    s = F.col("script")
    size = lambda p: T.length(p, s)
    df = df.withColumns({"units": T.length(f("body_text"), s), "sizes": F.transform(f("paragraphs"), size), "paragraph_words": F.transform(f("paragraphs"), T.count_words)})
    long_max, thin = T.by_script(s, T.LONG_PARAGRAPH), T.by_script(s, T.THIN)
    df = df.withColumns({
        "minutes": T.reading_minutes(F.col("units"), s), "long_paragraphs": F.size(F.filter("sizes", lambda n: n > long_max)),
        "answers": F.size(F.filter("paragraph_words", lambda n: n.between(40, 80))), "citations": F.size(F.filter("paragraph_words", lambda n: n.between(130, 180))),
        "skips": skipped_levels(f("headings")),
    })
    n = F.col("units")
    rules = [
        Rule("R-C1", CRITICAL, "Depth", n < F.floor(thin / 2), "Very thin content", 30, n),
        Rule("R-C1b", WARNING, "Depth", (n < thin) & (n >= F.floor(thin / 2)), "Thin content", 15, n),
        Rule("R-C2", INFO, "Readability", F.col("long_paragraphs") > 0, "Long paragraphs", F.least("long_paragraphs", F.lit(5)), F.col("long_paragraphs")),
        Rule("R-C3", WARNING, "Structure", F.col("skips") > 0, "Heading levels skipped", F.least(F.col("skips") * 3, F.lit(15)), F.col("skips")),
        Rule("R-C4", WARNING, "Structure", F.size(f("headings")) == 0, "No headings", 15),
        Rule("R-C5", WARNING, "Trust", ~f("has_author"), "No author", 10),
        Rule("R-C6", INFO, "Freshness", ~f("has_date"), "No date", 5),
        Rule("R-C7", INFO, "Answers", F.col("answers") == 0, "No answer-sized paragraph", 5),
    ]
    if keyword:
        df = df.withColumn("hits", T.count_keyword(f("body_text"), F.lit(keyword)))
        df = df.withColumn("density", F.when(n > 0, F.col("hits") * 100.0 / n).otherwise(0.0))
        lede = F.when(s == "latin", T.first_words(f("body_text"), 100))
        for name, v in zip(T.SCRIPTS[1:], T.THIN[1:]):
            lede = lede.when(s == name, T.first_units(f("body_text"), s, 100 * v // 300))
        df = df.withColumn("in_lede", T.count_keyword(lede, F.lit(keyword)) > 0)
        rules += [
            Rule("R-C9", WARNING, "Keyword", F.col("density") > 3.0, "Keyword too dense", 10, F.col("density")),
            Rule("R-C9b", WARNING, "Keyword", F.col("density") < 0.3, "Keyword too rare", 5, F.col("density")),
            Rule("R-C10", INFO, "Keyword", ~F.col("in_lede"), "Keyword not in the opening", 3),
        ]
    return apply(df, rules)


def images(pages: DataFrame) -> DataFrame:
    """pages: facts. Counts over the page's images, then the audit; a page without images scores 100."""
    im = F.col("facts.images")
    count = lambda p: F.size(F.filter(im, p))
    low = lambda i: F.lower(i.src)
    modern = lambda i: low(i).rlike(r"\.(webp|avif)")
    df = pages.withColumns({
        "total": F.size(im), "missing_alt": count(lambda i: i.alt.isNull()), "decorative": count(lambda i: F.trim(i.alt) == ""), "long_alt": count(lambda i: F.length(i.alt) > 125),
        "no_size": count(lambda i: ~i.has_size), "lazy": count(lambda i: i.lazy), "insecure": count(lambda i: i.src.startswith("http://")), "data_uris": count(lambda i: i.src.startswith("data:")),
        "large_data": count(lambda i: i.src.startswith("data:") & (F.octet_length(i.src) > 10 * 1024)), "modern": count(modern), "legacy": count(lambda i: ~modern(i) & low(i).rlike(r"\.(jpg|jpeg|png|gif)")),
    })
    cost = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    return apply(df, [
        Rule("R-I0", INFO, "Images", F.col("total") == 0, "No images"),
        Rule("R-I1", WARNING, "Images", F.col("missing_alt") > 0, "Images without alt", cost("missing_alt", 5, 25), F.col("missing_alt")),
        Rule("R-I2", INFO, "Images", F.col("long_alt") > 0, "Very long alt", cost("long_alt", 2, 6), F.col("long_alt")),
        Rule("R-I3", WARNING, "Images", F.col("no_size") > 0, "Images without dimensions", cost("no_size", 3, 15), F.col("no_size")),
        Rule("R-I4", WARNING, "Images", F.col("insecure") > 0, "Images over http", cost("insecure", 2, 10), F.col("insecure")),
        Rule("R-I5", WARNING, "Images", F.col("large_data") > 0, "Large data URIs", cost("large_data", 5, 15), F.col("large_data")),
        Rule("R-I6", INFO, "Images", (F.col("legacy") > 0) & (F.col("modern") == 0), "No modern formats"),
        Rule("R-I7", INFO, "Images", (F.col("lazy") == 0) & (F.col("total") > 3), "No lazy loading"),
    ])


def hreflang(pages: DataFrame) -> DataFrame:
    """pages: url, facts. Alternates are compared with the page by key, relative to it; a page without any scores 0."""
    h = F.col("facts.hreflang")
    invalid = F.filter(h, lambda x: (~x.valid) | ((x.hreflang != "x-default") & (F.lower(x.hreflang) == "x-default")))
    codes = F.transform(h, lambda x: x.hreflang)
    twice = F.array_sort(F.filter(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)) > 1))
    repeated = F.transform(twice, lambda c: F.concat(c, F.lit(" (x"), F.size(F.filter(codes, lambda d: d == c)).cast("string"), F.lit(")")))
    languages = F.array_distinct(F.filter(F.transform(codes, lambda c: F.lower(F.regexp_extract(c, "^[^-]*", 0))), lambda c: c != "x"))
    df = pages.withColumns({"alternates": F.size(h), "invalid": F.transform(invalid, lambda x: x.hreflang), "repeated": repeated, "languages": languages, "has_default": F.exists(codes, lambda c: F.lower(c) == "x-default")})
    key = U.key_absolute(F.col("url"))
    absolute = F.transform(h, lambda x: U.resolve(F.col("url"), x.href))
    df = df.withColumn("self_reference", F.exists(absolute, lambda u: U.key_absolute(u) == key))
    some = F.col("alternates") > 0
    return apply(df, [
        Rule("R-L0", INFO, "Hreflang", ~some, "No alternates"),
        Rule("R-L1", CRITICAL, "Hreflang", some & (F.size("invalid") > 0), "Invalid codes", 25, F.array_join("invalid", ", ")),
        Rule("R-L2", WARNING, "Hreflang", some & (F.size("repeated") > 0), "Codes given twice", 10, F.array_join("repeated", ", ")),
        Rule("R-L3", WARNING, "Hreflang", some & ~F.col("has_default"), "No x-default", 10),
        Rule("R-L4", WARNING, "Hreflang", some & ~F.col("self_reference"), "No reference to itself", 15),
    ], F.when(some, 100).otherwise(0))


def llms(files: DataFrame) -> DataFrame:
    """files: body (null if there is none), has_full. The llms.txt of a site."""
    b = F.col("body")
    df = files.withColumns({"sections": (F.regexp_count(b, F.lit("\n#")) + F.regexp_count(b, F.lit("\n##"))).cast("long"), "links": F.regexp_count(b, F.lit(r"\[[^\]]+\]\(https?://[^)\s]+\)")).cast("long")})
    some = b.isNotNull()
    return apply(df, [
        Rule("R-X0", INFO, "llms.txt", ~some, "No llms.txt"),
        Rule("R-X1", WARNING, "llms.txt", some & ~F.trim(b).startswith("#"), "Doesn't begin with a title", 10),
        Rule("R-X2", WARNING, "llms.txt", some & (F.col("links") == 0), "No links", 15),
        Rule("R-X3", INFO, "llms.txt", some & ~F.col("has_full"), "No full variant", 5),
    ], F.when(some, 100).otherwise(0))
