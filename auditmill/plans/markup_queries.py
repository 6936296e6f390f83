"""Audits of pages whose markup follows from page_id by formulas, so that every branch of a rule meets pages that take it.

MARKUP is SQL that Spark and DuckDB read alike. Spark parses it into facts; the SQL beside a query never parses
markup, but says from page_id what must come out (only texts as a whole are taken from the markup, without tags).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill import api
from auditmill.operators import drift, jsonld, report, rules, site
from auditmill.plans.registry import query, table
from auditmill.plans.site_queries import ALL_ISSUES, with_
from auditmill.sources import html

_I = "CAST(page_id AS VARCHAR(20))"
LANG = "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'de' ELSE 'fr-CA' END"
TITLE = f"CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'Short ' || CAST(page_id % 40 AS VARCHAR(20)) ELSE 'A title of a length that fits, page ' || {_I} END"
DESCRIPTION = f"CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Too short' WHEN 2 THEN trim(repeat('long words ', 20)) ELSE 'A description that says enough of what is to be found on the page with number ' || {_I} END"
ROBOTS = "CASE page_id % 7 WHEN 3 THEN 'NoIndex, follow' WHEN 4 THEN 'googlebot: none' WHEN 5 THEN 'index,follow' ELSE '' END"
#: Of 40 pages, so that a canonical or alternate can name a page that isn't there.
CANONICAL = f"CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://M.example/p' || {_I} || '#top' WHEN 2 THEN './q/../p' || CAST((page_id + 4) % 40 AS VARCHAR(20)) ELSE '//other.example/p' || {_I} END"


def _tag(value: str, before: str, after: str) -> str:
    return f"CASE WHEN {value} = '' THEN '' ELSE '{before}' || {value} || '{after}' END"


def _p(words: str, n: int, when: str) -> str:
    return f"CASE WHEN {when} THEN '<p>' || trim(repeat('{words} ', {n})) || '</p>' ELSE '' END"


JSONLD = """CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '<script type=" Application/LD+json "> {"@context":"c","@type":"Article","headline":"h","datePublished":"d","author":"a"} </script>'
 WHEN 2 THEN '<script type="application/ld+json">{"@type": </script>' WHEN 3 THEN '<script type="application/ld+json">{"name":"x"}</script><script type="application/ld+json"> </script>'
 WHEN 4 THEN '<script type="application/ld+json">[{"@context":"c","@type":"HowTo"},{"@context":"c","@type":"Person","name":"[Your Name]"}]</script>'
 ELSE '<script type="application/ld+json">{"@context":"c","@graph":[{"@type":"WebSite","name":"n","url":"u"},{"@type":["Organization","FAQPage"],"name":"TODO"}]}</script>' END"""
_HEAD = [
    _tag(TITLE, "<title>", "</title>"), _tag(DESCRIPTION, '<meta name="Description" content=" ', ' ">'), _tag(ROBOTS, '<meta name="ROBOTS" content="', '">'), _tag(CANONICAL, '<link rel="Canonical" href=" ', '">'),
    """CASE WHEN page_id % 2 = 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END""",
    """CASE WHEN page_id % 6 = 0 THEN '<meta property="og:title" content="o"><meta property="og:description" content="od"><meta property="og:image" content="/o.png">' ELSE '' END""",
    """CASE WHEN page_id % 10 <> 0 THEN '<meta charset="utf-8">' ELSE '' END""",
    """CASE page_id % 6 WHEN 0 THEN '<meta name="author" content="A. Writer">' ELSE '' END""",
    """CASE page_id % 5 WHEN 1 THEN '<meta property="article:published_time" content="2026-01-02">' WHEN 2 THEN '<meta name="date" content="2026">' WHEN 3 THEN '<meta property="article:modified_time" content=" ">' ELSE '' END""",
    f"""CASE WHEN page_id % 3 = 0 THEN '<link rel="alternate" hreflang="en" href="p' || {_I} || '"><link rel="alternate" hreflang="de-AT" href="/p' || CAST((40 - page_id % 41) AS VARCHAR(20)) || '"><link rel="alternate" href="/feed">' ELSE '' END""",
    JSONLD,
]
_BODY = [
    f"CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN '<h1>One ' || {_I} || '</h1><h1>Two</h1>' ELSE '<h1>Head ' || {_I} || '</h1>' END",
    "CASE WHEN page_id % 3 = 2 THEN '<div>zebra zebra</div>' ELSE '' END",
    "CASE WHEN page_id % 9 = 0 THEN '' ELSE '<h2><a href=\"#part\">Part</a></h2>' || CASE WHEN page_id % 11 = 2 THEN '<h4>Deep</h4>' ELSE '<h3>Next</h3>' END END",
    "'<p>Just words here.</p>'", _p("answer", 50, "page_id % 4 = 0"), _p("cited", 150, "page_id % 7 = 0"), _p("long", 160, "page_id % 10 = 0"), _p("longer", 200, "page_id % 13 = 0"),
    "CASE page_id % 6 WHEN 1 THEN '<a rel=\"author\" href=\"mailto:w@m.example\">w</a>' WHEN 2 THEN '<span class=\"x Byline\">by</span>' WHEN 3 THEN '<i itemprop=\"author\">A</i>' ELSE '' END",
    "CASE WHEN page_id % 5 = 0 THEN '<time datetime=\"2026-01-02\">then</time>' ELSE '' END",
    "repeat('<ul><li>item</li></ul>', CAST(page_id % 3 AS INTEGER)) || repeat('<ol><li>item</li></ol>', CAST(page_id % 2 AS INTEGER)) || repeat('<table><tr><td>cell</td></tr></table>', CAST(page_id % 4 AS INTEGER))",
    "CASE WHEN page_id % 6 IN (1, 2) THEN '<img src=\"/a.webp\" alt=\"\" width=\"1\" height=\"1\" loading=\"Lazy\">' ELSE '' END", "CASE WHEN page_id % 6 IN (2, 3, 4) THEN '<img src=\" http://x.example/b.JPG\">' ELSE '' END",
    "CASE WHEN page_id % 6 IN (3, 4, 5) THEN '<img src=\"/c.png\" alt=\"' || repeat('x', 126) || '\" width=\"2\" height=\"2\">' ELSE '' END",
    "CASE WHEN page_id % 6 = 4 THEN '<img src=\"data:image/gif;base64,' || repeat('A', 10300) || '\" alt=\"d\" width=\"1\" height=\"1\">' ELSE '' END",
    "CASE WHEN page_id % 6 IN (4, 5) THEN repeat('<img src=\"/e.gif\" alt=\"e\" width=\"1\" height=\"1\">', 2) ELSE '' END",
    "'<a href=\"/p' || CAST((page_id * 3 + 1) % 40 AS VARCHAR(20)) || '\">a</a><a href=\"p' || CAST((page_id * 3 + 2) % 40 AS VARCHAR(20)) || '?utm_source=x#y\">b</a><a href=\"https://other.example/\">c</a>'",
    "CASE WHEN page_id % 3 = 1 THEN '<div>zebra zebra</div>' ELSE '' END", "'<script>var nothing = 1;</script>'",
]
MARKUP = f"'<html' || CASE page_id % 3 WHEN 0 THEN '' ELSE ' lang=\"' || {LANG} || '\"' END || '><head>' || " + " || ".join(_HEAD) + " || '</head><body>' || " + " || ".join(_BODY) + " || '</body></html>'"
#: The markup's text: everything outside of tags and scripts.
_TEXT = f"regexp_replace(regexp_replace({MARKUP}, '<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_WORDS = rf"regexp_extract_all({_TEXT}, '[\p{{L}}\p{{Nd}}]+')"
URL = f"'https://m.example/p' || {_I}"


def markup(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(URL).alias("url"), F.expr(MARKUP).alias("html"))


def facts(spark, d) -> DataFrame:
    return html.parsed(markup(spark, d))


_HAS_HEADINGS = "page_id % 9 <> 0"


@query(f"""SELECT page_id, {LANG} AS lang, {TITLE} AS title, {TITLE} AS crawl_title, {DESCRIPTION} AS description, {ROBOTS} AS robots, CASE WHEN page_id % 2 = 0 THEN 'width=device-width' ELSE '' END AS viewport,
 CASE WHEN page_id % 6 = 0 THEN 'o|od|/o.png' ELSE '||' END AS og, CASE WHEN page_id % 10 <> 0 THEN 'utf-8' ELSE '' END AS charset, {CANONICAL} AS canonical, page_id % 7 IN (3, 4) AS noindex, page_id % 6 < 4 AS has_author, page_id % 5 < 3 AS has_date FROM pages""")
def page_meta(spark, d):
    og = F.concat_ws("|", "facts.og_title", "facts.og_description", "facts.og_image").alias("og")
    plain = [f"facts.{c}" for c in ("lang", "title", "crawl_title", "description", "robots", "viewport", "charset", "canonical", "noindex", "has_author", "has_date")]
    return facts(spark, d).select("page_id", og, *plain)


@query(f"""SELECT page_id, CAST(CASE page_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS h1_count, CAST(CASE WHEN {_HAS_HEADINGS} THEN 1 ELSE 0 END AS BIGINT) AS h2_count, CAST(CASE WHEN {_HAS_HEADINGS} AND page_id % 11 <> 2 THEN 1 ELSE 0 END AS BIGINT) AS h3_count,
 CAST(page_id % 3 + page_id % 2 AS BIGINT) AS list_count, CAST(page_id % 4 AS BIGINT) AS table_count, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'One ' || page_id || '|Two' ELSE 'Head ' || page_id END AS h1,
 CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN '1 One ' || page_id || '|1 Two|2 Part' ELSE '1 Head ' || page_id || '|2 Part' END || CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 11 = 2 THEN '|4 Deep' ELSE '|3 Next' END AS headings,
 '3' || CASE WHEN page_id % 4 = 0 THEN ' 50' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN ' 150' ELSE '' END || CASE WHEN page_id % 10 = 0 THEN ' 160' ELSE '' END || CASE WHEN page_id % 13 = 0 THEN ' 200' ELSE '' END AS paragraphs FROM pages""")
def page_structure(spark, d):
    heads = F.array_join(F.transform("facts.headings", lambda h: F.concat_ws(" ", h.level, h.text)), "|").alias("headings")
    sizes = F.array_join(F.transform("facts.paragraphs", lambda p: F.size(F.split(p, " ")).cast("string")), " ").alias("paragraphs")
    return facts(spark, d).select("page_id", *[f"facts.{c}_count" for c in ("h1", "h2", "h3", "list", "table")], F.array_join("facts.h1", "|").alias("h1"), heads, sizes)


@query("""SELECT page_id, CAST(pos AS INTEGER) AS pos, raw FROM (SELECT page_id, 0 AS pos, CASE page_id % 6 WHEN 1 THEN '{"@context":"c","@type":"Article","headline":"h","datePublished":"d","author":"a"}' WHEN 2 THEN '{"@type":' WHEN 3 THEN '{"name":"x"}'
 WHEN 4 THEN '[{"@context":"c","@type":"HowTo"},{"@context":"c","@type":"Person","name":"[Your Name]"}]' WHEN 5 THEN '{"@context":"c","@graph":[{"@type":"WebSite","name":"n","url":"u"},{"@type":["Organization","FAQPage"],"name":"TODO"}]}' ELSE '' END AS raw FROM pages) WHERE raw <> ''""")
def page_jsonld(spark, d):
    return html.jsonld_blocks(facts(spark, d), "page_id")


_SCHEMA = "(VALUES (1, 1, 0, 95, 0, 0), (2, 1, 0, 70, 0, 1), (3, 0, 1, 100, 0, 2), (4, 1, 1, 85, 2, 0), (5, 3, 1, 80, 1, 2)) t(k, errors, warnings, score, block, warn)"


@query(f"SELECT page_id, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, CAST(score AS BIGINT) AS score, 1::BIGINT AS blocks FROM pages JOIN {_SCHEMA} ON k = page_id % 6")
def page_schema(spark, d):
    return jsonld.audit(html.jsonld_blocks(facts(spark, d), "page_id"), "page_id").select("page_id", "errors", "warnings", "score", "blocks")


@query(f"SELECT page_id, CAST(block AS BIGINT) AS block, CAST(warn AS BIGINT) AS warn, block > 0 AS blocked FROM pages JOIN {_SCHEMA} ON k = page_id % 6")
def page_lint(spark, d):
    """The quality gate's verdict on each page's blocks."""
    return jsonld.lint_verdict(html.jsonld_blocks(facts(spark, d), "page_id"), "page_id")


_TITLE_OFF = f"({TITLE}) <> '' AND length({TITLE}) NOT BETWEEN 30 AND 60"
_TECHNICAL = {
    "R-T1": ("page_id % 8 = 0", "20"), "R-T2": (_TITLE_OFF, "5"), "R-T3": ("page_id % 5 = 0", "10"), "R-T4": ("page_id % 5 IN (1, 2)", "0"), "R-T5": ("page_id % 7 = 3", "40"), "R-T6": ("page_id % 4 = 0", "10"),
    "R-T7": ("page_id % 2 = 1", "15"), "R-T8": ("page_id % 9 = 0", "10"), "R-T8b": ("page_id % 9 = 1", "0"), "R-T9": ("page_id % 6 IN (1, 2, 3, 4)", "5"),
}
_LONG = "(CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END)"
_DENSITY = "(100.0 * CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 END / units)"
_CONTENT = {
    "R-C1": ("units < 150", "30"), "R-C1b": ("units BETWEEN 150 AND 299", "15"), "R-C2": (f"{_LONG} > 0", _LONG), "R-C3": (f"{_HAS_HEADINGS} AND page_id % 11 = 2", "3"), "R-C4": ("page_id % 9 = 0", "15"),
    "R-C5": ("page_id % 6 >= 4", "10"), "R-C6": ("page_id % 5 >= 3", "5"), "R-C7": ("page_id % 4 <> 0", "5"), "R-C9": (f"{_DENSITY} > 3.0", "10"), "R-C9b": (f"{_DENSITY} < 0.3", "5"),
    "R-C10": ("NOT list_contains(opening, 'zebra')", "3"),
}
_IMAGES = {
    "R-I0": ("page_id % 6 = 0", "0"), "R-I1": ("page_id % 6 IN (2, 3, 4)", "5"), "R-I2": ("page_id % 6 IN (3, 4, 5)", "2"), "R-I3": ("page_id % 6 IN (2, 3, 4)", "3"), "R-I4": ("page_id % 6 IN (2, 3, 4)", "2"),
    "R-I5": ("page_id % 6 = 4", "5"), "R-I6": ("page_id % 6 IN (3, 4, 5)", "0"), "R-I7": ("page_id % 6 = 4", "0"),
}


def _expected(table: dict[str, tuple[str, str]], of: str = "pages") -> str:
    """SQL of each page's rules that hold, in order, and its score."""
    held = " || ".join(f"CASE WHEN {when} THEN '{rule} ' ELSE '' END" for rule, (when, _) in table.items())
    lost = " + ".join(f"CASE WHEN {when} THEN {points} ELSE 0 END" for when, points in table.values())
    return f"SELECT page_id, trim({held}) AS rules, CAST(greatest(0, 100 - ({lost})) AS BIGINT) AS score FROM {of}"


def _held(audited: DataFrame) -> DataFrame:
    return audited.select("page_id", F.array_join(F.transform("issues", lambda i: i.rule), " ").alias("rules"), "score")


@query(_expected(_TECHNICAL))
def page_technical_rules(spark, d):
    return _held(rules.technical(facts(spark, d)))


@query(_expected(_CONTENT, f"(SELECT page_id, len({_WORDS}) AS units, ({_WORDS})[1:100] AS opening FROM pages)"))
def page_content_rules(spark, d):
    return _held(rules.content(facts(spark, d), "zebra"))


@query(_expected(_IMAGES))
def page_image_rules(spark, d):
    return _held(rules.images(facts(spark, d)))


@query("SELECT count(*) FILTER (WHERE page_id % 7 = 3 OR page_id % 8 = 0 OR page_id % 2 = 1) > 0 AS critical, count(*) FILTER (WHERE page_id % 6 IN (1, 2, 3, 4)) > 0 AS images_warn, false AS images_critical, false AS nothing FROM pages")
def fail_on_levels(spark, d):
    """Runs that fail on critical findings, on warnings, and runs that find nothing of the level."""
    page = facts(spark, d)
    t, i = rules.issues(rules.technical(page), "page_id"), rules.issues(rules.images(page), "page_id")
    gates = {"critical": (t, "critical"), "images_warn": (i, "warning"), "images_critical": (i, "critical"), "nothing": (t.where("false"), "warning")}
    out = None
    for name, args in gates.items():
        row = rules.trips(*args).withColumnRenamed("failed", name)
        out = row if out is None else out.join(row)
    return out


# ---------------------------------------------------------------- the site that these pages make
_STATUS = "CASE page_id % 23 WHEN 3 THEN 404 WHEN 6 THEN 503 ELSE 200 END"
_TYPE = "CASE WHEN page_id % 10 = 9 THEN '' WHEN page_id % 37 = 5 THEN 'application/pdf' ELSE 'Text/HTML; charset=utf-8' END"
_IS_HTML = "(page_id % 10 = 9 OR page_id % 37 <> 5)"
_AT = lambda x: f"'https://m.example/p' || CAST({x} AS VARCHAR(20))"
_HOPS = "CASE WHEN page_id % 17 = 11 THEN 1 WHEN page_id % 17 = 12 THEN 2 ELSE 0 END"
_FINAL = f"CASE WHEN {_HOPS} > 0 THEN {_AT('page_id + 1')} ELSE {URL} END"
_CANON_KEY = f"CASE WHEN NOT {_IS_HTML} THEN '' ELSE CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN {URL} WHEN 2 THEN {_AT('(page_id + 4) % 40')} ELSE 'https://other.example/p' || {_I} END END"
_SITE = f"""(SELECT page_id AS id, {URL} AS url, {URL} AS key, {_FINAL} AS final_key, {_STATUS} AS status, '' AS error, CAST(page_id % 6 AS INTEGER) AS depth, {_HOPS} AS hops, {_IS_HTML} AS is_html, page_id % 7 IN (3, 4) AS noindex, {TITLE} AS title, {DESCRIPTION} AS description,
 CASE WHEN length(trim(regexp_replace({_TEXT}, ' +', ' ', 'g'))) >= 200 THEN trim(regexp_replace({_TEXT}, ' +', ' ', 'g')) ELSE '' END AS text_hash, {_CANON_KEY} AS canonical, {_CANON_KEY} AS canonical_key FROM pages)"""
_LINK = f"(SELECT {URL} AS src_key, {_AT('(page_id * 3 + k) % 40')} AS dst_key FROM pages, (VALUES (1), (2)) t(k) WHERE {_STATUS} = 200 UNION SELECT {URL}, {_FINAL} FROM pages WHERE {_STATUS} = 200 AND {_HAS_HEADINGS})"
_ALTERNATE = f"(SELECT {URL} AS src_key, {URL} AS dst_key FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT {URL}, {_AT('40 - page_id % 41')} FROM pages WHERE page_id % 3 = 0)"
_LISTED = f"(SELECT {URL} AS loc, {URL} AS key, page_id AS pos FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT {_AT('n + k')}, {_AT('n + k')}, n + k FROM (SELECT count(*) AS n FROM pages), range(100, 110) t(k))"


def _crawled(spark, d) -> DataFrame:
    rows = facts(spark, d)
    return rows.select("url", F.expr(f"CASE WHEN {_HOPS} > 0 THEN {_FINAL} ELSE '' END").alias("final_url"), F.expr(_STATUS).alias("status"), F.lit("").alias("error"), (F.col("page_id") % 6).cast("int").alias("depth"), F.expr(_HOPS).alias("hops"), F.expr(_TYPE).alias("content_type"), "html", "facts")


def _sitemap(spark, d) -> DataFrame:
    """Every fifth page isn't listed; ten pages that aren't there are, and one on another host; each URL is listed again with a click identifier."""
    pages = table(spark, d, "pages").select("page_id")
    n = pages.count()
    rows = pages.where("page_id % 5 <> 0").select(F.expr(URL).alias("loc"), F.col("page_id").alias("pos"))
    more = spark.range(100, 110).select(F.concat(F.lit("https://m.example/p"), (F.col("id") + n).cast("string")).alias("loc"), (F.col("id") + n).alias("pos"))
    rows = rows.unionByName(more).unionByName(spark.range(1).select(F.lit("https://away.example/").alias("loc"), F.lit(-1).cast("long").alias("pos")))
    return rows.unionByName(rows.select(F.concat("loc", F.lit("?gclid=1")).alias("loc"), (F.col("pos") + 1_000_000_000).alias("pos")))


@query(f"SELECT key, final_key, status, is_html, noindex, title, canonical_key, text_hash <> '' AS has_text FROM {_SITE}")
def site_pages_parsed(spark, d):
    return site.from_facts(_crawled(spark, d)).select("key", "final_key", "status", "is_html", "noindex", "title", "canonical_key", (F.col("text_hash") != "").alias("has_text"))


@query(f"SELECT src_key, dst_key, 'link' AS kind FROM {_LINK} UNION SELECT src_key, dst_key, 'alternate' FROM {_ALTERNATE}")
def site_links_parsed(spark, d):
    rows = _crawled(spark, d)
    of = lambda df, kind: df.select("src_key", "dst_key", F.lit(kind).alias("kind"))
    return of(site.links_of(rows), "link").unionByName(of(site.alternates_of(rows), "alternate"))


@query(f"{with_(_SITE, _LINK, _ALTERNATE, _LISTED)} SELECT category, severity, url FROM ({ALL_ISSUES}) UNION ALL SELECT 'Blocked by robots', 'INFO', {_AT('page_id + 200000')} FROM pages WHERE page_id % 50 = 0")
def site_audit_parsed(spark, d):
    """From markup to issues: parse, resolve, join. Some links are held back by robots."""
    blocked = table(spark, d, "pages").where("page_id % 50 = 0").select(F.expr(_AT("page_id + 200000")).alias("url")).withColumn("key", F.col("url"))
    return site.site_audit(_crawled(spark, d), _sitemap(spark, d), robots_blocked=blocked).select("category", "severity", "url")


_AUDITS = {"technical": _expected(_TECHNICAL), "content": _expected({k: v for k, v in _CONTENT.items() if k not in ("R-C9", "R-C9b", "R-C10")}, f"(SELECT page_id, len({_WORDS}) AS units FROM pages)"), "images": _expected(_IMAGES)}


@query(" UNION ALL ".join(f"SELECT page_id, '{name}' AS audit, score, rules FROM ({sql})" for name, sql in _AUDITS.items()))
def audit_pages(spark, d):
    """All audits of a page by one entry point."""
    rows = api.audit_pages(markup(spark, d)).where("audit <> 'hreflang'")
    rows = rows.groupBy(F.regexp_extract("url", "p([0-9]+)$", 1).cast("long").alias("page_id"), "audit").agg(F.first("score").alias("score"), F.array_sort(F.collect_list("rule")).alias("r"))
    # in the order of the audit's table: by number, then by letter
    order = F.array_sort(F.transform("r", lambda r: F.named_struct(F.lit("n"), F.regexp_extract(r, "([0-9]+)", 1).cast("int"), F.lit("r"), r)))
    return rows.select("page_id", "audit", "score", F.array_join(F.transform(order, lambda x: x.r), " ").alias("rules"))


@query(f"SELECT page_id, CASE WHEN {CANONICAL} = '' THEN '' ELSE {_CANON_KEY.replace(_IS_HTML, 'TRUE')} END AS canonical, len({_WORDS}) >= 150 AS deep, CASE page_id % 3 WHEN 0 THEN 0 ELSE 2 END AS hits, page_id % 2 = 1 AS blocked FROM pages")
def registered_functions(spark, d):
    """The functions that SQL gets, used in SQL."""
    api.register(spark)
    markup(spark, d).createOrReplaceTempView("markup_pages")
    return spark.sql("""SELECT page_id, CASE WHEN f.canonical = '' THEN '' ELSE url_key(f.canonical, url) END AS canonical, size(split(trim(regexp_replace(folded_text(f.body_text), '[^a-z0-9]+', ' ')), ' ')) >= 150 AS deep,
        keyword_count(f.body_text, 'Zebra') AS hits, blocked_address(CASE WHEN page_id % 2 = 1 THEN '::1' ELSE '8.8.8.8' END) AS blocked FROM (SELECT page_id, url, page_facts(html) AS f FROM markup_pages)""")


@query(f"""WITH f AS ({' UNION ALL '.join(f"SELECT '{s}' AS severity, '{c}' AS category, {URL} AS url, CASE WHEN page_id % 2 = 0 THEN 'n ' || page_id ELSE '' END AS detail FROM pages WHERE {w}" for s, c, w in (('CRITICAL', 'Broken', 'page_id % 23 = 3'), ('INFO', 'Deep', 'page_id % 3 = 0'), ('WARNING', 'Thin', 'page_id % 5 = 0')))}),
 k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY url) AS k, count(*) OVER (PARTITION BY category) AS n FROM f)
 SELECT '[' || severity || '] ' || category || ' (' || count(*) || ')' AS line FROM f GROUP BY severity, category UNION ALL SELECT unnest([x for x in ['  - ' || url, CASE WHEN detail <> '' THEN '      ' || detail END] if x IS NOT NULL]) FROM k WHERE k <= 5
 UNION ALL SELECT DISTINCT '  … and ' || (n - 5) || ' more' FROM k WHERE n > 5 UNION ALL SELECT '  * blocked: ' || count(*) FROM pages""")
def console_report(spark, d):
    """A site's issues as lines of text, five pages each."""
    found = None
    for severity, category, when in (("CRITICAL", "Broken", "page_id % 23 = 3"), ("INFO", "Deep", "page_id % 3 = 0"), ("WARNING", "Thin", "page_id % 5 = 0")):
        rows = table(spark, d, "pages").where(when).select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.expr(URL).alias("url"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'n ' || page_id ELSE '' END").alias("detail"))
        found = rows if found is None else found.unionByName(rows)
    notes = table(spark, d, "pages").agg(F.count("*").alias("n")).select(F.lit("blocked").alias("note"), "n")
    return report.console(found, notes).select("line")


@query(f"""SELECT {URL} AS url, {TITLE} AS title, {DESCRIPTION} AS meta_description, {CANONICAL} AS canonical, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'One ' || page_id || '|Two' ELSE 'Head ' || page_id END AS h1,
 CASE page_id % 6 WHEN 1 THEN 'Article' WHEN 4 THEN 'HowTo|Person' WHEN 5 THEN 'FAQPage|Organization|WebSite' ELSE '' END AS schema_types, CAST(len({_WORDS}) AS BIGINT) AS word_count,
 CAST(CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE 2 END AS BIGINT) AS image_count, 2::BIGINT AS internal_links, 404 AS status_code, 7::BIGINT AS ttfb_ms FROM pages""")
def drift_capture_fields(spark, d):
    """A snapshot's fields from markup."""
    rows = drift.capture(facts(spark, d).withColumns({"status": F.lit(404), "ttfb_ms": F.lit(7)}), "2026-01-01")
    join = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("url", "title", "meta_description", "canonical", join("h1"), join("schema_types"), "word_count", "image_count", "internal_links", "status_code", "ttfb_ms")


@query("SELECT count(*) FILTER (WHERE page_id % 12 = 5) AS elsewhere FROM pages")
def header_other_host(spark, d):
    """R-H8: answers that come from another host than the one asked."""
    other = F.when(F.col("page_id") % 12 == 5, F.concat(F.lit("https://www."), F.substring("url", 9, 1000))).otherwise(F.col("url"))
    rows = markup(spark, d).select("page_id", F.col("url").alias("requested_url"), other.alias("final_url"), F.lit(200).alias("status"), F.create_map().cast("map<string,array<string>>").alias("headers"), F.array().cast("array<struct<url:string,status:int>>").alias("redirects"), F.lit(1).alias("ttfb_ms"))
    return rules.issues(rules.headers(rows), "page_id").where("rule = 'R-H8'").agg(F.count("*").alias("elsewhere"))


@query(f"SELECT page_id, CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS shade, CAST(score AS VARCHAR) AS score, CASE WHEN rules = '' THEN 0 ELSE len(string_split(rules, ' ')) END AS findings FROM ({_expected(_TECHNICAL)})")
def html_report_findings(spark, d):
    """What the pages' rendered reports show."""
    rows = rules.technical(facts(spark, d))
    page = rows.select("page_id", report.technical_report(F.col("url"), F.col("score"), F.col("issues")).alias("html"))
    cell = lambda k: F.regexp_extract("html", '<td class="(good|fair|poor)">([0-9]+)', k)
    return page.select("page_id", cell(1).alias("shade"), cell(2).alias("score"), F.regexp_count("html", F.lit("<tr><td>")).cast("long").alias("findings"))
