"""Checks across pages of a site, as joins, anti-joins and aggregates.

Pages: url, key, final_key (of the landing URL), status, error, depth, hops, is_html, noindex, title, description,
text_hash, canonical, canonical_key ('' without one). Links: src_key, dst_key. Alternates: src_key, dst_key.
Sitemap: loc, key, pos (its place in the list). Each check gives (url, detail); `issues` unites them with severity
and category. No check brings a group of unbounded size to one task: counts are aggregated before they are
shuffled, and the few members that a report names are picked by rank, of which each task keeps the first ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.functions import urls as U
from auditmill.operators.crawl import _cut

BLOCKED = (401, 403, 429, 503)
#: Samples that a report names: affected pages of an issue, referrers of a page.
AFFECTED, REFERRERS = 20, 3
SEVERITY = {
    "Broken links": "CRITICAL", "Linked redirects": "WARNING", "Redirect chains": "WARNING", "Missing title": "CRITICAL", "Missing description": "WARNING",
    "Duplicate title": "WARNING", "Duplicate description": "WARNING", "Duplicate text": "WARNING", "Canonical not 200": "CRITICAL", "Canonical noindex": "CRITICAL",
    "Canonical redirects": "WARNING", "Canonical elsewhere": "INFO", "Hreflang not 200": "WARNING", "Hreflang one-way": "WARNING", "Sitemap not 200": "WARNING",
    "Sitemap redirect": "WARNING", "Sitemap noindex": "WARNING", "Sitemap canonicalised": "WARNING", "Missing from sitemap": "INFO", "Orphans": "WARNING", "Deep pages": "INFO", "Blocked by robots": "INFO",
}


def broken() -> Column:
    return (F.col("error") != "") | ((F.col("status") >= 400) & ~F.col("status").isin(*BLOCKED))


def verified() -> Column:
    """Whether the answer says anything of the page."""
    return ~((F.col("error") == "") & F.col("status").isin(*BLOCKED))


def indexable() -> Column:
    own = (F.col("canonical_key") == "") | (F.col("canonical_key") == F.col("final_key"))
    return (F.col("error") == "") & (F.col("status") == 200) & F.col("is_html") & ~F.col("noindex") & own


def first_few(rows: DataFrame, by: list[str], value: str, k: int, name: str) -> DataFrame:
    """by, name: the first k values of each group in order. The rank's limit holds within tasks, before anything is shuffled."""
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(value))).where(F.col("_n") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def one_per_key(pages: DataFrame) -> DataFrame:
    """Of pages with one key the last by URL."""
    rest = [c for c in pages.columns if c != "key"]
    return pages.groupBy("key").agg(F.max_by(F.struct(*rest), "url").alias("p")).select("key", "p.*")


def in_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """key, in_links, referrers: distinct pages that link to each page, without itself, and the first few of them."""
    known = pages.select(F.col("key").alias("dst_key")).distinct()
    pairs = links.where("src_key <> dst_key").select("src_key", "dst_key").distinct().join(known, "dst_key", "left_semi")
    counts = pairs.groupBy("dst_key").agg(F.count("*").alias("in_links"))
    return counts.join(first_few(pairs, ["dst_key"], "src_key", REFERRERS, "referrers"), "dst_key").withColumnRenamed("dst_key", "key")


_TARGET = ("url", "status", "error", "noindex", "final_key", "key", "hops", "is_html")


def lookup(pages: DataFrame) -> DataFrame:
    """at -> the page a URL key leads to: the one requested there, else the first whose redirect landed there (landing)."""
    asked = one_per_key(pages).select(F.col("key").alias("at"), *_TARGET, F.lit(False).alias("landing"))
    landed = pages.where("hops > 0").groupBy(F.col("final_key").alias("at")).agg(F.min_by(F.struct(*_TARGET), "url").alias("p"))
    landed = landed.join(asked.select("at"), "at", "left_anti")
    return asked.unionByName(landed.select("at", "p.*", F.lit(True).alias("landing")))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Pages that aren't redirects to a page known already: pages without redirects, and the first redirect to each other landing URL."""
    if "_distinct" not in pages.columns:
        pages = with_distinct(pages)
    return pages.where("_distinct").drop("_distinct")


def with_distinct(pages: DataFrame) -> DataFrame:
    """pages with _distinct: whether the page is one of `distinct_pages`. Pages without a landing key aren't."""
    first = pages.groupBy(F.col("final_key").alias("_at")).agg(F.min(F.struct(F.col("hops") > 0, "url")).alias("_first"))
    own = F.col("_at").isNotNull() & ((F.col("hops") == 0) | (F.struct(F.col("hops") > 0, "url") == F.col("_first")))
    return pages.join(first, pages.final_key == first["_at"], "left").withColumn("_distinct", F.coalesce(own, F.lit(False))).drop("_at", "_first")


def _url(df: DataFrame, detail: Column | str = "") -> DataFrame:
    return df.select("url", (detail if isinstance(detail, Column) else F.lit(detail)).cast("string").alias("detail"))


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    return _url(pages.where(broken()).join(in_links(pages, links), "key"), F.concat_ws(" ", "status", "in_links"))


def linked_redirects(pages: DataFrame, links: DataFrame) -> DataFrame:
    return _url(pages.where("depth > 0 and hops >= 1").join(in_links(pages, links), "key"), F.col("in_links"))


def redirect_chains(pages: DataFrame) -> DataFrame:
    return _url(pages.where("hops >= 2"), F.col("hops"))


def missing(pages: DataFrame, column: str) -> DataFrame:
    return _url(distinct_pages(pages).where(indexable() & (F.col(column) == "")))


def duplicates(pages: DataFrame, column: str, fold: bool = True) -> DataFrame:
    """value, pages, first, others: pages that share a value, the first URL and up to three more."""
    rows = distinct_pages(pages).where(indexable() & (F.col(column) != ""))
    rows = rows.select((F.lower(F.trim(column)) if fold else F.col(column)).alias("value"), "url")
    out = rows.groupBy("value").agg(F.count("*").alias("pages")).where("pages > 1").join(first_few(rows, ["value"], "url", 4, "u"), "value")
    return out.select("value", "pages", F.get("u", F.lit(0)).alias("first"), F.array_join(F.slice("u", 2, 3), " ").alias("others"))


def canonical_kinds(pages: DataFrame) -> DataFrame:
    """url, canonical, canonical_key, kind of each page's canonical that isn't itself: not-200, noindex, redirects, elsewhere, unverified, fine.

    A target that redirects and forbids indexing gives two rows. Pages that forbid indexing aren't looked at.
    """
    rows = distinct_pages(pages).where((F.col("error") == "") & (F.col("status") == 200) & F.col("is_html") & ~F.col("noindex") & (F.col("canonical_key") != "") & (F.col("canonical_key") != F.col("final_key")))
    target = lookup(pages).select(F.struct("at", "status", "error", "noindex", "hops", "landing").alias("t"))
    rows = rows.select("url", "canonical", "canonical_key", "final_key").join(target, F.col("canonical_key") == F.col("t.at"), "left")
    other = U.host_of(F.col("canonical_key")) != U.host_of(F.col("final_key"))
    unknown = F.col("t").isNull() | ((F.col("t.error") == "") & F.col("t.status").isin(*BLOCKED))
    both = F.filter(F.array(F.when(~F.col("t.landing") & (F.col("t.hops") > 0), "redirects"), F.when(F.col("t.noindex"), "noindex")), lambda k: k.isNotNull())
    one = lambda k: F.array(F.lit(k))
    kinds = (
        F.when(other, one("elsewhere")).when(unknown, one("unverified")).when((F.col("t.error") != "") | (F.col("t.status") != 200), one("not-200"))
        .when(F.size(both) > 0, both).otherwise(one("fine"))
    )
    return rows.select("url", "canonical", "canonical_key", F.explode(kinds).alias("kind"))


def alternate_kinds(pages: DataFrame, alternates: DataFrame) -> DataFrame:
    """src_key, dst_key, kind, dst_url: not-200, one-way, unverified, fine.

    Alternates of indexable, distinct pages count, each pair once, and none to the page itself or to where it landed.
    A target links back if one of its alternates is the page or where the page landed.
    """
    own = distinct_pages(pages).where(indexable()).select(F.col("key").alias("src_key"), "final_key")
    pairs = alternates.select("src_key", "dst_key").distinct().join(own, "src_key").where("dst_key <> src_key and dst_key <> final_key")
    target = lookup(pages).select(F.struct("at", "status", "error", "key", "is_html", "url").alias("t"))
    pairs = pairs.join(target, F.col("dst_key") == F.col("t.at"), "left")
    back = alternates.select(F.col("src_key").alias("_from"), F.col("dst_key").alias("_to")).distinct()
    asked = pairs.select("src_key", "dst_key", F.col("t.key").alias("_from"), F.explode(F.array_distinct(F.array("src_key", "final_key"))).alias("_to"))
    linked = asked.join(back, ["_from", "_to"], "left_semi").select("src_key", "dst_key").distinct().withColumn("back", F.lit(True))
    pairs = pairs.join(linked, ["src_key", "dst_key"], "left")
    unknown = F.col("t").isNull() | ((F.col("t.error") == "") & F.col("t.status").isin(*BLOCKED))
    kind = (
        F.when(unknown, "unverified").when((F.col("t.error") != "") | (F.col("t.status") != 200), "not-200")
        .when(F.col("t.is_html") & F.col("back").isNull(), "one-way").otherwise("fine")
    )
    return pairs.select("src_key", "dst_key", kind.alias("kind"), F.col("t.url").alias("dst_url"))


def sitemap_kinds(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """loc, kind of listed pages: not-200, redirect, noindex, canonicalised, fine; the first that holds."""
    rows = sitemap.join(one_per_key(pages), "key").where(verified())
    away = F.col("is_html") & (F.col("canonical_key") != "") & (F.col("canonical_key") != F.col("final_key"))
    kind = F.when((F.col("error") != "") | (F.col("status") != 200), "not-200").when(F.col("hops") > 0, "redirect").when(F.col("noindex"), "noindex").when(away, "canonicalised").otherwise("fine")
    return rows.select("loc", kind.alias("kind"))


def not_listed(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    rows = distinct_pages(pages).where(indexable())
    rows = rows.join(sitemap.select("key"), "key", "left_anti").join(sitemap.select(F.col("key").alias("final_key")), "final_key", "left_anti")
    return _url(rows)


def orphans(pages: DataFrame, links: DataFrame, sitemap: DataFrame, robots_blocked: DataFrame | None = None) -> DataFrame:
    """Listed URLs that no page reaches: neither visited, nor landed on, nor linked, nor held back by robots."""
    reached = pages.select("key").union(pages.select("final_key")).union(links.select("dst_key"))
    if robots_blocked is not None:
        reached = reached.union(robots_blocked.select("key"))
    rows = sitemap.where(U.crawlable_path(U.parts(F.col("loc"))["path"])).join(reached.distinct(), "key", "left_anti")
    return rows.select(F.col("loc").alias("url"), F.lit("").alias("detail"))


def deep(pages: DataFrame) -> DataFrame:
    return _url(distinct_pages(pages).where(indexable() & (F.col("depth") > 3)), F.col("depth"))


def _page_issues(pages: DataFrame) -> DataFrame:
    """category, url, detail of the checks that one row of pages (with _distinct and _in, its in-links) decides: one pass for all."""
    own = F.col("_distinct") & indexable()
    checks = {
        "Broken links": (broken() & F.col("_in").isNotNull(), F.concat_ws(" ", "status", "_in")),
        "Linked redirects": ((F.col("depth") > 0) & (F.col("hops") >= 1) & F.col("_in").isNotNull(), F.col("_in")),
        "Redirect chains": (F.col("hops") >= 2, F.col("hops")),
        "Missing title": (own & (F.col("title") == ""), F.lit("")),
        "Missing description": (own & (F.col("description") == ""), F.lit("")),
        "Deep pages": (own & (F.col("depth") > 3), F.col("depth")),
    }
    cells = [F.when(holds, F.struct(F.lit(c).alias("category"), detail.cast("string").alias("detail"))) for c, (holds, detail) in checks.items()]
    rows = pages.select("url", F.explode(F.array_compact(F.array(*cells))).alias("i"))
    return rows.select("i.category", "url", "i.detail")


def _shared_values(pages: DataFrame) -> DataFrame:
    """category, url, detail of values that distinct pages share (see `duplicates`): one aggregate for titles, descriptions and texts."""
    values = {"Duplicate title": ("title", True), "Duplicate description": ("description", True), "Duplicate text": ("text_hash", False)}
    value = lambda c, fold: F.lower(F.trim(c)) if fold else F.col(c)
    cells = [F.when(F.col(c) != "", F.struct(F.lit(name).alias("category"), value(c, fold).alias("value"))) for name, (c, fold) in values.items()]
    rows = distinct_pages(pages).where(indexable()).select("url", F.explode(F.array_compact(F.array(*cells))).alias("v")).select("v.category", "v.value", "url")
    by = ["category", "value"]
    out = rows.groupBy(*by).agg(F.count("*").alias("pages")).where("pages > 1").join(first_few(rows, by, "url", 4, "u"), by)
    return out.select("category", F.get("u", F.lit(0)).alias("url"), F.concat_ws(" ", "pages", F.array_join(F.slice("u", 2, 3), " ")).alias("detail"))


#: The category of each kind that a check of targets gives.
_CANONICAL = {"not-200": "Canonical not 200", "noindex": "Canonical noindex", "redirects": "Canonical redirects", "elsewhere": "Canonical elsewhere"}
_ALTERNATE = {"not-200": "Hreflang not 200", "one-way": "Hreflang one-way"}
_LISTED = {"not-200": "Sitemap not 200", "redirect": "Sitemap redirect", "noindex": "Sitemap noindex", "canonicalised": "Sitemap canonicalised"}


def _of_kinds(rows: DataFrame, categories: dict[str, str], url: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    return rows.where(F.col("kind").isin(*categories)).select(F.try_element_at(named, F.col("kind")).alias("category"), F.col(url).alias("url"), F.lit("").alias("detail"))


def issues(pages: DataFrame, links: DataFrame, alternates: DataFrame, sitemap: DataFrame, sitemap_complete: bool = True, truncated: bool = False, robots_blocked: DataFrame | None = None) -> DataFrame:
    """category, severity, url, detail of every check. Checks that an incomplete sitemap or crawl makes unsound aren't run.

    Of the sitemap, URLs on hosts that the crawl has seen count, the first listed of each key. robots_blocked
    (url, key): internal links that robots.txt disallows.
    """
    # the checks read one table of pages with what several of them ask, so that it is worked out once
    links, alternates = _cut(links), _cut(alternates)
    pages = _cut(pages)
    inside = in_links(pages, links).select(F.col("key").alias("_key"), F.col("in_links").alias("_in"))
    pages = _cut(with_distinct(pages).join(inside, F.col("key") == F.col("_key"), "left").drop("_key"))
    sitemap = _cut(on_site(sitemap, pages))
    one = lambda df, category: df.select(F.lit(category).alias("category"), "url", "detail")
    found = [
        _page_issues(pages), _shared_values(pages), _of_kinds(canonical_kinds(pages), _CANONICAL, "url"), _of_kinds(alternate_kinds(pages, alternates), _ALTERNATE, "dst_url").distinct(),
        _of_kinds(sitemap_kinds(pages, sitemap), _LISTED, "loc"),
    ]
    if sitemap_complete:
        found.append(one(not_listed(pages, sitemap), "Missing from sitemap"))
    if not truncated:
        found.append(one(orphans(pages, links, sitemap, robots_blocked), "Orphans"))
    if robots_blocked is not None:
        found.append(one(robots_blocked.select("url", F.lit("").alias("detail")), "Blocked by robots"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return out.select("category", F.try_element_at(severity, F.col("category")).alias("severity"), "url", "detail")


def on_site(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """The sitemap's rows on hosts of pages, requested or landed on; of each key the first listed."""
    hosts = pages.select(F.explode(F.array("key", "final_key")).alias("u")).select(U.host_of(F.col("u")).alias("_host")).distinct()
    rows = sitemap.withColumn("_host", U.host_of(F.col("key"))).join(hosts, "_host", "left_semi")
    return rows.groupBy("key").agg(F.min_by("loc", "pos").alias("loc"), F.min("pos").alias("pos"))


def summary(found: DataFrame, affected: int = AFFECTED) -> DataFrame:
    """severity, category, affected, sample: each issue once, the worst first, with its first few pages."""
    few = first_few(found, ["category"], "url", affected, "s").select("category", F.array_join("s", " ").alias("sample"))
    out = found.groupBy("severity", "category").agg(F.count("*").alias("affected")).join(few, "category").select("severity", "category", "affected", "sample")
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return out.orderBy(rank, F.desc("affected"), "category")


def notes(pages: DataFrame, sitemap: DataFrame, truncated: bool = False) -> DataFrame:
    """One row of counts that qualify a report: pages, blocked answers, listed URLs."""
    blocked = F.count_if((F.col("error") == "") & F.col("status").isin(*BLOCKED))
    return pages.agg(F.count("*").alias("pages"), blocked.alias("blocked")).join(sitemap.agg(F.count("*").alias("listed"))).withColumn("truncated", F.lit(truncated))


def all_notes(pages: DataFrame, alternates: DataFrame, sitemap: DataFrame, sitemap_complete: bool = True, truncated: bool = False) -> DataFrame:
    """note, n: what qualifies the issues, a row for each note that holds.

    no-pages; start-failed (pages at depth 0 that failed); blocked (answers that say nothing of a page);
    canonical-unverified, hreflang-unverified (distinct targets that weren't crawled or were blocked);
    sitemap-elsewhere (a sitemap that lists nothing on the crawled hosts: its listed URLs);
    missing-unchecked (pages that an incomplete sitemap doesn't list); orphans-unchecked and truncated (a crawl cut short).
    """
    here = on_site(sitemap, pages)
    bound = F.lit(truncated)
    one = lambda df, note, n: df.agg(n.alias("n")).select(F.lit(note).alias("note"), F.col("n").cast("long"))
    per_page = pages.agg(
        (F.count("*") == 0).cast("int").alias("no-pages"), F.count_if((F.col("depth") == 0) & ((F.col("error") != "") | (F.col("status") >= 400))).alias("start-failed"),
        F.count_if((F.col("error") == "") & F.col("status").isin(*BLOCKED)).alias("blocked"), F.when(bound, 1).otherwise(0).alias("truncated"),
    )
    names = F.array(*[F.struct(F.lit(c).alias("note"), F.col(f"`{c}`").cast("long").alias("n")) for c in ("no-pages", "start-failed", "blocked", "truncated")])
    out = per_page.select(F.explode(names).alias("x")).select("x.*")
    out = out.unionByName(one(canonical_kinds(pages).where("kind = 'unverified'"), "canonical-unverified", F.count_distinct("canonical_key")))
    out = out.unionByName(one(alternate_kinds(pages, alternates).where("kind = 'unverified'"), "hreflang-unverified", F.count_distinct("dst_key")))
    listed = sitemap.agg(F.count("*").alias("n")).join(here.agg(F.count("*").alias("m")))
    out = out.unionByName(listed.select(F.lit("sitemap-elsewhere").alias("note"), F.when(F.col("m") == 0, F.col("n")).otherwise(0).alias("n")))
    out = out.unionByName(listed.select(F.lit("orphans-unchecked").alias("note"), F.when(bound & (F.col("m") > 0), 1).otherwise(0).cast("long").alias("n")))
    if not sitemap_complete:
        out = out.unionByName(one(not_listed(pages, here).join(here.limit(1).select(F.lit(1).alias("_"))), "missing-unchecked", F.count("*")))
    return out.where("n > 0")


def from_facts(parsed: DataFrame) -> DataFrame:
    """Site pages from fetched and parsed ones: url, final_url, status, error, depth, hops, content_type, html, facts."""
    from auditmill.functions import text as T

    html = F.lower(F.trim(F.split("content_type", ";")[0]))
    sniff = F.lower(F.ltrim(F.substring("html", 1, 512))).rlike("^(<!doctype html|<html)")
    is_html = F.when(F.coalesce("content_type", F.lit("")) == "", sniff).otherwise(html.isin("text/html", "application/xhtml+xml"))
    rows = parsed.select(
        "url", landing().alias("at"), "status", "error", "depth", "hops", is_html.alias("is_html"), F.col("facts.noindex").alias("noindex"), F.col("facts.crawl_title").alias("title"),
        F.col("facts.description").alias("description"), T.text_hash(F.col("facts.visible_text")).alias("text_hash"), F.coalesce("facts.canonical", F.lit("")).alias("href"),
    )
    # step by step: an expression over URLs is long, and would be written out wherever it is named
    rows = rows.withColumn("canonical", F.when((F.col("href") == "") | ~F.col("is_html"), "").otherwise(U.resolve(F.col("at"), F.col("href")))).drop("href")
    keys = {"key": U.key_absolute(F.col("url")), "final_key": U.key_absolute(F.col("at")), "canonical_key": F.when(F.col("canonical") == "", "").otherwise(U.key_absolute(F.col("canonical")))}
    return rows.withColumns(keys).drop("at")


def landing():
    """The URL that a page was read from: where its redirects landed, or its own."""
    return F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))


def _resolved(rows: DataFrame) -> DataFrame:
    """rows (url, at, href) -> src_key, dst, dst_key."""
    rows = rows.select("url", "at", U.resolve(F.col("at"), F.col("href")).alias("dst"))
    return rows.select(U.key_absolute(F.col("url")).alias("src_key"), U.key_absolute(F.col("dst")).alias("dst_key"), "at", "dst")


def links_of(parsed: DataFrame) -> DataFrame:
    """src_key, dst_key of a site's own links: same host, resolved against the page, once each; pages that didn't answer have none."""
    rows = parsed.where("status = 200 and error = ''").select("url", landing().alias("at"), F.explode("facts.anchors").alias("href"))
    rows = _resolved(rows)
    return rows.where(U.same_origin(F.col("dst"), U.host_of(F.col("at")))).select("src_key", "dst_key").distinct()


def alternates_of(parsed: DataFrame) -> DataFrame:
    """src_key, dst_key of a site's alternate-language links, resolved against the page."""
    rows = parsed.select("url", landing().alias("at"), F.explode("facts.hreflang").alias("h")).select("url", "at", F.col("h.href").alias("href"))
    return _resolved(rows).select("src_key", "dst_key").distinct()


def site_audit(parsed: DataFrame, sitemap: DataFrame, sitemap_complete: bool = True, truncated: bool = False, robots_blocked: DataFrame | None = None) -> DataFrame:
    """The issues of a crawled site from its parsed pages (see `from_facts`) and its sitemap (loc, pos).

    Pages, links and alternates are read by many checks, so they are made once: the parsed rows that they need
    are cut off from the parser, and so are they.
    """
    parsed = _cut(parsed.select("url", "final_url", "status", "error", "depth", "hops", "content_type", F.substring("html", 1, 512).alias("html"), "facts"))
    listed = sitemap.select("loc", U.key_absolute(F.col("loc")).alias("key"), "pos")
    return issues(from_facts(parsed), links_of(parsed), alternates_of(parsed), listed, sitemap_complete, truncated, robots_blocked)
