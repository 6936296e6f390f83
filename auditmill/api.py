"""Entry points by task: pages, sites, headers, robots files, sitemaps, structured data, changes, reports; and functions for SQL.

    import auditmill.api as api
    api.audit_pages(pages)             # a row a page, audit and finding
    api.site_audit(crawled, sitemap)   # a row an issue and page
    api.lint_jsonld(blocks, "file")    # a row a file: findings and whether the gate stops it
    api.audit_headers(fetches)         # a row a fetch and finding
    api.robots(files)                  # a row a site and known crawler
    api.sitemaps(roots, files)         # a row a listed URL, and of each root whether all was read
    api.changes(pages, store)          # a row a page and field that isn't what the newest snapshot has
    api.report(issues)                 # a row an issue, the worst first
    api.register(spark)                # url_key(url, base), keyword_count(text, keyword), ... in SQL
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.functions import urls as U
from auditmill.operators import drift, jsonld, rules, site
from auditmill.sources import fetch, html, snapshots
from auditmill.sources import robots as robot_files
from auditmill.sources import sitemap as maps

#: Functions that SQL has no other form for, by the name under which `register` makes them known.
FUNCTIONS = {"url_key": U.key, "normalize_url": U.normalize, "keyword_count": T.count_keyword, "folded_text": T.fold, "blocked_address": U.blocked_address, "decoded_body": fetch.decoded, "page_facts": html.parse_page, "jsonld_findings": jsonld.findings}


def register(spark: SparkSession) -> list[str]:
    """Makes the Arrow functions known to the session's SQL; gives their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)


def audit_pages(pages: DataFrame, keyword: str | None = None) -> DataFrame:
    """pages (url, html) -> url, audit, score, rule, severity, category, message, details: every finding of every page audit.

    A page is parsed once; an audit without findings gives one row without a rule, so that its score is seen.
    """
    facts = html.parsed(pages.select("url", "html"))
    audits = {"technical": rules.technical, "content": lambda df: rules.content(df, keyword), "images": rules.images, "hreflang": rules.hreflang}
    cells = None
    for name, audit in audits.items():
        # columns that one audit adds are dropped before the next, so that names can't meet
        held = ["url", "facts"] + ([] if cells is None else ["found"])
        df = audit(facts if cells is None else cells)
        one = F.struct(F.lit(name).alias("audit"), "score", "issues")
        found = F.array(one) if cells is None else F.concat("found", F.array(one))
        cells = df.select(*[c for c in held if c != "found"], found.alias("found"))
    rows = cells.select("url", F.explode("found").alias("a")).select("url", "a.audit", "a.score", F.explode_outer("a.issues").alias("i"))
    return rows.select("url", "audit", "score", "i.rule", "i.severity", "i.category", "i.message", "i.details")


def site_audit(crawled: DataFrame, sitemap: DataFrame, **options) -> DataFrame:
    """crawled (url, final_url, status, error, depth, hops, content_type, html), sitemap (loc, pos) -> category, severity, url, detail. For options see `site.issues`."""
    return site.site_audit(html.parsed(crawled), sitemap, **options)


def lint_jsonld(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, raw) -> key, block, warn, blocked."""
    return jsonld.lint_verdict(blocks, key)


def audit_headers(fetches: DataFrame) -> DataFrame:
    """fetches (url, final_url, status, headers, redirects, ttfb_ms; as the web source gives them) -> url, rule, severity, category, message, details."""
    rows = fetches.withColumnRenamed("url", "requested_url").withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))
    rows = rules.headers(rows).select(F.col("requested_url").alias("url"), F.explode("issues").alias("i"))
    return rows.select("url", "i.rule", "i.severity", "i.category", "i.message", "i.details")


def robots(files: DataFrame) -> DataFrame:
    """files (site, body) -> site, bot, label, status: what each site's robots file lets known crawlers do."""
    return robot_files.policy(files)


def sitemaps(roots: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots (file), files (file, body) -> the URLs that all files below the roots list (file, pos, loc, lastmod, ...), and one row on whether all was read."""
    walked = maps.tree(roots, files)
    read = walked.where("error = ''").select("file", "path")
    return maps.urls(files.join(read.select("file"), "file", "left_semi")).join(read, "file"), maps.complete(walked)


def changes(pages: DataFrame, store: str, at: str | None = None) -> DataFrame:
    """pages (url, html, status, ttfb_ms) -> url, field, before, after, significant against each page's newest file in the folder `store`.

    Pages without a snapshot give no row. at: when the pages were read, now unless told otherwise.
    """
    now = drift.capture(html.parsed(pages.select("url", "html", "status", "ttfb_ms")), F.current_timestamp() if at is None else at)
    past = snapshots.history(snapshots.read(pages.sparkSession, store), pages)
    past = drift.latest(past.drop("url_key", "url", "taken").withColumnRenamed("page", "url_key"))
    # both sides by the URL that was asked for, whichever key its files have
    found = drift.compare(now.withColumn("url_key", F.col("url")), past)
    return found.withColumnRenamed("url_key", "url")


def report(found: DataFrame) -> DataFrame:
    """Issues (category, severity, url, detail) -> severity, category, affected, sample; the worst first."""
    return site.summary(found)
