"""Checks across pages, crawling and sitemaps, on a site derived from the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill.operators import crawl, site
from auditmill.plans import site_fixture as X
from auditmill.plans.registry import query, table
from auditmill.sources import robots, sitemap

def with_(site: str, link: str, alternate: str, listed: str) -> str:
    """Tables that the checks' SQL reads: the site's own, and what follows from them."""
    return f"""WITH site AS {site}, link AS {link}, alternate AS {alternate}, sitemap AS {listed}
, ins AS (SELECT dst_key AS key, count(*) AS in_links, list_sort(list(src_key))[1:3] AS referrers FROM (SELECT DISTINCT src_key, dst_key FROM link WHERE src_key <> dst_key AND dst_key IN (SELECT key FROM site)) GROUP BY dst_key)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY final_key ORDER BY CASE WHEN hops > 0 THEN 1 ELSE 0 END, url) AS rn FROM site)
, uniq AS (SELECT * FROM ranked WHERE hops = 0 OR rn = 1)
, good AS (SELECT * FROM uniq WHERE status = 200 AND is_html AND NOT noindex AND (canonical_key = '' OR canonical_key = final_key))
, landed AS (SELECT *, row_number() OVER (PARTITION BY final_key ORDER BY url) AS ln FROM site WHERE hops > 0)
, look AS (SELECT key AS at, url, status, noindex, final_key, hops, key, is_html, false AS landing FROM site UNION ALL SELECT final_key, url, status, noindex, final_key, hops, key, is_html, true FROM landed WHERE ln = 1 AND final_key NOT IN (SELECT key FROM site))"""


_WITH = with_(X.SITE, X.LINK, X.ALTERNATE, X.SITEMAP)
_BROKEN = "status >= 400 AND status NOT IN (401, 403, 429, 503)"


def _in(spark, d):
    return X.site(spark, d), X.link(spark, d)


@query(f"{_WITH} SELECT key, in_links, array_to_string(referrers, ' ') AS referrers FROM ins")
def in_link_counts(spark, d):
    return site.in_links(*_in(spark, d)).select("key", "in_links", F.array_join("referrers", " ").alias("referrers"))


@query(f"{_WITH} SELECT url, status || ' ' || in_links AS detail FROM site JOIN ins USING (key) WHERE {_BROKEN}")
def broken_links(spark, d):
    return site.broken_links(*_in(spark, d))


@query(f"{_WITH} SELECT url, CAST(in_links AS VARCHAR) AS detail FROM site JOIN ins USING (key) WHERE depth > 0 AND hops >= 1")
def redirect_links(spark, d):
    return site.linked_redirects(*_in(spark, d))


@query(f"{_WITH} SELECT url, CAST(hops AS VARCHAR) AS detail FROM site WHERE hops >= 2")
def redirect_chains(spark, d):
    return site.redirect_chains(X.site(spark, d))


@query(f"{_WITH} SELECT url, 'title' AS missing FROM good WHERE title = '' UNION ALL SELECT url, 'description' FROM good WHERE description = ''")
def missing_meta(spark, d):
    p = X.site(spark, d)
    return site.missing(p, "title").select("url", F.lit("title").alias("missing")).union(site.missing(p, "description").select("url", F.lit("description").alias("missing")))


_DUP = lambda c, v: f"SELECT '{c}' AS field, {v} AS value, count(*) AS pages, min(url) AS first, array_to_string(list_sort(list(url))[2:4], ' ') AS others FROM good WHERE {c} <> '' GROUP BY value HAVING count(*) > 1"


@query(f"{_WITH} {_DUP('title', 'lower(title)')} UNION ALL {_DUP('description', 'lower(description)')} UNION ALL {_DUP('text_hash', 'text_hash')}")
def duplicate_groups(spark, d):
    p = X.site(spark, d)
    of = lambda c, fold: site.duplicates(p, c, fold).select(F.lit(c).alias("field"), "value", "pages", "first", "others")
    return of("title", True).union(of("description", True)).union(of("text_hash", False))


_CANON = """SELECT url, canonical, unnest(CASE WHEN regexp_extract(canonical_key, '://([^/]*)', 1) <> regexp_extract(final_key, '://([^/]*)', 1) THEN ['elsewhere'] WHEN t_at IS NULL OR t_status IN (401, 403, 429, 503) THEN ['unverified'] WHEN t_status <> 200 THEN ['not-200']
  WHEN (NOT landing AND t_hops > 0) AND t_noindex THEN ['redirects', 'noindex'] WHEN NOT landing AND t_hops > 0 THEN ['redirects'] WHEN t_noindex THEN ['noindex'] ELSE ['fine'] END) AS kind
 FROM (SELECT u.url, u.canonical, u.canonical_key, u.final_key, l.at AS t_at, l.status AS t_status, l.hops AS t_hops, l.noindex AS t_noindex, l.landing FROM uniq u LEFT JOIN look l ON l.at = u.canonical_key WHERE u.status = 200 AND u.is_html AND NOT u.noindex AND u.canonical_key <> '' AND u.canonical_key <> u.final_key)"""


@query(f"{_WITH} {_CANON}")
def canonical_audit(spark, d):
    return site.canonical_kinds(X.site(spark, d)).drop("canonical_key")


_ALT = """SELECT a.src_key, a.dst_key, CASE WHEN l.key IS NULL OR l.status IN (401, 403, 429, 503) THEN 'unverified' WHEN l.status <> 200 THEN 'not-200' WHEN l.is_html AND NOT EXISTS (SELECT 1 FROM alternate b WHERE b.src_key = l.key AND (b.dst_key = a.src_key OR b.dst_key = a.final_key)) THEN 'one-way' ELSE 'fine' END AS kind, l.url AS dst_url
 FROM (SELECT DISTINCT t.src_key, t.dst_key, g.final_key FROM alternate t JOIN good g ON g.key = t.src_key WHERE t.src_key <> t.dst_key AND t.dst_key <> g.final_key) a LEFT JOIN look l ON l.at = a.dst_key"""


@query(f"{_WITH} {_ALT}")
def hreflang_reciprocity(spark, d):
    return site.alternate_kinds(X.site(spark, d), X.alternate(spark, d))


_LISTED = """SELECT loc, CASE WHEN status <> 200 THEN 'not-200' WHEN hops > 0 THEN 'redirect' WHEN noindex THEN 'noindex' WHEN is_html AND canonical_key <> '' AND canonical_key <> final_key THEN 'canonicalised' ELSE 'fine' END AS kind FROM sitemap JOIN site USING (key) WHERE status NOT IN (401, 403, 429, 503)"""


@query(f"{_WITH} {_LISTED}")
def sitemap_listed_problems(spark, d):
    return site.sitemap_kinds(X.site(spark, d), X.sitemap(spark, d))


@query(f"{_WITH} SELECT url FROM good WHERE key NOT IN (SELECT key FROM sitemap) AND final_key NOT IN (SELECT key FROM sitemap)")
def sitemap_missing(spark, d):
    return site.not_listed(X.site(spark, d), X.sitemap(spark, d)).select("url")


@query(f"{_WITH} SELECT loc AS url FROM sitemap WHERE key NOT IN (SELECT key FROM site UNION ALL SELECT final_key FROM site UNION ALL SELECT dst_key FROM link)")
def orphans(spark, d):
    return site.orphans(*_in(spark, d), X.sitemap(spark, d)).select("url")


@query(f"{_WITH} SELECT url, CAST(depth AS VARCHAR) AS detail FROM good WHERE depth > 3")
def deep_pages(spark, d):
    return site.deep(X.site(spark, d))


@query(f"{_WITH} SELECT url FROM uniq")
def distinct_landing(spark, d):
    return site.distinct_pages(X.site(spark, d)).select("url")


ALL_ISSUES = f"""SELECT 'CRITICAL' AS severity, 'Broken links' AS category, url FROM site JOIN ins USING (key) WHERE {_BROKEN}
 UNION ALL SELECT 'WARNING', 'Linked redirects', url FROM site JOIN ins USING (key) WHERE depth > 0 AND hops >= 1 UNION ALL SELECT 'WARNING', 'Redirect chains', url FROM site WHERE hops >= 2
 UNION ALL SELECT 'CRITICAL', 'Missing title', url FROM good WHERE title = '' UNION ALL SELECT 'WARNING', 'Missing description', url FROM good WHERE description = ''
 UNION ALL SELECT 'WARNING', 'Duplicate ' || CASE field WHEN 'text_hash' THEN 'text' ELSE field END, first FROM ({_DUP('title', 'lower(title)')} UNION ALL {_DUP('description', 'lower(description)')} UNION ALL {_DUP('text_hash', 'text_hash')})
 UNION ALL SELECT CASE kind WHEN 'not-200' THEN 'CRITICAL' WHEN 'noindex' THEN 'CRITICAL' WHEN 'redirects' THEN 'WARNING' ELSE 'INFO' END, 'Canonical ' || replace(kind, 'not-200', 'not 200'), url FROM ({_CANON}) WHERE kind NOT IN ('fine', 'unverified')
 UNION ALL SELECT DISTINCT 'WARNING', 'Hreflang ' || replace(kind, 'not-200', 'not 200'), dst_url FROM ({_ALT}) WHERE kind IN ('not-200', 'one-way')
 UNION ALL SELECT 'WARNING', 'Sitemap ' || replace(kind, 'not-200', 'not 200'), loc FROM ({_LISTED}) WHERE kind <> 'fine'
 UNION ALL SELECT 'INFO', 'Deep pages', url FROM good WHERE depth > 3
 UNION ALL SELECT 'INFO', 'Missing from sitemap', url FROM good WHERE key NOT IN (SELECT key FROM sitemap) AND final_key NOT IN (SELECT key FROM sitemap)
 UNION ALL SELECT 'WARNING', 'Orphans', loc FROM sitemap WHERE key NOT IN (SELECT key FROM site UNION ALL SELECT final_key FROM site UNION ALL SELECT dst_key FROM link)"""


@query(f"{_WITH} SELECT severity, category, count(*) AS affected, array_to_string(list_sort(list(url))[1:20], ' ') AS sample FROM ({ALL_ISSUES}) GROUP BY ALL")
def site_issue_summary(spark, d):
    return site.summary(site.issues(*_in(spark, d), X.alternate(spark, d), X.sitemap(spark, d)))


@query(f"{_WITH} SELECT count(*) AS pages, count(*) FILTER (WHERE status IN (401, 403, 429, 503)) AS blocked, (SELECT count(*) FROM sitemap) AS listed, false AS truncated FROM site")
def site_notes(spark, d):
    return site.notes(X.site(spark, d), X.sitemap(spark, d))


_NOTES = f"""SELECT 'start-failed' AS note, count(*) AS n FROM site WHERE depth = 0 AND status >= 400 UNION ALL SELECT 'blocked', count(*) FROM site WHERE status IN (401, 403, 429, 503)
 UNION ALL SELECT 'canonical-unverified', count(DISTINCT canonical) FROM ({_CANON}) WHERE kind = 'unverified' UNION ALL SELECT 'hreflang-unverified', count(DISTINCT dst_key) FROM ({_ALT}) WHERE kind = 'unverified'"""
_UNLISTED = "SELECT count(*) FROM good WHERE key NOT IN (SELECT key FROM sitemap) AND final_key NOT IN (SELECT key FROM sitemap)"


@query(f"""{_WITH} SELECT 'whole' AS run, * FROM ({_NOTES}) WHERE n > 0 UNION ALL SELECT 'cut', * FROM ({_NOTES} UNION ALL SELECT 'truncated', 1 UNION ALL SELECT 'orphans-unchecked', 1 UNION ALL SELECT 'missing-unchecked', ({_UNLISTED})) WHERE n > 0
 UNION ALL SELECT 'elsewhere', * FROM ({_NOTES} UNION ALL SELECT 'sitemap-elsewhere', count(*) FROM sitemap) WHERE n > 0 UNION ALL SELECT 'nothing', 'no-pages', 1 UNION ALL SELECT 'nothing', 'sitemap-elsewhere', count(*) FROM sitemap""")
def site_notes_all(spark, d):
    """The notes of a whole audit, of one cut short, of one whose sitemap lists other hosts, and of one without pages."""
    p, alt, listed = X.site(spark, d), X.alternate(spark, d), X.sitemap(spark, d)
    away = listed.withColumn("key", F.replace("key", F.lit("s.example"), F.lit("elsewhere.example")))
    runs = {"whole": (p, alt, listed, True, False), "cut": (p, alt, listed, False, True), "elsewhere": (p, alt, away, True, False), "nothing": (p.where("false"), alt, listed, True, False)}
    out = None
    for name, args in runs.items():
        rows = site.all_notes(*args).select(F.lit(name).alias("run"), "note", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- crawling
@query(f"WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), edge AS (SELECT page_id AS src, (page_id * 3 + k) % n AS dst FROM pages, n, range(1, 5) t(k)), walk(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = id WHERE depth < 12) SELECT id AS key, min(depth) AS depth FROM walk GROUP BY id")
def bfs_depth(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    n = pages.count()
    edges = pages.select(F.col("page_id").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("page_id") * 3 + k) % n)).alias("dst"))
    return crawl.breadth_first(spark.range(1).select(F.col("id").alias("key")), edges)


_CRAWL = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), page AS (SELECT page_id AS id, n, CASE page_id % 23 WHEN 3 THEN 404 WHEN 5 THEN 503 ELSE 200 END AS status, page_id % 29 = 28 AS away, page_id % 8 = 7 AS shut, page_id % 19 = 18 AS noindex FROM pages, n),
 edge AS (SELECT id AS src, (id * 3 + k) % n AS dst FROM page, range(1, 5) t(k) WHERE status = 200 AND NOT away),
 walk(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = id JOIN page p ON p.id = dst WHERE NOT p.shut AND depth < 12),
 met AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def _crawled(spark, d, **limits):
    """A site in which some pages fail, some land on another host, and some are held back by robots; without limits, all of it."""
    i = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id")
    n = pages.count()
    status = F.when(i % 23 == 3, 404).when(i % 23 == 5, 503).otherwise(200)
    away = i % 29 == 28
    snapshot = pages.select(i.cast("string").alias("key"), F.lit("s.example").alias("host"), status.alias("status"), F.when(away, F.concat(F.lit("o"), i.cast("string"))).otherwise(i.cast("string")).alias("final_key"), F.when(away, "o.example").otherwise("s.example").alias("final_host"), (i % 19 == 18).alias("noindex"))
    links = pages.select(i.cast("string").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: ((i * 3 + k) % n).cast("string"))).alias("dst"))
    blocked = pages.where("page_id % 8 = 7").select(i.cast("string").alias("key"))
    return crawl.site_crawl("0", snapshot, links, blocked, **{"max_pages": n} | limits)


@query(f"{_CRAWL} SELECT CAST(id AS VARCHAR) AS key, CAST(depth AS INTEGER) AS depth, status FROM met JOIN page USING (id)")
def crawl_site(spark, d):
    return _crawled(spark, d).visits.select("key", "depth", "status")


@query(f"{_CRAWL} SELECT key FROM (SELECT DISTINCT CAST(dst AS VARCHAR) AS key, m.depth FROM met m JOIN edge ON src = m.id JOIN page p ON p.id = dst WHERE p.shut) GROUP BY key ORDER BY min(depth), key LIMIT 200")
def crawl_blocked_links(spark, d):
    """The links that robots held back, level by level, 200 at most."""
    return _crawled(spark, d).blocked


@query(f"{_CRAWL} SELECT key, depth FROM (SELECT CAST(id AS VARCHAR) AS key, CAST(depth AS INTEGER) AS depth FROM met) ORDER BY depth, key LIMIT 30")
def crawl_budget(spark, d):
    """A crawl of 30 pages from the first one: whole levels, then the first pages by URL of the level where the budget ends."""
    return _crawled(spark, d, max_pages=30).visits.select("key", "depth")


@query(f"{_CRAWL} SELECT CASE WHEN status = 200 AND NOT away AND NOT noindex THEN 'page' ELSE 'excluded' END AS outcome, count(*) AS pages FROM met JOIN page USING (id) GROUP BY outcome")
def crawl_sitemap_pages(spark, d):
    """Visited pages that a sitemap would list, and those it wouldn't."""
    host = F.when(F.col("final_key").startswith("o"), "O.example").otherwise("S.example")
    rows = _crawled(spark, d).visits.withColumn("final_host", host)
    return crawl.sitemap_pages(rows, "final_host", "s.example").groupBy("outcome").agg(F.count("*").alias("pages"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), hop AS (SELECT page_id AS id, CASE WHEN page_id % 11 = 4 OR page_id % 29 = 6 THEN (page_id * 13 + 5) % n END AS target, page_id % 11 = 4 OR page_id % 29 = 6 AS moves, page_id % 7 = 0 AND page_id % 11 = 4 AS lost FROM pages, n),
 walk AS (SELECT id AS start, id, 0 AS hops, '' AS error, moves AND NOT lost AS open FROM hop UNION ALL SELECT w.start, h.target, w.hops + 1, '', t.moves AND NOT t.lost FROM walk w JOIN hop h ON h.id = w.id JOIN hop t ON t.id = h.target WHERE w.open AND w.hops < 10),
 last AS (SELECT start, arg_max(id, hops) AS final, max(hops) AS hops FROM walk GROUP BY start)
SELECT start AS url, final AS final_url, last.hops AS hops, CASE WHEN h.moves AND h.lost THEN 'redirect without location' WHEN h.moves THEN 'too many redirects' ELSE '' END AS error FROM last JOIN hop h ON h.id = final""")
def redirect_resolve(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    n = pages.count()
    i = F.col("page_id")
    moves = (i % 11 == 4) | (i % 29 == 6)
    lost = (i % 7 == 0) & (i % 11 == 4)
    hops = pages.select(i.alias("url"), F.when(moves & ~lost, (i * 13 + 5) % n).alias("target"), moves.alias("redirects"))
    return crawl.resolve_redirects(pages.select(i.alias("url")), hops)


# ---------------------------------------------------------------- robots
_ROBOTS = "# all\nUser-agent: *\nDisallow: /cart\nDisallow: /*.pdf$\nAllow: /cart/help\nSitemap: https://s.example/map.xml\nDisallow: /tmp*\nCrawl-delay: 2\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: Google\nDisallow:\nDisallow: /exact$\nUser-agent: ClaudeBot\nDisallow: /\nAllow: /\n"


def _files(spark, d):
    """A file for each page: rules that all have, some of the page's own, and on every second one a group for a crawler by name."""
    i = F.col("page_id").cast("string")
    own = F.concat(F.lit("User-agent: *\nDisallow: /p"), i, F.lit("/\nCrawl-delay: "), (F.col("page_id") % 45).cast("string"), F.lit("\nCrawl-delay: soon\n"))
    named = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("user-agent: perplexityBOT # "), i, F.lit("\nDisallow: /\nAllow: /only\n"))).otherwise("")
    return table(spark, d, "pages").select(F.concat(F.lit("s"), i).alias("site"), F.concat(F.lit(_ROBOTS), own, named).alias("body"))


@query("""SELECT 's' || page_id AS site, g.grp, g.directive, g.value FROM pages, (VALUES (1, 'user-agent', '*'), (1, 'disallow', '/cart'), (1, 'disallow', '/*.pdf$'), (1, 'allow', '/cart/help'), (1, 'disallow', '/tmp*'), (1, 'crawl-delay', '2'), (2, 'user-agent', 'GPTBot'), (2, 'user-agent', 'CCBot'), (2, 'disallow', '/'), (3, 'user-agent', 'Google'), (3, 'disallow', ''), (3, 'disallow', '/exact$'), (4, 'user-agent', 'ClaudeBot'), (4, 'disallow', '/'), (4, 'allow', '/')) g(grp, directive, value)
UNION ALL SELECT 's' || page_id, 5, o.directive, o.value FROM pages, LATERAL (VALUES ('user-agent', '*'), ('disallow', '/p' || page_id || '/'), ('crawl-delay', CAST(page_id % 45 AS VARCHAR)), ('crawl-delay', 'soon')) o(directive, value)
UNION ALL SELECT 's' || page_id, 6, o.directive, o.value FROM pages, (VALUES ('user-agent', 'perplexityBOT'), ('disallow', '/'), ('allow', '/only')) o(directive, value) WHERE page_id % 2 = 0""")
def robots_groups(spark, d):
    return robots.groups(_files(spark, d)).select("site", F.col("grp").cast("int").alias("grp"), "directive", "value")


@query("SELECT 's' || page_id AS site, CAST(10 + CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS rules, CAST(5 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS groups, CAST(5 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS agents FROM pages")
def robots_counts(spark, d):
    return robots.counts(_files(spark, d))


@query("""SELECT 's' || page_id AS site, b.bot, CAST(CASE b.bot WHEN 'anyone' THEN 2 END AS DOUBLE) AS delay FROM pages, (VALUES ('anyone')) b(bot)""")
def robots_delays(spark, d):
    """What a file asks crawlers to wait: the first group for all decides, and PerplexityBot's own group on every second site asks for nothing."""
    bots = spark.createDataFrame([("anyone",), ("GPTBot",)], "bot string")
    return robots.delays(robots.groups(_files(spark, d)), bots)


_STEM = "'/' || CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'shop/' || (page_id % 13) WHEN 2 THEN 'x-' || (page_id % 5) || '/y' ELSE 'caf%C3%A9' END || '/p' || page_id"
#: Rules of two hosts, as many as pages: each page gives four, and some hold all paths.
_MANY = f"""SELECT 'h' || (page_id % 2) AS site, u.pattern, u.allow FROM (SELECT page_id, {_STEM} AS stem FROM pages), LATERAL (VALUES (stem, page_id % 3 = 0), (stem || '/*/z$', page_id % 3 <> 0), ('/*/q' || page_id || '*.gif$', false), ('*' || page_id || '*' || page_id || '/*end', true)) u(pattern, allow)
 UNION ALL SELECT * FROM (VALUES ('h0', '/', true), ('h0', '/*?', false), ('h1', '/caf%C3%A9*', false), ('h1', '/caf', true)) f(site, pattern, allow)"""
_ASKED = f"""SELECT page_id, 'h' || (page_id % 2) AS site, stem || CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/a/z' WHEN 2 THEN '/z/zz' WHEN 3 THEN '/q' || page_id || '/b.gif' WHEN 4 THEN '/' || page_id || '/x/endless' WHEN 5 THEN '?a=1' ELSE '0' END AS path FROM (SELECT page_id, {_STEM} AS stem FROM pages)"""


@query(rf"""WITH r AS (SELECT site, pattern, allow, CASE WHEN pattern LIKE '%$' THEN replace(replace(rtrim(pattern, '$'), '%', '\%'), '*', '%') ELSE replace(replace(pattern, '%', '\%'), '*', '%') || '%' END AS lk FROM ({_MANY})), p AS ({_ASKED}),
 m AS (SELECT page_id, max({{'size': length(pattern), 'allow': allow}}) AS best FROM p JOIN r ON r.site = p.site AND path LIKE lk ESCAPE '\' GROUP BY page_id)
SELECT page_id, path, coalesce(best.allow, true) AS allowed FROM p LEFT JOIN m USING (page_id)""")
def robots_many_rules(spark, d):
    """Two hosts with rules for every page: plain beginnings, wildcards within and at the start, anchored ends."""
    pages = table(spark, d, "pages")
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    stem = F.concat(F.lit("/"), F.when(k == 0, "a").when(k == 1, F.concat(F.lit("shop/"), (F.col("page_id") % 13).cast("string"))).when(k == 2, F.concat(F.lit("x-"), (F.col("page_id") % 5).cast("string"), F.lit("/y"))).otherwise("caf%C3%A9"), F.lit("/p"), i)
    rows = pages.select("page_id", F.concat(F.lit("h"), (F.col("page_id") % 2).cast("string")).alias("site"), stem.alias("stem"))
    third = F.col("page_id") % 3 == 0
    lines = F.array(
        F.concat(F.when(third, "Allow: ").otherwise("Disallow: "), "stem"), F.concat(F.when(third, "Disallow: ").otherwise("Allow: "), "stem", F.lit("/*/z$")),
        F.concat(F.lit("Disallow: /*/q"), i, F.lit("*.gif$")), F.concat(F.lit("Allow: *"), i, F.lit("*"), i, F.lit("/*end")),
    )
    own = {"h0": "Allow: /\nDisallow: /*?\n", "h1": "Disallow: /caf%C3%A9*\nAllow: /caf\n"}
    ruled = rows.select("site", F.explode(lines).alias("line"))
    # a host's file is what its lines say; here the lines are already rows
    more = spark.createDataFrame([(h, x) for h, t in own.items() for x in t.split("\n") if x], "site string, line string")
    ruled = ruled.unionByName(more).select("site", F.col("line").startswith("Allow").alias("allow"), F.regexp_extract("line", "^[^:]*: (.*)$", 1).alias("pattern"))
    tail = F.col("page_id") % 7
    path = F.concat("stem", F.when(tail == 0, "").when(tail == 1, "/a/z").when(tail == 2, "/z/zz").when(tail == 3, F.concat(F.lit("/q"), i, F.lit("/b.gif"))).when(tail == 4, F.concat(F.lit("/"), i, F.lit("/x/endless"))).when(tail == 5, "?a=1").otherwise("0"))
    asked = rows.select("page_id", "site", path.alias("path"))
    said = robots.verdicts(asked.select("site", "path").distinct(), ruled)
    return asked.join(said, ["site", "path"]).select("page_id", "path", "allowed")


@query("""SELECT 's' || page_id AS site, CAST(k AS INTEGER) AS depth, 'u' || k AS key, k * CASE WHEN page_id % 4 = 0 THEN 0 ELSE least(30, page_id % 45) END::DOUBLE AS start FROM pages, range(0, 3) r(k)""")
def crawl_start_times(spark, d):
    """When each visit begins, on sites of which three in four ask for a delay."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("host"), "page_id")
    visits = pages.select("host", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("depth")).withColumn("key", F.concat(F.lit("u"), F.col("depth").cast("string")))
    delays = pages.where("page_id % 4 <> 0").select("host", (F.col("page_id") % 45).cast("double").alias("delay"))
    return crawl.start_times(visits, delays).withColumnRenamed("host", "site")


_PATH = "(SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*([^?#]*)', 1) || CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pdf?x' WHEN 2 THEN '' ELSE '/z' END AS rest, CASE page_id % 5 WHEN 0 THEN '/cart' WHEN 1 THEN '/cart/help' WHEN 2 THEN '/tmp1' ELSE '' END AS pre FROM pages)"


@query(f"""SELECT DISTINCT path, CASE WHEN path LIKE '/cart/help%' AND NOT (regexp_matches(path, '\\.pdf$') AND length('/*.pdf$') > length('/cart/help')) THEN true WHEN path LIKE '/cart%' THEN false WHEN path LIKE '/tmp%' THEN false WHEN regexp_matches(path, '\\.pdf$') THEN false ELSE true END AS allowed FROM (SELECT pre || rest AS path FROM {_PATH})""")
def robots_longest_match(spark, d):
    i = F.col("page_id")
    rest = F.concat(F.regexp_extract("url", "^[^:]*://[^/]*([^?#]*)", 1), F.when(i % 6 == 0, ".pdf").when(i % 6 == 1, ".pdf?x").when(i % 6 == 2, "").otherwise("/z"))
    pre = F.when(i % 5 == 0, "/cart").when(i % 5 == 1, "/cart/help").when(i % 5 == 2, "/tmp1").otherwise("")
    paths = table(spark, d, "pages").select(F.lit("s").alias("site"), F.concat(pre, rest).alias("path")).distinct()
    files = spark.createDataFrame([("s", _ROBOTS)], "site string, body string")
    ruled = robots.rules(robots.groups(files)).where("grp = 1")
    return robots.verdicts(paths, ruled).select("path", "allowed")


@query("""SELECT 's' || page_id AS site, bot, CASE WHEN bot = 'PerplexityBot' AND page_id % 2 = 0 THEN bot ELSE label END AS label, CASE WHEN bot = 'PerplexityBot' AND page_id % 2 = 0 THEN 'Disallowed' ELSE status END AS status FROM pages, (VALUES ('Googlebot', 'google', 'Partial Restrictions'), ('Google-Extended', 'google', 'Partial Restrictions'), ('OAI-SearchBot', '*', 'Partial Restrictions'), ('GPTBot', 'GPTBot', 'Disallowed'), ('ClaudeBot', 'ClaudeBot', 'Partial Restrictions'), ('PerplexityBot', '*', 'Partial Restrictions'), ('CCBot', 'CCBot', 'Disallowed'), ('Bytespider', '*', 'Partial Restrictions'), ('Applebot-Extended', '*', 'Partial Restrictions')) t(bot, label, status)""")
def ai_crawler_policy(spark, d):
    return robots.policy(_files(spark, d)).select("site", "bot", "label", "status")


# ---------------------------------------------------------------- sitemaps
_ESC = "replace(replace(url, '&', '&amp;'), '''', '&apos;')"


def _maps(spark, d, files: int = 7):
    """Sitemap files with the pages' URLs, dealt by page_id."""
    rows = table(spark, d, "pages").select(F.concat(F.lit("f"), (F.col("page_id") % files).cast("string")).alias("file"), "page_id", F.concat(F.lit("<url><loc> "), sitemap.escape(F.col("url")), F.lit(" </loc><priority>0.5</priority></url>")).alias("x"))
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda s: s.x), ""), F.lit("<url><loc></loc></url><url><loc>cut"))
    return rows.groupBy("file").agg(body.alias("body"))


@query("SELECT 'f' || page_id % 7 AS file, CAST(page_id // 7 AS INTEGER) AS pos, url AS loc, '' AS lastmod, 0.5::DOUBLE AS priority FROM pages")
def sitemap_parse(spark, d):
    return sitemap.urls(_maps(spark, d)).select("file", "pos", "loc", "lastmod", "priority")


@query("SELECT 'f' || page_id % 7 AS file, count(*) AS urls, count(*) > 50000 AS too_many FROM pages GROUP BY file")
def sitemap_totals(spark, d):
    return sitemap.totals(sitemap.urls(_maps(spark, d)))


_SAMPLE = """WITH f AS (SELECT 'f' || page_id % 7 AS file, page_id // 7 AS pos, url AS loc, page_id FROM pages), n AS (SELECT file, count(*) AS n FROM f GROUP BY file),
 turn AS (SELECT file, n, row_number() OVER (ORDER BY k, file) AS t FROM n, range(0, 10) r(k) WHERE k < n), q AS (SELECT file, n, count(*) AS q FROM turn WHERE t <= 10 GROUP BY file, n)
SELECT f.file, f.loc FROM q, range(0, 10) r(j), f WHERE j < q AND f.file = q.file AND f.pos = (j * n) // q"""


@query(_SAMPLE)
def sitemap_sample(spark, d):
    return sitemap.sample(sitemap.urls(_maps(spark, d)), 10).select("file", "loc")


@query("""SELECT url AS loc, CASE WHEN page_id % 17 = 0 THEN 'broken' ELSE CASE page_id % 23 WHEN 3 THEN 'broken' WHEN 5 THEN 'blocked' WHEN 7 THEN 'broken' ELSE CASE WHEN page_id % 11 = 4 THEN 'redirect' ELSE 'ok' END END END AS verdict FROM pages""")
def sitemap_health(spark, d):
    """Every page's answer: none for every 17th, errors, refusals and redirects for others. A URL of several pages is fetched for each."""
    i = F.col("page_id")
    pages = table(spark, d, "pages")
    status = F.when(i % 23 == 3, 404).when(i % 23 == 5, 503).when(i % 23 == 7, 500).otherwise(200)
    snapshot = pages.where(i % 17 != 0).select("url", "page_id", status.alias("status"), F.when(i % 11 == 4, 1).otherwise(0).alias("hops"))
    return sitemap.health(pages.select(F.col("url").alias("loc"), "page_id"), snapshot, by=("page_id",))


@query(f"SELECT url, '<url><loc>' || {_ESC} || '</loc>' || CASE WHEN page_id % 2 = 0 THEN '<lastmod>2026-01-0' || (1 + page_id % 9) || '</lastmod>' ELSE '' END || '</url>' AS xml FROM pages")
def sitemap_xml_out(spark, d):
    i = F.col("page_id")
    return sitemap.entries(table(spark, d, "pages").select("url", F.lit("").alias("final_url"), F.when(i % 2 == 0, F.concat(F.lit("2026-01-0"), (1 + i % 9).cast("string"))).otherwise("").alias("lastmod")))


_TREE = "(SELECT page_id AS id, CAST(CASE WHEN page_id = 0 THEN 0 WHEN page_id <= 12 THEN 1 WHEN page_id <= 156 THEN 2 WHEN page_id <= 1884 THEN 3 ELSE 4 END AS INTEGER) AS depth, (page_id - 1) // 12 AS up FROM pages)"
_WALKED = f"(SELECT 'm' || id AS file, depth, CASE WHEN id = 7 THEN 'missing' WHEN id <= 50 THEN '' ELSE 'over the cap' END AS error FROM {_TREE} WHERE depth <= 1 OR (depth = 2 AND up <> 7) OR (depth = 3 AND up BETWEEN 13 AND 50))"


def _walked(spark, d):
    """An index of twelve, each of twelve more, and so on; one file is missing, and every file lists two others again."""
    i = F.col("page_id")
    rows = table(spark, d, "pages").select(i.alias("id"), F.when(i > 0, F.floor((i - 1) / 12)).alias("up"))
    entry = lambda x: F.concat(F.lit("<sitemap><loc>m"), x, F.lit("</loc></sitemap>"))
    kids = rows.where("id > 0").groupBy("up").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: entry(x.cast("string"))), "").alias("kids")).withColumnRenamed("up", "of")
    body = F.concat(F.lit("<sitemapindex>"), F.coalesce("kids", F.lit("")), entry(F.lit("0")), entry(F.lit("3")), F.lit("</sitemapindex>"))
    files = rows.join(kids, rows.id == kids.of, "left").where("id <> 7").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("file"), body.alias("body"))
    return sitemap.tree(spark.createDataFrame([("m0",)], "file string"), files)


@query(f"SELECT * FROM {_WALKED}")
def sitemap_tree(spark, d):
    return _walked(spark, d).select("file", "depth", "error")


@query(f"SELECT count(*) FILTER (WHERE error <> '') = 0 AS complete, count(*) FILTER (WHERE error = '') AS files, count(*) FILTER (WHERE error = 'over the cap') AS skipped, count(*) FILTER (WHERE error = 'missing') AS errors FROM {_WALKED}")
def sitemap_complete(spark, d):
    return sitemap.complete(_walked(spark, d))


@query("SELECT url AS loc FROM pages ORDER BY page_id % 7, page_id // 7 LIMIT 60")
def sitemap_collected(spark, d):
    """The first URLs of seven files in the tree's order, up to a limit."""
    found = sitemap.urls(_maps(spark, d)).withColumn("path", F.array(F.lit(0), F.substring("file", 2, 9).cast("int")))
    return sitemap.collected(found, 60).select("loc")


@query("""SELECT 'https://s' || page_id AS site, f.file, f.source FROM pages, LATERAL (VALUES (0, 'https://s' || page_id || '/map1', 'robots'), (0, 'https://s' || page_id || '/map2', 'robots'), (1, 'https://s' || page_id || '/sitemap.xml', '/sitemap.xml'), (2, 'https://s' || page_id || '/sitemap_index.xml', '/sitemap_index.xml')) f(k, file, source) WHERE f.k = page_id % 4""")
def sitemap_discover(spark, d):
    """A site for each page: its robots file lists two files, or it has the first usual file, or only the second, or none."""
    kind = F.col("page_id") % 4
    sites = table(spark, d, "pages").select(F.concat(F.lit("https://s"), F.col("page_id").cast("string")).alias("site"), kind.alias("kind"))
    at = lambda name: F.concat("site", F.lit(name))
    listed = sites.where("kind = 0").select("site", F.explode(F.array(F.struct(at("/map1").alias("value"), F.lit(1).alias("line")), F.struct(at("/map2").alias("value"), F.lit(5).alias("line")))).alias("x")).select("site", "x.*")
    first = F.when(F.col("kind").isin(0, 1), "<urlset/>").when(F.col("kind") == 2, "nothing")
    second = F.when(F.col("kind").isin(1, 2), "<sitemapindex/>").otherwise("404")
    files = sites.select(F.explode(F.array(F.struct(at("/sitemap.xml").alias("file"), first.alias("body")), F.struct(at("/sitemap_index.xml").alias("file"), second.alias("body")))).alias("x")).select("x.*").where("body is not null")
    return sitemap.discover(sites.select("site"), listed, files).select("site", "file", "source")


_HOST = "regexp_extract(url, '://([^/]*)', 1)"


@query(f"SELECT arg_min(url, page_id) AS loc FROM pages WHERE {_HOST} LIKE '%.com' GROUP BY regexp_replace(url, '/$', '')")
def sitemap_on_hosts(spark, d):
    """Listed URLs on some hosts; every URL is listed again with a fragment."""
    listed = table(spark, d, "pages").select(F.explode(F.array(F.struct(F.col("url").alias("loc"), F.col("page_id").alias("pos")), F.struct(F.concat("url", F.lit("#again")).alias("loc"), (F.col("page_id") + 1_000_000_000).alias("pos")))).alias("x")).select("x.*")
    hosts = listed.select(F.regexp_extract("loc", "://([^/]*)", 1).alias("host")).where("host like '%.com'").distinct()
    return sitemap.on_hosts(listed, hosts).select("loc")


@query("SELECT 'https://other.example/x' AS loc")
def sitemap_cross_origin(spark, d):
    """The first sampled URL on another host than the sitemap's; two such URLs are put last into each file."""
    maps = _maps(spark, d).withColumn("body", F.concat(F.regexp_replace(F.regexp_replace("body", "<loc> [^<]* </loc>", "<loc>https://s.example/p</loc>"), "<url><loc>cut$", ""), F.lit("<url><loc>https://other.example/x</loc></url><url><loc>https://other.example/y</loc></url>")))
    found = sitemap.urls(maps)
    return sitemap.cross_origin(sitemap.sample(found, 1_000_000_000), "S.example")
