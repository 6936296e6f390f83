"""Crawling a snapshot of the web: redirects and breadth-first levels, each level a join and an anti-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.shared import cut as _cut

# Limits that a run keeps unless told otherwise; blocked links that a crawl reports at most.
MAX_PAGES, MAX_REDIRECTS, MAX_BLOCKED = 100, 10, 200
# Seconds that a site's wish to be left alone between requests is granted at most.
MAX_DELAY = 30.0


def resolve_redirects(start: DataFrame, hops: DataFrame, limit: int = MAX_REDIRECTS) -> DataFrame:
    """start (url), hops (url, target; target null for no redirect) -> url, final_url, hops, error.

    Walks all chains at once. A redirect without a target is an error, and so is a chain longer than the limit.
    """
    step = hops.select(F.col("url").alias("at"), "target", F.col("redirects"))
    now = start.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit("").alias("error"), F.lit(True).alias("open"))
    for _ in range(limit + 1):
        moved = now.join(step, now.final_url == step.at, "left")
        goes = F.col("open") & F.coalesce(F.col("redirects"), F.lit(False))
        lost = goes & F.col("target").isNull()
        over = goes & (F.col("hops") >= limit)
        error = F.when(lost, "redirect without location").when(over, "too many redirects").otherwise(F.col("error"))
        on = goes & ~lost & ~over
        now = moved.select("url", F.when(on, F.col("target")).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + on.cast("int")).alias("hops"), error.alias("error"), on.alias("open"))
    return now.drop("open")


def breadth_first(seeds: DataFrame, edges: DataFrame, max_pages: int | None = None, max_depth: int = 1000) -> DataFrame:
    """seeds (key), edges (src, dst) -> key, depth: the level at which each page is first met.

    max_pages keeps the first pages by key within the level where the budget ends, as a crawl would.
    """
    level = _cut(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    seen, left = level, max_pages
    for depth in range(1, max_depth + 1):
        if left is not None:
            left -= level.count()
            if left <= 0:
                break
        ahead = level.join(edges, level.key == edges.src).select(F.col("dst").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        if left is not None:
            ahead = ahead.orderBy("key").limit(left)
        level = _cut(ahead.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen if max_pages is None else seen.orderBy("depth", "key").limit(max_pages)


def crawl(seeds: DataFrame, snapshot: DataFrame, links: DataFrame, allowed: DataFrame | None = None, max_pages: int = MAX_PAGES) -> DataFrame:
    """Crawls a snapshot (key, status, host) along links (src, dst): key, depth, status.

    Pages that don't answer with 200, or are on another host than the seeds, lead nowhere. allowed (key): what
    robots.txt lets through; without it everything is.
    """
    fine = snapshot.where("status = 200").join(seeds.join(snapshot, "key").select("host").distinct(), "host", "left_semi")
    edges = links.join(fine.select(F.col("key").alias("src")), "src", "left_semi").select("src", "dst")
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst")
        seeds = seeds.join(allowed, "key", "left_semi")
    return breadth_first(seeds, edges, max_pages).join(snapshot.select("key", "status"), "key", "left")


@dataclass
class Crawl:
    """A crawl's visits (key, depth, status, error, final_key, noindex), the links that robots.txt held back (key), and whether a budget cut it short."""

    visits: DataFrame
    blocked: DataFrame
    truncated: bool


def site_crawl(start: str, snapshot: DataFrame, links: DataFrame, blocked: DataFrame, robots_status: int | None = 200, max_pages: int = MAX_PAGES) -> Crawl:
    """Crawls one site of a snapshot, breadth first.

    snapshot: key, host, status (null: the fetch failed), final_key, final_host, noindex. links: src, dst of the
    site's own links with paths that are crawled. blocked (key): what robots.txt disallows; without an answer
    for it, or with a server's error, that is everything, and with another answer than 200 nothing.
    Pages that don't answer with 200 or land on another host lead nowhere; where a redirect landed counts as
    seen. At most max_pages are visited, each level's first by key, and twice as many are ever queued.
    """
    spark = snapshot.sparkSession
    seed = spark.createDataFrame([(start,)], "key string")
    none = spark.createDataFrame([], "key string")
    shut = robots_status is None or robots_status >= 500
    if robots_status != 200:
        blocked = none
    if shut or not blocked.where(F.col("key") == start).isEmpty():
        visits = snapshot.where("false").select("key", F.lit(0).alias("depth"), "status", F.lit("").alias("error"), "final_key", "noindex")
        return Crawl(visits, seed, False)
    host = snapshot.where(F.col("key") == start).select("host").first()
    host = host[0] if host else None
    queue, seen, visits, held, truncated, visited, depth = seed, _cut(seed), None, None, False, 0, 0
    n_held = 0
    while True:
        n = queue.count()
        if not n:
            break
        if n > max_pages - visited:
            truncated, n = True, max_pages - visited
            queue = queue.orderBy("key").limit(n)
        batch = _cut(queue.join(snapshot, "key", "left").withColumn("depth", F.lit(depth)))
        visits = batch if visits is None else visits.unionByName(batch)
        visited += n
        landed = batch.where("final_key <> key").select(F.col("final_key").alias("key"))
        found = batch.where((F.col("status") == 200) & (F.col("final_host") == host)).select(F.col("key").alias("src")).join(links, "src").select(F.col("dst").alias("key")).distinct()
        stopped = found.join(blocked, "key", "left_semi")
        if n_held < MAX_BLOCKED:
            more = stopped if held is None else stopped.join(held, "key", "left_anti")
            more = _cut(more.orderBy("key").limit(MAX_BLOCKED - n_held))
            n_held += more.count()
            held = more if held is None else held.unionByName(more)
        seen = seen.unionByName(landed).distinct()
        new = found.join(blocked, "key", "left_anti").join(seen, "key", "left_anti")
        room = 2 * max_pages - seen.count()
        new = _cut(new.orderBy("key").limit(max(0, room) + 1))
        if new.count() > max(0, room):
            truncated = True
            new = new.orderBy("key").limit(max(0, room))
        if visited >= max_pages:
            truncated = truncated or not new.isEmpty()
            break
        queue, seen, depth = new, _cut(seen.unionByName(new)), depth + 1
    failed = F.when(F.col("status").isNull(), "fetch failed").otherwise("")
    return Crawl(visits.select("key", "depth", "status", failed.alias("error"), "final_key", "noindex"), none if held is None else held, truncated)


def sitemap_pages(visits: DataFrame, final_host: str, host: str) -> DataFrame:
    """visits (key, status, noindex and the column of landing hosts) with their outcome: page, excluded or error.

    Pages for a sitemap answer with 200 on the site's own host and don't forbid indexing.
    """
    fine = (F.col("status") == 200) & (F.lower(F.col(final_host)) == host.lower()) & ~F.coalesce(F.col("noindex"), F.lit(False))
    return visits.withColumn("outcome", F.when(F.col("status").isNull(), "error").when(fine, "page").otherwise("excluded"))


def start_times(visits: DataFrame, delays: DataFrame) -> DataFrame:
    """visits (host, depth, key) and delays (host, delay in seconds) -> visits with start, the seconds after which each is fetched.

    A site that asks for a delay gets one request at a time, in order of depth and key, each the delay (MAX_DELAY at
    most) after the one before; levels wait for the ones before them. Other sites' visits start at 0. Visits of a
    host are as many as a crawl's budget of pages.
    """
    wait = delays.select("host", F.least(F.greatest("delay", F.lit(0.0)), F.lit(MAX_DELAY)).alias("_wait"))
    nth = F.row_number().over(Window.partitionBy("host").orderBy("depth", "key")) - 1
    rows = visits.join(wait, "host", "left").withColumn("_nth", nth)
    return rows.withColumn("start", F.col("_nth") * F.coalesce("_wait", F.lit(0.0))).drop("_nth", "_wait")
