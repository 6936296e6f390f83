"""Sitemaps: reading, discovery, the tree of indexes, sampling, health, and writing."""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from auditmill.functions import urls as U
from auditmill.shared import cut as _cut
from auditmill.shared import numbered

# Limits that a run keeps unless told otherwise.
MAX_CHILDREN, MAX_DEPTH, MAX_URLS, MAX_FILE_URLS, MAX_BYTES, SAMPLE, MAX_SAMPLE = 50, 3, 200_000, 50_000, 50 << 20, 10, 100


def clamp(asked: int | None, default: int, most: int) -> int:
    return default if not asked or asked < 1 else min(asked, most)


_FILE = pa.struct([("body", pa.string()), ("error", pa.string())])


@F.arrow_udf(from_arrow_type(_FILE))
def decoded(raw: pa.Array) -> pa.Array:
    """A file's text: unzipped if it begins as gzip, with the reason why not if it can't be."""
    out = []
    for b in raw.to_pylist():
        body, error = b or b"", ""
        if body[:2] == b"\x1f\x8b":
            try:
                body = gzip.GzipFile(fileobj=io.BytesIO(body)).read(MAX_BYTES + 1)
                error = "too large" if len(body) > MAX_BYTES else ""
            except (OSError, EOFError) as e:
                body, error = b"", f"gzip: {e}"
        text = body.decode("utf-8", "replace")
        if text[:512].lstrip("﻿ \t\r\n").lower().startswith(("<!doctype html", "<html")):
            text, error = "", "an HTML page"
        out.append({"body": text, "error": error})
    return pa.array(out, _FILE)


def _field(block, tag: str):
    inner = F.trim(F.regexp_extract(block, rf"(?s)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}\s*>", 1))
    inner = F.regexp_replace(inner, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(entity), F.lit(c))
    return F.trim(inner)


def urls(files: DataFrame) -> DataFrame:
    """files (file, body) -> file, pos, loc, lastmod, changefreq, priority of url entries. What stands before a break in the XML is kept."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?url\b[^>]*>.*?</(?:\w+:)?url\s*>"), F.lit(0))
    rows = files.select("file", F.posexplode(blocks).alias("pos", "b"))
    return rows.select("file", "pos", _field(F.col("b"), "loc").alias("loc"), _field(F.col("b"), "lastmod").alias("lastmod"), _field(F.col("b"), "changefreq").alias("changefreq"), _field(F.col("b"), "priority").try_cast("double").alias("priority")).where("loc <> ''")


def children(files: DataFrame) -> DataFrame:
    """files (file, body) -> file, pos, child of index entries."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?sitemap\b[^>]*>.*?</(?:\w+:)?sitemap\s*>"), F.lit(0))
    rows = files.select("file", F.posexplode(blocks).alias("pos", "b"))
    return rows.select("file", "pos", _field(F.col("b"), "loc").alias("child")).where("child <> ''")


def discover(sites: DataFrame, listed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """sites (site) -> site, file, source: what robots lists, else /sitemap.xml, else /sitemap_index.xml, if the snapshot (file, body) has a sitemap there."""
    known = snapshot.select(F.col("file").alias("f"), F.col("body").rlike("<(urlset|sitemapindex)").alias("fine"))
    robots = listed.select("site", F.col("value").alias("file"), F.lit("robots").alias("source"), "line")
    guess = sites.select("site", F.explode(F.array(*[F.struct(F.concat("site", F.lit(p)).alias("file"), F.lit(p).alias("source"), F.lit(i).alias("line")) for i, p in enumerate(("/sitemap.xml", "/sitemap_index.xml"))])).alias("g")).select("site", "g.*")
    guess = guess.join(known.where("fine"), F.col("file") == F.col("f"), "left_semi").join(robots, "site", "left_anti")
    w = Window.partitionBy("site").orderBy("line")
    guess = guess.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return robots.unionByName(guess)


def tree(roots: DataFrame, snapshot: DataFrame, max_children: int = MAX_CHILDREN, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Walks indexes level by level: roots (file) over snapshot (file, body) -> file, depth, path, error.

    A file is taken once, where it is listed first; path sorts depth first. One budget of children is spent over
    all levels, in listed order. error: "" for a file that was read, "missing" for one that the snapshot lacks,
    "too deep" or "over the cap" for one that was left out. The tree is complete if no row has an error.
    """
    level = roots.select("file", F.lit(0).alias("depth"), F.array(F.lit(0)).alias("path"))
    known, edges, left = snapshot.select(F.col("file").alias("_file")).distinct(), children(snapshot), max_children
    taken = _cut(level.withColumn("error", F.lit("")))
    out = taken
    for depth in range(1, max_depth + 2):
        down = taken.where("error = ''").join(edges, "file").select(F.col("child").alias("file"), F.concat("path", F.array("pos")).alias("path"))
        down = down.groupBy("file").agg(F.min("path").alias("path")).join(out.select("file"), "file", "left_anti").withColumn("depth", F.lit(depth))
        if depth > max_depth:
            taken = down.withColumn("error", F.lit("too deep"))
        else:
            # ranks up to the budget alone are needed; the window is over one level's files, not over URLs
            rank = F.row_number().over(Window.orderBy("path"))
            taken = down.withColumn("error", F.when(rank > left, "over the cap").otherwise(""))
        taken = _cut(taken.select("file", "depth", "path", "error"))
        out = out.unionByName(taken)
        if depth <= max_depth:
            left -= taken.where("error = ''").count()
    out = out.join(known, F.col("file") == F.col("_file"), "left")
    error = F.when((F.col("error") == "") & F.col("_file").isNull(), "missing").otherwise(F.col("error"))
    return out.select("file", "depth", "path", error.alias("error"))


def complete(walked: DataFrame) -> DataFrame:
    """One row: complete, files (read), skipped (left out by depth or budget), errors (that couldn't be read)."""
    left_out = F.col("error").isin("too deep", "over the cap")
    return walked.agg(
        (F.count_if(F.col("error") != "") == 0).alias("complete"), F.count_if(F.col("error") == "").alias("files"), F.count_if(left_out).alias("skipped"),
        F.count_if((F.col("error") != "") & ~left_out).alias("errors"),
    )


def collected(found: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """found (file, pos, path, loc) -> the first `most` URLs in the tree's order; a run that has more isn't complete."""
    return found.orderBy("path", "pos").limit(most)


def totals(found: DataFrame) -> DataFrame:
    """file, urls, too_many."""
    return found.groupBy("file").agg(F.count("*").alias("urls"), (F.count("*") > MAX_FILE_URLS).alias("too_many"))


def _full_rounds(n: DataFrame, size: int) -> int:
    """The most rounds of dealing one place to each file with places left that `size` places pay for: a search by 32 sums at a time."""
    lo, hi = 0, size + 1  # lo rounds can be paid, hi rounds can't or needn't
    while hi - lo > 1:
        tries = sorted({lo + (hi - lo) * i // 33 for i in range(1, 33)} - {lo})
        cost = n.agg(*[F.coalesce(F.sum(F.least("n", F.lit(k))), F.lit(0)).alias(f"k{k}") for k in tries]).first()
        paid = [k for k in tries if cost[f"k{k}"] <= size]
        lo, hi = max([lo, *paid]), min([hi, *(k for k in tries if k not in paid)])
    return lo


def sample(found: DataFrame, size: int) -> DataFrame:
    """found (file, pos) -> a fair sample of `size` rows: places are dealt to files in turn, and are evenly spaced within a file.

    With fewer places than files, evenly spaced files give one each. Whole rounds of dealing follow from sums of
    counts, and the places left go to the first files that have rows left. Files are numbered in two levels.
    """
    n = numbered(found.groupBy("file").agg(F.count("*").alias("n")), "g", "file")
    files = n.count()
    if files > size:
        # the files numbered floor(i * files / size)
        picked = n.withColumn("i", F.expr(f"(g * {size} + {files - 1}) div {files}"))
        picked = picked.where(f"i < {size} and (i * {files}) div {size} = g").drop("i").withColumn("q", F.lit(1))
    else:
        rounds = _full_rounds(n, size)
        left = size - int(n.agg(F.coalesce(F.sum(F.least("n", F.lit(rounds))), F.lit(0))).first()[0])
        more = numbered(n.where(F.col("n") > rounds).select("file"), "r", "file").where(F.col("r") < left).select("file", F.lit(1).alias("extra"))
        picked = n.join(more, "file", "left").withColumn("q", (F.least("n", F.lit(rounds)) + F.coalesce("extra", F.lit(0))).cast("int")).where("q > 0").drop("extra")
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1)
    want = picked.select("file", "g", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.floor(j * F.col("n") / F.col("q")))).alias("j", "at"))
    return ranked.join(want, ["file", "at"]).select(*found.columns, "j", "g").orderBy("j", "g")


def health(sampled: DataFrame, snapshot: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sampled (loc) against snapshot (url, status, hops) -> loc, verdict: ok, broken, blocked, redirect; a row for each sampled one.

    by: columns of both that tell the fetches of a URL apart, so that an entry gets its own fetch's verdict. Of
    several answers that are left for an entry the worst counts: broken, then blocked, then redirect.
    """
    s, grades = F.col("status"), F.array(*map(F.lit, ("ok", "redirect", "blocked", "broken")))
    grade = F.when(s.isNull(), 4).when(s.isin(401, 403, 429, 503), 3).when(s >= 400, 4).when(F.col("hops") > 0, 2).otherwise(1)
    said = snapshot.groupBy(F.col("url").alias("loc"), *by).agg(F.max(grade).alias("grade"))
    return sampled.join(said, ["loc", *by], "left").select("loc", F.element_at(grades, F.coalesce("grade", F.lit(4))).alias("verdict"))


def escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def entries(pages: DataFrame) -> DataFrame:
    """pages (url, final_url, lastmod) -> url, xml: each page's entry of a sitemap to write."""
    loc = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))
    mod = F.when(F.coalesce("lastmod", F.lit("")) != "", F.concat(F.lit("<lastmod>"), escape(F.col("lastmod")), F.lit("</lastmod>"))).otherwise("")
    return pages.select("url", F.concat(F.lit("<url><loc>"), escape(loc), F.lit("</loc>"), mod, F.lit("</url>")).alias("xml"))


def write(pages: DataFrame, path: str) -> None:
    """Sitemap files of a bounded number of entries each, in parallel."""
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
    rows = entries(pages).withColumn("part", F.spark_partition_id()).withColumn("n", F.floor((F.row_number().over(Window.partitionBy("part").orderBy("url")) - 1) / MAX_FILE_URLS))
    rows.groupBy("part", "n").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("xml")), ""), F.lit(tail)).alias("value")).select("value").write.text(path)


def on_hosts(locs: DataFrame, hosts: DataFrame) -> DataFrame:
    """locs (loc, pos) on the given hosts (host), one for each key: the first listed."""
    rows = locs.withColumns({"host": U.host_of(F.col("loc")), "key": U.key_absolute(F.col("loc"))}).join(hosts, "host", "left_semi")
    return rows.groupBy("key").agg(F.min_by("loc", "pos").alias("loc"))


def cross_origin(sampled: DataFrame, host: str) -> DataFrame:
    """The first sampled URL (loc, in order of j and g) that is on another host than the sitemap; no row if none is."""
    return sampled.where(U.host_of(F.col("loc")) != host.lower()).orderBy("j", "g").limit(1).select("loc")


def read_file(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files (file, status, raw) -> file, body, error, warn: a file that answered with 200 and is a sitemap, unzipped.

    A plain file longer than `most` bytes keeps what its first bytes hold, with a warning.
    """
    cut = F.octet_length("raw") > most
    rows = files.withColumns({"x": decoded(F.substring("raw", 1, most)), "cut": cut})
    bad = F.when(F.coalesce(F.col("status"), F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce("status", F.lit(0)).cast("string"))).otherwise(F.col("x.error"))
    return rows.select("file", F.when(bad == "", F.col("x.body")).otherwise("").alias("body"), bad.alias("error"), F.when(F.col("cut") & (bad == ""), "truncated").otherwise("").alias("warn"))
