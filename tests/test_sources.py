"""Readers and writers on files and addresses."""

import gzip
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from auditmill.functions import urls as U
from auditmill.operators import crawl, drift, strategy
from auditmill.sources import feeds, fetch, robots, sitemap


def test_crawl_index(spark, tmp_path):
    (tmp_path / "index").write_text('{"url":"a","mime":"text/html"}\n{broken\n{"url":"b"}\n')
    assert sorted(r.url for r in feeds.read_cdx(spark, str(tmp_path / "index")).collect()) == ["a", "b"]
    assert feeds.read_cdx(spark, str(tmp_path / "index"), 1).count() == 1
    assert [feeds.clamped(n) for n in (None, 0, -1, 7, 9999)] == [50, 50, 50, 7, 500]


def test_lint_files(spark, tmp_path):
    for name, text in {"a.html": "<p>", "b.txt": ' {"@type":"x"}', "c.txt": "words", "d.JSONLD": "{}", "e.md": "x" * 300}.items():
        (tmp_path / name).write_text(text)
    assert sorted(r.path.rsplit("/", 1)[1] for r in feeds.lint_files(spark, str(tmp_path), 200).collect()) == ["a.html", "b.txt", "d.JSONLD"]


def test_sitemap_round_trip(spark, tmp_path):
    urls = [f"https://a.example/?a={i}&b=<'\">" for i in range(50)]
    pages = spark.createDataFrame([(u, "", "2026-01-02") for u in urls], "url string, final_url string, lastmod string")
    sitemap.write(pages, str(tmp_path / "maps"))
    files = spark.read.text(str(tmp_path / "maps"), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    got = sitemap.urls(files).collect()
    assert sorted(r["loc"] for r in got) == sorted(urls) and {r.lastmod for r in got} == {"2026-01-02"}


def test_sitemap_files(spark):
    whole = b"<urlset><url><loc>a</loc></url></urlset>"
    rows = [("plain", 200, whole), ("zipped", 200, gzip.compress(whole)), ("none", None, None), ("moved", 301, whole)]
    got = {r.file: (r.body, r.error) for r in sitemap.read_file(spark.createDataFrame(rows, "file string, status int, raw binary")).collect()}
    assert got == {"plain": (whole.decode(), ""), "zipped": (whole.decode(), ""), "none": ("", "status 0"), "moved": ("", "status 301")}


def test_snapshots_keep_their_history(spark, tmp_path):
    rows = [("k1", "2026-01-01", "a"), ("k1", "2026-01-03", "b"), ("k2", "2026-01-02", "c")]
    snapshots = spark.createDataFrame(rows, "url_key string, day string, content_sha256 string").select("url_key", F.col("day").cast("timestamp").alias("timestamp"), "content_sha256")
    for one in (snapshots.where("content_sha256 = 'a'"), snapshots.where("content_sha256 <> 'a'")):
        drift.save(one, str(tmp_path / "store"))
    assert {(r.url_key, r.content_sha256) for r in drift.latest(spark.read.parquet(str(tmp_path / "store"))).collect()} == {("k1", "b"), ("k2", "c")}


def test_web_source_reaches_nothing_inside(spark):
    """A server on this machine isn't asked, whatever name it goes by."""
    asked = []

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(fetch.WebSource)
    port = server.server_address[1]
    rows = spark.read.format("web").option("urls", f"http://127.0.0.1:{port}/ http://localhost:{port}/").load().collect()
    server.shutdown()
    assert [(r.status, r.error) for r in rows] == [(0, "address isn't public")] * 2 and not asked


@pytest.mark.parametrize("body, blocked", [("User-agent: *\nDisallow: /", True), ("User-agent: *\nDisallow: /\nAllow: /", False), ("User-agent: *\nDisallow: /a", False), ("User-agent: x\nDisallow: /", False), ("User-agent: *\nDisallow: /\nAllow: /$", False), ("", False)])
def test_blocked_site(spark, body, blocked):
    assert robots.blocks_all(spark.createDataFrame([("s", body)], "site string, body string")).first().blocked == blocked


PAGE = "key string, host string, status int, final_key string, final_host string, noindex boolean"


def web(spark, pages):
    rows = [(k, "s", p.get("status", 200), p.get("final", k), p.get("host", "s"), False) for k, p in pages.items()]
    links = [(k, x) for k, p in pages.items() for x in p.get("links", "")]
    return spark.createDataFrame(rows, PAGE), spark.createDataFrame(links, "src string, dst string")


def run(spark, pages, blocked="", **more):
    got = crawl.site_crawl("a", *web(spark, pages), spark.createDataFrame([(k,) for k in blocked], "key string"), **more)
    return {r.key: r.depth for r in got.visits.collect()}, sorted(r.key for r in got.blocked.collect()), got.truncated


def test_site_crawl(spark):
    pages = {"a": {"links": "bcx"}, "b": {"status": 404, "links": "d"}, "c": {"final": "e", "links": "def"}, "d": {"host": "o", "links": "g"}, "e": {}, "f": {}, "g": {}, "x": {}}
    # e is where c landed, so it isn't asked again; what d and b link to is never met; y isn't in the snapshot
    assert run(spark, pages, "x") == ({"a": 0, "b": 1, "c": 1, "d": 2, "f": 2}, ["x"], False)
    assert run(spark, pages, "x", max_pages=2) == ({"a": 0, "b": 1}, ["x"], True)
    assert run(spark, pages, "a") == ({}, ["a"], False)
    assert run(spark, pages, "", robots_status=503) == ({}, ["a"], False) and run(spark, pages, "", robots_status=None) == ({}, ["a"], False)
    assert run(spark, pages, "x", robots_status=404)[0].keys() == set("abcdfx")


def test_whole_sites_are_crawled(spark, tmp_path, monkeypatch):
    """A site's budget is its number of pages, however many there are, unless a query states one."""
    from auditmill.operators import crawl
    from auditmill.plans import site_queries

    spark.range(120_000).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    asked = []
    real = crawl.Crawl(spark.createDataFrame([], "key string, depth int, status int, final_key string, noindex boolean"), None, False)
    monkeypatch.setattr(crawl, "site_crawl", lambda *a, max_pages, **k: asked.append(max_pages) or real)
    for name in ("crawl_site", "crawl_blocked_links", "crawl_sitemap_pages", "crawl_budget"):
        getattr(site_queries, name)(spark, str(tmp_path))
    assert asked == [120_000] * 3 + [30]


def test_keyword_chains(spark):
    """Keywords 0 to 11, each sharing five results with the next, are one cluster; 20 stands alone."""
    rows = [(k, r + 1, f"u{k * 5 + r}") for k in range(12) for r in range(10)] + [(20, r + 1, f"v{r}") for r in range(10)]
    got = {r.keyword: r.cluster for r in strategy.keyword_clusters(spark.createDataFrame(rows, "keyword long, rank int, url string")).collect()}
    assert got == {k: 0 for k in range(12)} | {20: 20}


def test_relative_references(spark):
    from urllib.parse import urljoin

    base = "https://h.example/dir/sub/page.html?q=1"
    hrefs = ["x", "./x", "../x", "../../x", "../../../x", "/a/../b", "/a/./b/..", "//o.example/z", "?n=2", "#f", "", "https://q.example/w", "x/y/../z?u=../v", "..", ".", "x#f", "/"]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", U.resolve(F.lit(base), F.col("h")).alias("r")).collect()
    assert {r.h: r.r for r in rows} == {h: urljoin(base, h).split("#")[0] for h in hrefs}


def test_keys_in_the_jvm(spark):
    urls = ["https://a.example/?utm%5Fsource=1&b=%zz&a", "HTTP://A.example/x?GCLID=1", "no url", "https://A.example/%7Euser", "http://a.example:80/a b/é?x=%C3%A9&a=1+2", "https://bücher.example/x", "https://a.example/a%2Fb/%7e", "https://a.example/%zz", "https://a.example/a+b%2Bc/(x)*!;=:@'$&,", "https://a.example/p?q=a%20b+c&q=a/b", "https://a.example/日本?k=日本"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.key_absolute(F.col("u")).alias("k"), U.normalize_absolute(F.col("u")).alias("n")).collect()
    assert {r.u: (r.k, r.n) for r in rows} == {u: (U.url_key(u), U.normalize_url(u)) for u in urls}


def test_patterns_by_their_heads(spark):
    """Wildcards match as a regular expression does, whatever the texts between them hold; long chains take no time."""
    import random
    import re

    from auditmill.sources import robots

    rng = random.Random(3)
    paths = ["/" + "".join(rng.choices("ab/.$?", k=rng.randrange(9))) for _ in range(80)] + ["/" + "a" * 2000, "/é%C3%A9/x"]
    patterns = ["/", "*", "/*", "$", "/$", "*$", "/a*b$", "/**a", "/a.b", "/a$b", "a", "/é*x$", "/é", "/" + "a*" * 60 + "$", "/" + "*a" * 60 + "b", ""] + ["".join(rng.choices("/ab*.$", k=rng.randrange(1, 7))) for _ in range(120)]
    rows = spark.createDataFrame([("s", p) for p in paths], "site string, path string"), spark.createDataFrame([("s", p, k) for k, p in enumerate(patterns)] + [("t", "/", -1)], "site string, pattern string, k int")
    got = {(r.path, r.pattern) for r in robots.matches(*rows).collect()}
    for pattern in set(patterns) - {""}:
        body = pattern.removesuffix("$")
        like = re.compile(".*".join(map(re.escape, re.sub(r"\*+", "*", body).split("*"))) + ("$" if pattern.endswith("$") else ""), re.S)
        for path in paths:
            if len(path) < 100 or pattern.count("*") < 9:
                assert ((path, pattern) in got) == bool(like.match(path) and (not pattern.endswith("$") or like.fullmatch(path))), (path, pattern)
    assert ("/" + "a" * 2000, "/" + "a*" * 60 + "$") in got and ("/" + "a" * 2000, "/" + "*a" * 60 + "b") not in got


def test_rules_that_begin_alike(spark):
    """A path meets the rules whose rarest text it holds, not all that begin as it does."""
    from auditmill.sources import robots

    n = 2000
    patterns = [f"/*/q{i}x*.gif$" for i in range(n)] + [f"*i{i}x*/end" for i in range(n)]
    paths = [f"/a/q{i}x/b.gif" for i in range(n)] + [f"/i{i}x/end" for i in range(n)]
    rows = spark.createDataFrame([("s", p) for p in paths], "site string, path string"), spark.createDataFrame([("s", p) for p in patterns], "site string, pattern string")
    assert robots.candidates(*rows).count() == 2 * n
    assert {(r.path, r.pattern) for r in robots.matches(*rows).collect()} == set(zip(paths, patterns, strict=True))


def test_both_forms_of_a_path(spark):
    from auditmill.sources import robots

    urls = spark.createDataFrame([("s", "https://s/caf%C3%A9/x"), ("s", "https://s/caf%C3%A9/x"), ("s", "https://s/b%20c"), ("s", "https://s/free"), ("u", "https://u/any")], "site string, url string")
    ruled = spark.createDataFrame([("s", "/café/", False), ("s", "/b%20c", False), ("s", "/b c", True)], "site string, pattern string, allow boolean")
    got = [(r.url, r.allowed) for r in robots.allowed_urls(urls, ruled).collect()]
    assert sorted(got) == [("https://s/b%20c", False), ("https://s/caf%C3%A9/x", False), ("https://s/caf%C3%A9/x", False), ("https://s/free", True), ("https://u/any", True)]


def test_numbers_in_two_levels(spark):
    from auditmill.shared import numbered

    rows = spark.range(500).selectExpr("(id * 7919) % 503 as k", "id as other").repartition(7)
    got = numbered(rows, "n", "k").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == list(range(500)) and got[0].asDict().keys() == {"k", "other", "n"}
    assert numbered(rows.where("false"), "n", "k").collect() == []


def test_health_of_repeated_urls(spark):
    """Each listed entry gets one verdict: its own fetch's, or the worst of those that can't be told apart."""
    from auditmill.sources import sitemap

    listed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "loc string, n int")
    answers = spark.createDataFrame([("a", 1, 200, 0), ("a", 2, 404, 0), ("b", 3, 200, 1)], "url string, n int, status int, hops int")
    own = sorted((r.loc, r.verdict) for r in sitemap.health(listed, answers, by=("n",)).collect())
    assert own == [("a", "broken"), ("a", "broken"), ("a", "ok"), ("b", "redirect")]
    assert sorted((r.loc, r.verdict) for r in sitemap.health(listed, answers).collect()) == [("a", "broken")] * 3 + [("b", "redirect")]


def test_batches_are_parsed_in_parts(spark):
    """Slices hold all rows in order and few bytes, a page is parsed once, whatever filters say of its facts."""
    import pyarrow as pa

    from auditmill.operators import rules
    from auditmill.shared import parts
    from auditmill.sources import html

    texts = pa.array(["x" * (k * 37 % 900) for k in range(500)] + [None, "y" * 9000, ""])
    for batch in (texts, texts.slice(3, 400), texts.slice(0, 0)):
        got = list(parts(batch, batch, most=4096))
        assert [x for a, _ in got for x in a.to_pylist()] == batch.to_pylist() and all(a.equals(b) for a, b in got)
        assert all(sum(len(x or "") for x in a.to_pylist()[1:]) <= 4096 for a, _ in got)
    pages = spark.createDataFrame([(k, f"<title>t{k}</title><p>the page {k}") for k in range(3000)], "page_id long, html string")
    rows = rules.content(html.parsed(pages), "the").where("units > 0").select("page_id", "hits", "facts.title")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parse_page(") == 1
    assert sorted((r.page_id, r.hits, r.title) for r in rows.collect()) == [(k, 1, f"t{k}") for k in range(3000)]
