"""Audits and relational operators on small cases."""

from pyspark.sql import functions as F

from auditmill.operators import crawl, drift, jsonld, rules, site
from auditmill.sources import feeds, html, robots, sitemap

PAGE = "url string, key string, final_key string, status int, error string, depth int, hops int, is_html boolean, noindex boolean, title string, description string, text_hash string, canonical string, canonical_key string"


def page(n, **kw):
    row = {"url": f"https://s/{n}", "status": 200, "error": "", "depth": 1, "hops": 0, "is_html": True, "noindex": False, "title": f"t{n}", "description": f"d{n}", "text_hash": "", "canonical": ""} | kw
    row["key"] = row.get("key", row["url"])
    row["final_key"] = row.get("final_key", row["key"])
    row["canonical_key"] = row["canonical"]
    return tuple(row[c.split()[0]] for c in PAGE.split(", "))


def test_broken_links(spark):
    pages = spark.createDataFrame([page(0), page(1, status=404), page(2, status=0, error="timeout"), page(3, status=403), page(4, status=503), page(5, status=500)], PAGE)
    links = spark.createDataFrame([(f"https://s/{a}", f"https://s/{b}") for a, b in ((0, 1), (0, 1), (3, 1), (0, 2), (0, 3), (0, 4), (5, 5))], "src_key string, dst_key string")
    assert {(r.url, r.detail) for r in site.broken_links(pages, links).collect()} == {("https://s/1", "404 2"), ("https://s/2", "0 1")}


def test_canonicals(spark):
    pages = spark.createDataFrame([page(0, canonical="https://s/1"), page(1, status=404), page(2, canonical="https://s/3"), page(3, noindex=True), page(4, canonical="https://s/5"), page(5, hops=1, final_key="https://s/9"), page(6, canonical="https://o/6"), page(7, canonical="https://s/77"), page(8, canonical="https://s/8")], PAGE)
    assert {(r.url[-1], r.kind) for r in site.canonical_kinds(pages).collect()} == {("0", "not-200"), ("2", "noindex"), ("4", "redirects"), ("6", "elsewhere"), ("7", "unverified")}


def test_distinct_pages(spark):
    pages = spark.createDataFrame([page(0, final_key="x", hops=1), page(1, final_key="x"), page(2, final_key="y", hops=2), page(3, final_key="y", hops=1)], PAGE)
    assert sorted(r.url[-1] for r in site.distinct_pages(pages).collect()) == ["1", "2"]


def test_reciprocity(spark):
    pages = spark.createDataFrame([page(i) for i in range(4)] + [page(4, status=404)], PAGE)
    pairs = [(0, 1), (1, 0), (0, 2), (2, 2), (3, 4), (3, 9)]
    alternates = spark.createDataFrame([(f"https://s/{a}", f"https://s/{b}") for a, b in pairs], "src_key string, dst_key string")
    assert {(r.src_key[-1], r.dst_key[-1], r.kind) for r in site.alternate_kinds(pages, alternates).collect()} == {("0", "1", "fine"), ("1", "0", "fine"), ("0", "2", "one-way"), ("3", "4", "not-200"), ("3", "9", "unverified")}


def test_crawl_budget_and_robots(spark):
    snapshot = spark.createDataFrame([(k, 404 if k == "c" else 200, "s") for k in "abcdef"], "key string, status int, host string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("d", "f"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "key string")
    run = lambda **k: {r.key: r.depth for r in crawl.crawl(seeds, snapshot, links, **k).collect()}
    assert run() == {"a": 0, "b": 1, "c": 1, "d": 2, "f": 3}
    assert run(max_pages=2) == {"a": 0, "b": 1}
    assert run(allowed=spark.createDataFrame([("a",), ("c",), ("b",)], "key string")) == {"a": 0, "b": 1, "c": 1}


def test_robots(spark):
    files = spark.createDataFrame([("s", "User-agent: *\nDisallow: /*.pdf$\nDisallow: /tmp*\nDisallow: /exact$\nDisallow: /a\nAllow: /a/b\nAllow: /same\nDisallow: /same\n")], "site string, body string")
    want = {"/x.pdf": False, "/x.pdf?a": True, "/tmp/1": False, "/exact": False, "/exactly": True, "/a/c": False, "/a/b": True, "/same": True, "/": True, "/a.b+c": False}
    paths = spark.createDataFrame([("s", p) for p in want], "site string, path string")
    assert {r.path: r.allowed for r in robots.verdicts(paths, robots.rules(robots.groups(files))).collect()} == want


def test_samples(spark):
    one = spark.createDataFrame([("f", i) for i in range(100)], "file string, pos int")
    assert [r.pos for r in sitemap.sample(one, 4).collect()] == [0, 25, 50, 75]
    many = spark.createDataFrame([(f"f{k}", i) for k in range(5) for i in range(30)], "file string, pos int")
    assert {r.file for r in sitemap.sample(many, 5).collect()} == {f"f{k}" for k in range(5)}
    assert [r.file for r in sitemap.sample(many, 2).collect()] == ["f0", "f2"] and sitemap.clamp(500, 10, 100) == 100 and sitemap.clamp(None, 10, 100) == 10


def test_image_audit(spark):
    tags = '<img src="a.jpg"><img src="b.png" alt=""><img src="c.gif" alt="c" width=1 height=1><img src="d.webp" alt="d" loading="lazy" width=1 height=1><img src="http://x/e.jpeg" alt="e" width=1 height=1><img src="data:' + "x" * 11000 + '" alt="f" width=1 height=1>'
    r = rules.images(html.parsed(spark.createDataFrame([(tags,)], "html string"))).first()
    assert (r.total, r.missing_alt, r.decorative, r.no_size, r.lazy, r.modern, r.legacy, r.insecure, r.data_uris, r.large_data, r.score) == (6, 1, 1, 2, 1, 1, 4, 1, 1, 1, 100 - 5 - 6 - 2 - 5)


def test_content_audit(spark):
    page = "<html lang=en><meta name=author content=me><h1>A</h1><h2>B</h2><h4>C</h4><p>" + "word " * 50 + "</p><p>" + "long " * 160 + "</p><ul><li>x</ul>"
    r = rules.content(html.parsed(spark.createDataFrame([(page,)], "html string")), "word").first()
    assert (r.units, r.long_paragraphs, r.answers, r.citations, r.skips, r.minutes, r.hits) == (214, 1, 1, 1, 1, 1, 50)
    assert {i.rule for i in r.issues} == {"R-C1b", "R-C2", "R-C3", "R-C6", "R-C9"} and r.score == 100 - 15 - 1 - 3 - 5 - 10


def test_jsonld():
    kinds = lambda raw: [(f["rule"], f["field"]) for f in jsonld.validate(raw)]
    assert kinds("{") == [("invalid-json", "")] and kinds('{"name":"x"}') == [("missing-type", "")]
    assert kinds('{"@type":["Product","Offer"],"name":"[Your Name]","image":"i","offers":{"@type":"AggregateOffer","lowPrice":1}}') == [("offer-field", "priceCurrency"), ("placeholder", "name")]
    assert kinds('{"@graph":[{"@type":"HowTo"},{"@type":"Person","name":""}]}') == [("deprecated", ""), ("missing-field", "name")]
    gate = lambda raw: [(f["rule"], f["severity"]) for f in jsonld.lint(raw)]
    assert gate('{"@context":"c","@graph":[{"@type":"Person","name":"TODO"}]}') == [("missing-context", "warn"), ("placeholder", "block")]
    assert gate('{"@context":"c","@type":"CourseInfo"}') == [("deprecated", "block")]


def test_drift(spark):
    make = lambda t, ms: spark.createDataFrame([("k", t, ms)], "url_key string, title string, ttfb_ms long")
    got = {(r.field, r.significant) for r in drift.compare(make("b", 1500), make("a", 600), ("title",)).collect()}
    assert got == {("title", True), ("ttfb_ms", True)}
    assert [r.significant for r in drift.compare(make("a", 1400), make("a", 1000), ("title",)).collect()] == [False]


def test_drift_store(spark, tmp_path):
    rows = spark.createDataFrame([("ab1", "2026-01-01", "x"), ("ab1", "2026-01-02", "y"), ("cd2", "2026-01-01", "z")], "url_key string, timestamp string, content_sha256 string")
    drift.save(rows, str(tmp_path / "s"))
    drift.save(rows.limit(1), str(tmp_path / "s"))
    assert {(r.url_key, r.content_sha256) for r in drift.latest(spark.read.parquet(str(tmp_path / "s"))).collect()} == {("ab1", "y"), ("cd2", "z")}


def test_field_data(spark):
    body = '{"record":{"metrics":{"largest_contentful_paint":{"percentilesTimeseries":{"p75s":[2500,null,"2300"]}}}}}'
    assert [r.p75 for r in feeds.crux_history(spark.createDataFrame([("u", body)], "url string, body string")).collect()] == ["2500", None, "2300"]


def test_redirects(spark):
    hops = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("c", None, False), ("d", None, True), ("e", "e", True)], "url string, target string, redirects boolean")
    got = {r.url: (r.final_url, r.hops, r.error) for r in crawl.resolve_redirects(hops.select("url"), hops).collect()}
    assert got == {"a": ("c", 2, ""), "b": ("c", 1, ""), "c": ("c", 0, ""), "d": ("d", 0, "redirect without location"), "e": ("e", 10, "too many redirects")}


def test_llms(spark):
    rows = spark.createDataFrame([("# T\n\n## S\n[a](https://x)", True), ("no title", False), (None, False)], "body string, has_full boolean")
    assert [(r.sections, r.score) for r in rules.llms(rows).collect()] == [(2, 100), (0, 70), (None, 0)]


def test_gate(spark):
    found = spark.createDataFrame([("WARNING",), ("INFO",)], "severity string")
    assert not rules.trips(found, "critical").first().failed and rules.trips(found, "warning").first().failed
    assert rules.severity_counts(found.union(spark.createDataFrame([("odd",)], "s string"))).first().info == 2


def test_summary_order(spark):
    rows = [("Deep pages", "INFO", "u", "")] * 3 + [("Broken links", "CRITICAL", "u", "")] + [("Orphans", "WARNING", f"u{i:02}", "") for i in range(30)]
    out = site.summary(spark.createDataFrame(rows, "category string, severity string, url string, detail string")).collect()
    assert [(r.category, r.affected) for r in out] == [("Broken links", 1), ("Orphans", 30), ("Deep pages", 3)] and len(out[1].sample.split()) == 20


def test_clusters_of_hot_results(spark):
    """Keywords that share three results with all others, and four with some: links are those of all pairs, and their number stays small."""
    import random
    from itertools import combinations

    from auditmill.operators import strategy

    rng = random.Random(4)
    results = {k: ["hot1", "hot2", "hot3"] + rng.sample([f"u{i}" for i in range(40)], rng.randrange(0, 6)) + [f"own{k}"] for k in range(60)}
    rows = [(k, r + 1, u) for k, us in results.items() for r, u in enumerate(us[:10])] + [(0, 11, "u1"), (None, 1, "hot1")]
    got = strategy.keyword_clusters(spark.createDataFrame(rows, "keyword long, rank int, url string").where("keyword is not null")).collect()
    label = {k: k for k in results}
    for _ in results:
        for x, y in combinations(results, 2):
            if len(set(results[x]) & set(results[y])) >= 4:
                label[x] = label[y] = min(label[x], label[y])
    assert {r.keyword: r.cluster for r in got} == label
    everyone = spark.range(3000).selectExpr("id as keyword", "explode(sequence(1, 10)) as rank").selectExpr("keyword", "rank", "concat('same', rank) as url")
    assert strategy.shared_results(everyone).count() == 2 * 2999


def test_choices_stay_off_the_driver(spark):
    """Results and choices multiply the rows of a small file: no join may send them through the driver."""
    from auditmill.operators import strategy

    rows = spark.createDataFrame([(k, r, f"u{k // 6 * 10 + r}") for k in range(40) for r in range(1, 11)], "keyword long, rank int, url string")
    links = strategy.shared_results(rows)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert {(r.x, r.y) for r in links.collect()} >= {(0, 1), (1, 0), (0, 5), (6, 7)}


def test_results_of_few_keywords_are_not_chosen_from(spark):
    """Groups of six keywords with the same results in a chain: a stage shuffles a few rows a keyword, not its 210 choices of four."""
    from auditmill.operators import strategy

    n = 1200
    rows = spark.range(n).selectExpr("id as keyword", "explode(sequence(1, 10)) as rank").selectExpr("keyword", "rank", "concat('u', keyword div 6 * 5 + rank) as url")
    spark.sparkContext.setJobGroup("clusters", "clusters of a chain")
    try:
        got = strategy.keyword_clusters(rows).groupBy("cluster").count().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in got] == [(0, n)]
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("clusters") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    most = max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 10 * n <= most <= 100 * n


def test_clusters_of_results_of_few_and_many(spark):
    """Results of one, few and more than FEW keywords mixed, some null and some listed twice: clusters are those of all pairs."""
    import random
    from itertools import combinations

    from auditmill.operators import strategy

    rng = random.Random(7)
    lists = {f"k{k:03}": rng.sample([f"hot{i}" for i in range(8)], rng.randrange(0, 5)) + rng.sample([f"u{i}" for i in range(60)], rng.randrange(0, 4)) + [f"v{k // 3 * 3 + i}" for i in range(rng.randrange(0, 5))] for k in range(150)}
    rows = [(k, r + 1, u) for k, us in lists.items() for r, u in enumerate(us[:10])] + [("k000", 9, None), ("k001", 10, "hot1"), ("k002", 10, "hot1"), ("alone", 1, None)]
    label = {k: k for k, _, _ in rows}
    sets = {k: {u for q, _, u in rows if q == k and u} for k in label}
    pairs = [(x, y) for x, y in combinations(sets, 2) if len(sets[x] & sets[y]) >= 4]
    for _ in label:
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    got = strategy.keyword_clusters(spark.createDataFrame(rows, "keyword string, rank int, url string")).collect()
    assert {r.keyword: r.cluster for r in got} == label and 5 < len(set(label.values())) < 145
    assert not strategy.keyword_clusters(spark.createDataFrame([("a", 1, "x")], "keyword string, rank int, url string")).where("keyword <> cluster").count()
