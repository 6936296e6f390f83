"""Snapshot files, the submission sink, and the entry points that read them."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from auditmill import api
from auditmill.functions import urls as U
from auditmill.operators import drift
from auditmill.sources import snapshots, submit


def _key(spark, url, legacy=False):
    c = F.lit(url)
    return spark.range(1).select(U.legacy_store_key(c) if legacy else U.store_key(U.key_absolute(c))).first()[0]


def _files_read(df):
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return len(rows), leaf.metrics().apply("numFiles").value()


def test_snapshot_files_are_chosen_by_name(spark, tmp_path):
    for n in range(30):
        (tmp_path / f"{n:016x}-{1000 + n}.json").write_text(json.dumps({"url": f"u{n}", "timestamp": "2026-01-01T00:00:00Z", "title": f"t{n}"}, indent=2))
    stored = snapshots.read(spark, str(tmp_path))
    assert _files_read(stored.where(F.col("url_key") == f"{7:016x}")) == (1, 1)
    assert _files_read(stored.where("taken >= 1025")) == (5, 5)
    assert _files_read(stored)[0] == 30


def test_snapshot_files_that_are_odd(spark, tmp_path):
    """Broken files and other names are left out; missing fields have empty values."""
    k = "0123456789abcdef"
    odd = {
        f"{k}-1.json": '{"url":"a","timestamp":"2026-01-01T00:00:00.5+02:00","h1":["x"]}', f"{k}-2.json": "{broken", f"{k}-3.json": "", f"{k}-4.json": "[1]",
        f"{k}-5.json": '{"url":"b","timestamp":"soon"}', f"{k}-6.json": '{"url":"c","word_count":"many"}', f"{k}-7.json": '{"url":null}', f"{k}-x.json": "{}", "short-8.json": "{}", f"{k}-9.txt": "{}",
    }
    for name, text in odd.items():
        (tmp_path / name).write_text(text)
    got = {r.taken: r for r in snapshots.read(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 7]
    one, bare = got[1], got[7]
    assert (one.url, one.h1, one.title, one.word_count) == ("a", ["x"], "", 0) and one.timestamp.isoformat() == "2025-12-31T22:00:00.500000"
    assert (bare.url, bare.schema_types, bare.status_code) == ("", [], 0) and bare.timestamp.timestamp() >= 0


def _snapshot(spark, rows):
    made = spark.createDataFrame(rows, "url_key string, at string, content_sha256 string, title string")
    text, none, n = F.lit(""), F.array().cast("array<string>"), F.lit(0).cast("long")
    more = {"url": F.col("title"), "status_code": F.lit(200), "meta_description": text, "canonical": text, "h1": none, "schema_types": none, "word_count": n, "image_count": n, "internal_links": n, "ttfb_ms": n}
    return made.withColumns({"timestamp": F.to_timestamp("at"), **more})


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """Small rows aren't merged into one task that writes all files."""
    rows = _snapshot(spark, [(f"{n:016x}", "2026-01-01 00:00:00", "h", "t") for n in range(60)]).coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files written")
    try:
        snapshots.save(rows, str(tmp_path / "s"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert max(tasks) >= 4 and len(list((tmp_path / "s").glob("*.json"))) == 60


def test_snapshots_saved_as_files(spark, tmp_path):
    """Names follow from rows; one second of a page holds one file; nothing is left of drafts."""
    k = "00000000000000aa"
    rows = [(k, "2026-01-01 00:00:00", "a", "first"), (k, "2026-01-01 00:00:00.5", "a", "later"), (k, "2026-01-02 00:00:00", "a", "x"), (k, "2026-01-02 00:00:00", "b", "y"), (k, "2026-01-02 00:00:00", "b", "y")]
    store = tmp_path / "store"
    for _ in range(2):
        snapshots.save(_snapshot(spark, rows), str(store))
    assert sorted(p.name for p in store.iterdir()) == [f"{k}-1767225600.json", f"{k}-1767312000.json"]
    got = {(r.title, str(r.timestamp)) for r in snapshots.read(spark, store.as_uri()).collect()}
    assert got == {("later", "2026-01-01 00:00:00.500000"), ("y", "2026-01-02 00:00:00")}
    empty = tmp_path / "none"
    empty.mkdir()
    snapshots.save(_snapshot(spark, rows).limit(0), str(empty))
    assert snapshots.read(spark, str(empty)).count() == 0


def test_history_goes_back_to_old_keys(spark, tmp_path):
    """Files under the old key count only where the page's own key has none."""
    a, b = "https://h.example/A/", "https://h.example/B/"
    rows = [(_key(spark, a), "2026-01-02 00:00:00", "1", "a2"), (_key(spark, a, True), "2026-01-01 00:00:00", "1", "a1"), (_key(spark, b, True), "2026-01-01 00:00:00", "1", "b1")]
    snapshots.save(_snapshot(spark, rows), str(tmp_path))
    pages = spark.createDataFrame([(a,), (b,), (b,), (None,), ("https://h.example/c",)], "url string")
    assert sorted((r.page, r.title) for r in snapshots.history(snapshots.read(spark, str(tmp_path)), pages).collect()) == [(a, "a2"), (b, "b1")]


def test_history_opens_files_once(spark, tmp_path):
    """What is made of a history reads a table written from the files, not the files again; a page's own key wins over several old files."""
    a, b = "https://h.example/A/", "https://h.example/B/"
    rows = [(_key(spark, a), f"2026-01-0{n} 00:00:00", "1", f"a{n}") for n in (1, 2)] + [(_key(spark, x, True), f"2026-01-0{n} 00:00:00", "1", f"old{n}") for x in (a, b) for n in (3, 4)]
    snapshots.save(_snapshot(spark, rows), str(tmp_path))
    got = snapshots.history(snapshots.read(spark, str(tmp_path)), spark.createDataFrame([(a,), (b,)], "url string"))
    assert not [f for f in got.inputFiles() if f.endswith(".json")]
    assert sorted((r.page, r.title) for r in got.collect()) == [(a, "a1"), (a, "a2"), (b, "old3"), (b, "old4")]
    assert got.columns[:2] == ["url_key", "page"]


def test_files_keep_their_bytes(spark, tmp_path):
    """Texts beyond ASCII come back as they were."""
    k = "00000000000000ab"
    snapshots.save(_snapshot(spark, [(k, "2026-01-01 00:00:00", "h", "né\u2028日本 \U0001f600")]), str(tmp_path))
    assert [r.title for r in snapshots.read(spark, str(tmp_path)).collect()] == ["né\u2028日本 \U0001f600"]


def test_changes_against_files(spark, tmp_path):
    page = lambda title: spark.createDataFrame([("https://h.example/A", f"<html><head><title>{title}</title></head><body><p>x</p></body></html>", 200, 5)], "url string, html string, status int, ttfb_ms long")
    snapshots.save(drift.capture(api.html.parsed(page("one")), "2026-01-01"), str(tmp_path))
    assert api.changes(page("one"), str(tmp_path)).count() == 0
    got = {r.field: (r.before, r.after) for r in api.changes(page("two"), str(tmp_path)).where("field <> 'content_sha256'").collect()}
    assert got == {"title": ("one", "two")}


def test_batches_have_a_limit(spark):
    urls = [(f"https://hot.example:8443/{i:03}",) for i in range(45)] + [("https://B.example/x",), ("https://b.example/x",), (None,), ("/none",)] + [("https://hot.example:8443/000",)] * 9
    got = submit.batches(spark.createDataFrame(urls, "url string"), "k", size=20).collect()
    assert sorted((r.host, r.batch, r.urls) for r in got) == [("b.example", 0, 2), ("hot.example", 0, 20), ("hot.example", 1, 20), ("hot.example", 2, 5)]
    sent = [u for r in got for u in json.loads(r.body)["urlList"]]
    assert sorted(sent) == sorted({u for u, in urls if u and ":" in u})
    assert submit.batches(spark.createDataFrame([], "url string"), "k").count() == 0


@pytest.fixture
def endpoint():
    asked = []

    class Index(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers["Content-Type"], body))
            self.send_response({"a.example": 200, "b.example": 202, "c.example": 422}[body["host"]])
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/indexnow", asked
    server.shutdown()
    server.server_close()


def test_batches_are_sent(spark, tmp_path, endpoint):
    at, asked = endpoint
    rows = submit.batches(spark.createDataFrame([(f"https://{h}.example/{i}",) for h in "abc" for i in range(3)], "url string"), "key1", size=2)
    submit.send(rows, str(tmp_path / "status"), at, private=True)
    got = {(r.host, r.batch): (r.urls, r.status, r.accepted, r.error) for r in submit.statuses(spark, str(tmp_path / "status")).collect()}
    answers = {"a.example": (200, True, ""), "b.example": (202, True, ""), "c.example": (422, False, "")}
    assert got == {(h, b): (2 - b, *a) for h, a in answers.items() for b in (0, 1)}
    assert len(asked) == 6 and {k for k, _ in asked} == {"application/json; charset=utf-8"} and {b["key"] for _, b in asked} == {"key1"}
    # a second round adds its rows to the first's
    submit.send(rows.where("host = 'a.example'"), str(tmp_path / "status"), at, private=True)
    assert submit.statuses(spark, str(tmp_path / "status")).count() == 8


def test_nothing_is_sent_inside(spark, tmp_path, endpoint):
    """An endpoint on an address that isn't public isn't asked; the batch's row says why."""
    at, asked = endpoint
    submit.send(submit.batches(spark.createDataFrame([("https://a.example/",)], "url string"), "k"), str(tmp_path / "s"), at)
    (row,) = submit.statuses(spark, str(tmp_path / "s")).collect()
    assert (row.status, row.accepted, row.error) == (0, False, "address isn't public") and asked == []


def test_a_failed_task_leaves_no_status(spark, tmp_path, endpoint):
    at, _ = endpoint
    rows = spark.createDataFrame([("a.example", 0, 1, '{"host":"a.example"}'), ("a.example", 1, 1, None)], "host string, batch long, urls long, body string")
    with pytest.raises(Exception, match="encode"):
        submit.send(rows.coalesce(1), str(tmp_path / "s"), at, private=True)
    assert submit.statuses(spark, str(tmp_path / "s")).count() == 0


def test_entry_points(spark):
    fetches = spark.createDataFrame([("http://a.example/", "https://a.example/", 404, {"X-Robots-Tag": ["noindex"]}, [("http://a.example/", 302)], 900)], "url string, final_url string, status int, headers map<string,array<string>>, redirects array<struct<url:string,status:int>>, ttfb_ms long")
    assert {"R-H2", "R-H7", "R-H9", "R-H13"} <= {r.rule for r in api.audit_headers(fetches).collect()}
    files = spark.createDataFrame([("s", "User-agent: GPTBot\nDisallow: /")], "site string, body string")
    assert {r.bot: r.status for r in api.robots(files).collect()}["GPTBot"] == "Disallowed"
    maps = spark.createDataFrame([("m", "<sitemapindex><sitemap><loc>n</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"), ("n", "<urlset><url><loc>u</loc></url></urlset>"), ("o", "<urlset><url><loc>v</loc></url></urlset>")], "file string, body string")
    listed, whole = api.sitemaps(spark.createDataFrame([("m",)], "file string"), maps)
    assert [(r.file, r["loc"]) for r in listed.collect()] == [("n", "u")] and [r.complete for r in whole.collect()] == [False]
