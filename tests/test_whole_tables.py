"""Queries that once took a part of their table: every row has its result."""

import re
import unicodedata
from urllib.parse import urlsplit

from auditmill.plans.catalogue import QUERIES


def test_report_of_every_page(spark, tmp_path):
    pages = [(5, "https://a.example/", "<html><title>A</title><p>x"), (6, "https://b.example/?a=1&b=<", "<h1>B</h1>"), (7, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url: r.html for r in QUERIES["html_report"](spark, str(tmp_path)).collect()}
    assert set(got) == {u for _, u, _ in pages}
    assert "<title>https://a.example/</title>" in got["https://a.example/"] and "<td>No title" not in got["https://a.example/"]
    assert "a=1&amp;b=&lt;" in got["https://b.example/?a=1&b=<"] and "<td>No title" in got["https://b.example/?a=1&b=<"]


def test_keyword_in_every_language(spark, tmp_path):
    docs = [(1, "The cat, the dog; other", "en"), (2, "THE Ｔｈｅ thé", "fr"), (3, "the", None), (4, None, "en"), (5, "日本 the 語 athe", "ja")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: sum(w == "the" for w in re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())) for d, t, _ in docs}
    got = QUERIES["doc_keyword_all"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.hits, r.found) for r in got} == {d: (n, n > 0) for d, n in want.items()} and want[2] == 2


def test_tracking_of_every_url(spark, tmp_path):
    queries = ["gclid=1&a=2", "fbclid=x", "a=1&UTM_Source=b&msclkid=2", "", "a=1&b=2", "gclidx=1", "_ga=1&_gl=2&yclid=3&mc_cid=4&mc_eid=5"]
    pages = [(i, "https://a.example/x" + (q and f"?{q}"), "") for i, q in enumerate(queries)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    known = {"gclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl"}
    names = {i: [p.split("=")[0].lower() for p in urlsplit(u).query.split("&") if p] for i, u, _ in pages}
    want = {i: (len(n), sum(x in known or x.startswith("utm_") for x in n)) for i, n in names.items()}
    got = QUERIES["tracking_params_all"](spark, str(tmp_path)).collect()
    assert {r.page_id: (r.params, r.stripped) for r in got} == want
    assert {r.page_id: r.changed for r in got} == {i: n > 0 for i, (_, n) in want.items()}
