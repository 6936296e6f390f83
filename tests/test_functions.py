"""Scalar functions against known cases."""

import pytest
from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.functions import urls as U
from auditmill.sources import fetch, html


def column(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


SAME = [
    ("https://Example.com/a", "https://example.com:443/a"), ("https://example.com/a#x", "https://example.com/a"), ("/a?utm_source=x", "https://example.com/a"), ("https://example.com/?b=2&a=1", "https://example.com/?a=1&b=2"),
    ("https://example.com/物件", "https://example.com/%E7%89%A9%E4%BB%B6"), ("https://例え.jp/", "https://xn--r8jz45g.jp/"), ("https://example.com/a/", "https://example.com/a"), ("https://example.com/?a", "https://example.com/?a="),
]
OTHER = [("http://example.com/a", "https://example.com/a"), ("https://example.com/A", "https://example.com/a"), ("https://example.com/?page=2", "https://example.com/"), ("https://www.example.com/", "https://example.com/")]


def test_url_keys():
    base = "https://example.com/x"
    assert all(U.url_key(a, base) == U.url_key(b, base) for a, b in SAME)
    assert not any(U.url_key(a, base) == U.url_key(b, base) for a, b in OTHER)
    assert U.url_key("HTTPS://Example.COM:443?utm_source=x#f") == "https://example.com/" and U.normalize_url("HTTPS://Example.COM:443?utm_source=x#f") == "https://example.com/?utm_source=x"
    assert U.url_key("http://[::1", None) == "http://[::1"


def test_columns_agree_with_the_general_key(spark):
    urls = [u for pair in SAME + OTHER for u in pair if u.isascii() and u.startswith("http") and "%" not in u] + ["http://a.example:80//x//?b=&a1=2&a=9&gclid=1"]
    assert column(spark, U.key_absolute, *urls) == [U.url_key(u) for u in urls]


def test_same(spark):
    assert column(spark, lambda v: U.same(v, F.lit("https://example.com/a"), F.lit("https://example.com/")), "/a", "/b") == [True, False]


@pytest.mark.parametrize(("text", "keyword", "hits"), [("cat Cat CAT category indicate", "cat", 3), ("Tokyo property and tokyo  property", "tokyo property", 2), ("東京都の東京都", "東京都", 2), ("ＳＵＵＭＯ suumo", "suumo", 2), ("ｶﾀｶﾅとカタカナ", "カタカナ", 2), ("anything", "", 0), ("aa aa aa", "aa aa", 2)])
def test_keywords(text, keyword, hits):
    assert T.keyword_hits(text, keyword) == hits


def test_lengths(spark):
    mixed = "東京の物件をSUUMOで探す"
    assert column(spark, lambda v: T.length(v, F.lit("cjk")), mixed, "インターネット2026", "") == [10, 8, 0]
    assert column(spark, lambda v: T.length(v, F.lit("latin")), "Don't stop 2 me", "한국어 단어") == [5, 2]
    assert column(spark, T.display_width, "SUUMO", "ＳＵＵＭＯ", "カタカナ", "é") == [5, 10, 8, 1]
    assert column(spark, lambda v: T.first_units(v, F.lit("cjk"), 3), mixed, "ab") == ["東京の", "ab"]


def test_scripts(spark):
    texts = ["hello", "東京 tower is", "東京の物件", "한국어", "ภาษาไทย", "привет", "", "123", "한국 東京"]
    want = ["latin", "latin", "cjk", "hangul", "no-space", "latin", "latin", "latin", "cjk"]
    assert column(spark, T.classify, *texts) == want == [T.script_name(t) for t in texts]
    assert column(spark, lambda v: T.classify_with_hint(v, F.lit("ja-JP")), "", "tokyo", "tokyo 東") == ["cjk", "latin", "cjk"] == [T.script_name(t, "ja-JP") for t in ("", "tokyo", "tokyo 東")]


def test_links(spark):
    hrefs = ["", "#top", "MAILTO:x", "tel:1", "/a", "a/b", "//site.example/x", "//cdn.example/x", "https://SITE.example/z", "ftp://site.example/", "https://other.example/"]
    assert column(spark, lambda v: U.link_kind(v, F.lit("site.example")), *hrefs) == ["skipped"] * 4 + ["internal"] * 3 + ["external", "internal", "internal", "external"]


def test_addresses(spark):
    bad = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.169.254", "100.64.0.1", "0.0.0.0", "224.0.0.1", "300.1.1.1", "", "x"]
    good = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "192.169.0.1"]
    assert column(spark, U.blocked_ipv4, *bad, *good) == [True] * len(bad) + [False] * len(good)
    assert column(spark, U.blocked_address, "::1", "fe80::1", "::ffff:10.0.0.1", "2001:4860:4860::8888", *good) == [True] * 3 + [False] * (1 + len(good))


def test_bodies():
    assert fetch.decode_body("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert fetch.decode_body(b'<meta charset="windows-1252">\xe9').endswith("é")
    assert fetch.decode_body('<?xml version="1.0" encoding="utf-16-le"?>'.encode(), None)[:1]
    assert fetch.decode_body(None) == "" and fetch.decode_body(b"\xff", "charset=nothing") == "�"


def test_page_facts():
    page = """<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><meta name="Robots" content="googlebot: noindex, follow"><meta name="viewport" content="width=device-width"><link rel="canonical" href="/x"><link rel="canonical external" href="/no">
    <link rel="alternate" hreflang="pt-BR" href="/pt"><link rel="alternate" hreflang="englisch" href="/e"><script type=" Application/LD+json ">{"@type":"Person"}</script></head><body><h1><a>linked</a></h1><h2>One</h2><h4>Two</h4><p>First <b>bold<p>Second</p>
    <ul><li>a<li>b</ul><img src="a.webp" alt=""><img src="b.png"><svg><text>vector</text></svg><time datetime="2026-01-01">x</time><span class="post-byline">me</span><a href=" /y ">y</a></body>"""
    f = html.page_facts(page)
    assert (f["title"], f["lang"], f["canonical"], f["noindex"], f["h1"], f["h1_count"]) == ("A & B", "en", "/x", True, [], 1)
    assert [h["level"] for h in f["headings"]] == [1, 2, 4] and f["paragraphs"] == ["First  bold", "Second"] and f["list_count"] == 1
    assert [x["valid"] for x in f["hreflang"]] == [True, False] and f["jsonld"] == ['{"@type":"Person"}'] and f["anchors"] == ["/y"]
    assert [i["alt"] for i in f["images"]] == ["", None] and f["has_author"] and f["has_date"]
    assert "vector" not in f["body_text"] and "vector" in f["visible_text"] and f["body_text"].startswith("A & B")
    assert html.page_facts(None)["title"] == ""


def test_wide_characters_are_tried_within_their_span(spark):
    """The class holds exactly the wide characters, and tests the whole span before its many ranges."""
    import unicodedata

    from auditmill.functions import text as T

    assert T._wide().startswith("[\\x{1100}-") and "&&[" in T._wide()
    points = [c for c in range(0x20, 0x3FFFF, 7) if not 0xD800 <= c <= 0xDFFF]
    blocks = ["".join(map(chr, points[i : i + 500])) for i in range(0, len(points), 500)]
    want = [sum(unicodedata.east_asian_width(c) in "WF" and unicodedata.category(c) != "Mn" for c in b if c < "\U0003fffe" and c >= "ᄀ") for b in blocks]
    rows = spark.createDataFrame(list(enumerate(blocks)), "i int, s string").select("i", T._count(F.col("s"), T._wide()).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == want
