"""How bytes become text and text becomes a tree: pages made from page_id, with one case for each way that it can go."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill.plans.registry import query, table
from auditmill.sources import fetch, html

#: Each case: markup with {i} for page_id, then what it holds: title, headings, paragraphs, links, images, lists, tables, words of the body.
TREES = [
    # raw text and text with references only
    ("<noscript><img src=p{i}><a href=x>n</a></noscript><p>one{i}", ("", "", "one{i}", 0, 0, 0, 0, "one{i}")),
    ("<body><p>two{i}<noscript><img src=p><h1>no</h1></noscript>", ("", "", "two{i} <img src=p><h1>no</h1>", 0, 0, 0, 0, "two{i}")),
    ("<textarea><h1>no</h1><img></textarea><h1>Yes {i}</h1>", ("", "1 Yes {i}", "", 0, 0, 0, 0, "<h1>no</h1><img> Yes {i}")),
    ("<title>a<b>{i}&lt;&amp</title><body>t", ("a<b>{i}<&", "", "", 0, 0, 0, 0, "a<b>{i}<& t")),
    ("<body><iframe><a href=x>f</a></iframe><xmp><p>x</xmp><a href=y>{i}</a>", ("", "", "", 1, 0, 0, 0, "<a href=x>f</a> <p>x {i}")),
    ("<script>if (a<b) document.write('<h1>no</h1><!--<script></script>-->')</script><style>h1>a{{}}</style><h2>S{i}</h2>", ("", "2 S{i}", "", 0, 0, 0, 0, "S{i}")),
    ("<p>p{i}<plaintext><a href=x>never", ("", "", "p{i}", 0, 0, 0, 0, "p{i} <a href=x>never")),
    # implied and missing tags
    ("<p>a{i}<p>b<div>c</div>d", ("", "", "a{i}|b", 0, 0, 0, 0, "a{i} b c d")),
    ("<ul><li>a{i}<li>b<ol><li>c</ol><li>d</ul><dl><dt>t<dd>d</dl>", ("", "", "", 0, 0, 2, 0, "a{i} b c d t d")),
    ("<h1>One{i}<h2>Two</h2>three", ("", "1 One{i}|2 Two", "", 0, 0, 0, 0, "One{i} Two three")),
    ("</p>x<br/>y</br>z{i}</p>", ("", "", "", 0, 0, 0, 0, "x y z{i}")),
    ("<button>a<p>b{i}<button>c", ("", "", "b{i}", 0, 0, 0, 0, "a b{i} c")),
    # tables
    ("<table>lost{i}<tr><td>a<td>b<tr><td>c</table>", ("", "", "", 0, 0, 0, 1, "lost{i} a b c")),
    ("<table><tr><a href=u>out{i}</a><td><a href=v>in</a></table>", ("", "", "", 2, 0, 0, 1, "out{i} in")),
    ("<table><td><table><td>in{i}</table>mid</table>out", ("", "", "", 0, 0, 0, 2, "in{i} mid out")),
    ("<table><caption>c<p>d{i}<col><tr><td>e</table>", ("", "", "d{i}", 0, 0, 0, 1, "c d{i} e")),
    ("<!doctype html><p>a{i}<table><td>b</table>c", ("", "", "a{i}", 0, 0, 0, 1, "a{i} b c")),
    ("<p>a{i}<table><td>b</table>c", ("", "", "a{i} b c", 0, 0, 0, 1, "a{i} b c")),
    ("<table><tr><td>a<select><option>o<td>b{i}</table>", ("", "", "", 0, 0, 0, 1, "a o b{i}")),
    # formatting that goes on, and is parted
    ("<p><a href=u>a{i}<p>b</a>c", ("", "", "a{i}|b c", 2, 0, 0, 0, "a{i} b c")),
    ("<a href=u>a<a href=v>b{i}</a>c", ("", "", "", 2, 0, 0, 0, "a b{i} c")),
    ("<b><i><p>x{i}</b>y</i>z", ("", "", "x{i} y z", 0, 0, 0, 0, "x{i} y z")),
    ("<a href=u><div>a{i}</a>b</div>", ("", "", "", 2, 0, 0, 0, "a{i} b")),
    # head, body and what comes after
    ("<meta name=x><title>t{i}</title>text<title>late</title>", ("t{i}", "", "", 0, 0, 0, 0, "t{i} text late")),
    ("<head></head><style>no</style><body><p>b{i}</body></html><p>after", ("", "", "b{i}|after", 0, 0, 0, 0, "b{i} after")),
    ("<frameset><frame><p>no</frameset><p>no{i}", ("", "", "", 0, 0, 0, 0, "")),
    ("<form><p>a<form><p>b{i}</form></form>c", ("", "", "a|b{i}", 0, 0, 0, 0, "a b{i} c")),
    # templates, drawings, formulas
    ("<template><tr><td><img><h1>no</h1></td></tr></template><h2>T{i}</h2>", ("", "2 T{i}", "", 0, 1, 0, 0, "T{i}")),
    ("<svg><title>draw</title><p>out{i}</svg><img>", ("draw", "", "out{i}", 0, 1, 0, 0, "out{i}")),
    ("<svg><style><a href=u>s</a></style><image/><![CDATA[<x>]]></svg><image src=i{i}>", ("", "", "", 1, 1, 0, 0, "")),
    ("<math><mi>m{i}<p>p</p></mi></math>q", ("", "", "p", 0, 0, 0, 0, "m{i} p q")),
    # tokens
    ("a < b{i} <3 <!-- <p> --!>c<!-->d<?pi?>e</ x>f", ("", "", "", 0, 0, 0, 0, "a < b{i} <3 c d e f")),
    ("<p class=a class=author>x{i}<a href='?a&copy=1&amp;b'title=t>l</a><a/href=z>", ("", "", "x{i} l", 2, 0, 0, 0, "x{i} l")),
    ("<p>end{i}<a href=u title='never closed", ("", "", "end{i}", 0, 0, 0, 0, "end{i}")),
]


def _chosen(values: list[str]) -> str:
    """SQL of the value for each page's case, {i} being page_id."""
    quoted = [" || CAST(page_id AS VARCHAR(20)) || ".join("'" + p.replace("'", "''") + "'" for p in v.split("{i}")) for v in values]
    return "CASE page_id % " + str(len(values)) + "".join(f" WHEN {k} THEN {q}" for k, q in enumerate(quoted)) + " END"


_MARKUP = _chosen([m.replace("{{", "{").replace("}}", "}") for m, _ in TREES])
_FACTS = ["title", "headings", "paragraphs", "links", "images", "lists", "tables", "body"]
_COLUMNS = [_chosen([str(facts[k]) for _, facts in TREES]) + f" AS {name}" for k, name in enumerate(_FACTS)]


@query(f"SELECT page_id, {', '.join(_COLUMNS)} FROM pages")
def page_tree_cases(spark, d):
    """Facts of pages for which each insertion mode, kind of text and way of mending matters."""
    f = html.parsed(table(spark, d, "pages").select("page_id", F.expr(_MARKUP).alias("html")))
    heads = F.array_join(F.transform("facts.headings", lambda h: F.concat_ws(" ", h.level, h.text)), "|")
    tidy = F.array_join(F.transform("facts.paragraphs", lambda p: F.regexp_replace(p, " +", " ")), "|")
    count = lambda c: c.cast("string")
    return f.select(
        "page_id", F.col("facts.title").alias("title"), heads.alias("headings"), tidy.alias("paragraphs"), count(F.size("facts.anchors")).alias("links"), count(F.size("facts.images")).alias("images"),
        count(F.col("facts.list_count")).alias("lists"), count(F.col("facts.table_count")).alias("tables"), F.col("facts.body_text").alias("body"),
    )


#: Each way: content type, markup before the text, the text, the codec of its bytes, the set that is found, and the text that comes out if that differs.
CODED = [
    ("text/html; charset=utf-8", "", "naïve — 日本 {i}", "utf-8", "utf-8", None),
    ("text/html", "", "naïve — 日本 {i}", "utf-8", "utf-8", None),
    ("text/html", "", "“naïve” — {i}…", "cp1252", "windows-1252", None),
    ("text/html; charset=ISO-8859-1", "", "“naïve” {i}", "cp1252", "windows-1252", None),
    ("text/html; charset=\"Shift_JIS\"", "", "日本語 ①{i}", "cp932", "shift_jis", None),
    ("text/html", "<meta charset=' EUC-JP '>", "日本語 {i}", "euc_jp", "euc-jp", None),
    ("text/html", "<!-- <meta charset=koi8-r> --><meta content='text/html; charset=windows-1251' http-equiv=Content-Type>", "Привет {i}", "cp1251", "windows-1251", None),
    ("text/html", "<script>'<meta charset=koi8-r>'</script><meta content='text/html; charset=koi8-u'>", "naïve {i}", "utf-8", "utf-8", None),
    ("text/html; charset=tis-620", "", "ไทย {i}", "cp874", "windows-874", None),
    ("text/html; charset=gb2312", "", "中文 €{i}", "gb18030", "gbk", None),
    ("text/html; charset=utf-8", "", "wide é {i}", "utf-16-le-bom", "utf-16le", None),
    ("text/html", "<meta charset=utf-16>", "naïve {i}", "utf-8", "utf-8", None),
    ("text/html; charset=nothing", "<meta charset=iso-8859-15>", "5 € {i}", "iso-8859-15", "iso-8859-15", None),
    ("text/plain", "<!DOCTYPE html><meta charset=big5>", "中文 {i}", "big5", "big5", None),
    ("text/plain", "", "naïve {i}", "cp1252", "", "na�ve {i}"),
    ("application/xml", "<?xml version='1.0' encoding='windows-1253'?>", "αβγ {i}", "cp1253", "windows-1253", None),
    ("application/rss+xml", "<?xml version='1.0'?>", "é {i}", "utf-8", "", None),
    ("text/html", "", "only ASCII {i}", "ascii", "windows-1252", None),
    ("text/html; charset=latin1", "", "\x81 and \x9d {i}", "latin-1", "windows-1252", None),
]


def _encoded(before: str, text: str, codec: str) -> str:
    """A SQL expression of the bytes; {i}, which is ASCII, stays a column."""
    wide = codec == "utf-16-le-bom"
    parts = (before + text).split("{i}")
    raw = [("﻿" * wide if k == 0 else "") + p for k, p in enumerate(parts)]
    lits = [f"X'{p.encode('utf-16-le' if wide else codec).hex()}'" for p in raw]
    number = f"encode(CAST(page_id AS STRING), '{'UTF-16LE' if wide else 'UTF-8'}')"
    return f" || {number} || ".join(lits)


_BODY = "CASE page_id % " + str(len(CODED)) + "".join(f" WHEN {k} THEN {_encoded(b, t, c)}" for k, (_, b, t, c, _, _) in enumerate(CODED)) + " END"
_HEADER = _chosen([h for h, *_ in CODED])


@query(f"SELECT page_id, {_chosen([n for *_, n, _ in CODED])} AS charset, sha256({_chosen([b + (out or t) for _, b, t, _, _, out in CODED])}) AS text_sha FROM pages")
def charset_labels(spark, d):
    """Bodies in many sets, declared rightly, wrongly, twice or not at all: the set that is found, and the text."""
    rows = table(spark, d, "pages").select("page_id", F.expr(_BODY).alias("body"), F.expr(_HEADER).alias("head"))
    return rows.select("page_id", fetch.charset_name("body", "head").alias("charset"), F.sha2(fetch.decoded("body", "head"), 256).alias("text_sha"))
