"""Audits of single pages, on parsed facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.functions import urls as U
from auditmill.operators import report, rules
from auditmill.plans.registry import query, table
from auditmill.plans.url_queries import URLS
from auditmill.sources import html

_DECODE = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TITLE = f"trim({_DECODE('''regexp_extract(html, '(?s)<title>(.*?)</title>', 1)''')})"
_WIDTH = rf"(length({_TITLE}) - len(regexp_extract_all({_TITLE}, '\p{{Mn}}')))"
_BAD = f"CASE WHEN {_TITLE} = '' THEN 20 WHEN {_WIDTH} NOT BETWEEN 30 AND 60 THEN 5 ELSE 0 END"
_H1 = "len(regexp_extract_all(html, '<h1'))"
_TECHNICAL = f"100 - ({_BAD}) - 10 - 10 - 15 - CASE WHEN {_H1} = 0 THEN 10 ELSE 0 END"
_BODY = _DECODE(r"regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')")
_UNITS = rf"len(regexp_extract_all({_BODY}, '[\p{{L}}\p{{Nd}}]+'))"
_HREFS = "(SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages)"


def facts(spark, d):
    return html.parsed(table(spark, d, "pages"))


@query(f"SELECT page_id, {_TITLE} AS title, CAST({_WIDTH} AS BIGINT) AS title_width, {_H1} AS h1_count, CAST({_TECHNICAL} AS BIGINT) AS score FROM pages")
def page_technical(spark, d):
    return rules.technical(facts(spark, d)).select("page_id", F.col("facts.title").alias("title"), "title_width", F.col("facts.h1_count").alias("h1_count"), "score")


@query(f"SELECT page_id, {_WIDTH} BETWEEN 30 AND 60 AS fits, CAST({_WIDTH} AS BIGINT) AS width FROM pages WHERE {_TITLE} <> ''")
def title_width_check(spark, d):
    rows = facts(spark, d).select("page_id", T.display_width(F.col("facts.title")).alias("width"), "facts.title").where("title <> ''")
    return rows.select("page_id", F.col("width").between(T.TITLE_MIN, T.TITLE_MAX).alias("fits"), "width")


@query(f"""SELECT rule, severity, category, count(*) AS pages FROM (
 SELECT 'R-T1' AS rule, 'CRITICAL' AS severity, 'Title' AS category FROM pages WHERE {_TITLE} = '' UNION ALL SELECT 'R-T2', 'WARNING', 'Title' FROM pages WHERE {_TITLE} <> '' AND {_WIDTH} NOT BETWEEN 30 AND 60
 UNION ALL SELECT 'R-T3', 'WARNING', 'Description' FROM pages UNION ALL SELECT 'R-T6', 'WARNING', 'Canonical' FROM pages UNION ALL SELECT 'R-T7', 'CRITICAL', 'Mobile' FROM pages
 UNION ALL SELECT 'R-T8', 'WARNING', 'Headings' FROM pages WHERE {_H1} = 0 UNION ALL SELECT 'R-T8b', 'INFO', 'Headings' FROM pages WHERE {_H1} > 1) GROUP BY ALL""")
def issue_histogram(spark, d):
    return rules.issues(rules.technical(facts(spark, d)), "page_id").groupBy("rule", "severity", "category").agg(F.count("*").alias("pages"))


@query(f"SELECT count(*) * 2 AS critical, 0::BIGINT + (SELECT count(*) FROM pages WHERE {_TITLE} <> '' AND {_WIDTH} NOT BETWEEN 30 AND 60) + 2 * count(*) AS warning, 0::BIGINT AS info, 0::BIGINT AS passed FROM pages".replace("count(*) * 2 AS critical", f"count(*) + (SELECT count(*) FROM pages WHERE {_TITLE} = '') AS critical"))
def severity_summary(spark, d):
    return rules.severity_counts(rules.issues(rules.technical(facts(spark, d)), "page_id"))


@query("SELECT true AS failed")
def fail_on_gate(spark, d):
    return rules.trips(rules.issues(rules.technical(facts(spark, d)), "page_id"), "critical")


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM {_HREFS}")
def page_links(spark, d):
    return html.links(facts(spark, d), "page_id")


@query(f"""SELECT page_id, count(*) FILTER (WHERE kind = 'internal') AS internal, count(*) FILTER (WHERE kind = 'external') AS external, count(*) FILTER (WHERE kind = 'skipped') AS skipped FROM
 (SELECT page_id, CASE WHEN pos = 1 THEN 'skipped' WHEN pos = 2 THEN 'external' ELSE 'internal' END AS kind FROM {_HREFS}) GROUP BY page_id""")
def link_classification(spark, d):
    """The second link of each page is made a mail address, the third one a page elsewhere."""
    rows = facts(spark, d).select("page_id", U.host_of(F.col("url")).alias("host"), F.posexplode("facts.anchors").alias("pos", "href"))
    rows = rows.withColumn("href", F.when(F.col("pos") == 1, "MailTo:a@b.example").when(F.col("pos") == 2, F.concat(F.lit("HTTP://elsewhere.invalid"), "href")).otherwise(F.col("href")))
    kind = U.link_kind(F.col("href"), F.col("host"))
    return rows.groupBy("page_id").agg(*[F.count_if(kind == k).alias(k) for k in ("internal", "external", "skipped")])


@query(f"SELECT host, lower({_TITLE}) AS title, count(*) AS pages, min(url) AS first_url FROM {URLS} WHERE {_TITLE} <> '' GROUP BY ALL HAVING count(*) > 1")
def dup_titles_site(spark, d):
    rows = facts(spark, d).select(U.host_of(F.col("url")).alias("host"), F.lower("facts.title").alias("title"), "url").where("title <> ''")
    return rows.groupBy("host", "title").agg(F.count("*").alias("pages"), F.min("url").alias("first_url")).where("pages > 1")


@query(f"SELECT page_id, {_UNITS} AS units, CAST({_UNITS} // 220 + CASE WHEN {_UNITS} % 220 > 110 THEN 1 ELSE 0 END AS BIGINT) AS minutes, CASE WHEN {_UNITS} < 150 THEN 'CRITICAL' WHEN {_UNITS} < 300 THEN 'WARNING' ELSE '' END AS depth FROM pages")
def page_content(spark, d):
    depth = F.get(F.filter("issues", lambda i: i.category == "Depth"), F.lit(0))
    return rules.content(facts(spark, d)).select("page_id", "units", "minutes", F.coalesce(depth["severity"], F.lit("")).alias("depth"))


_THE = f"len(list_filter(string_split(regexp_replace(lower({_BODY}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda x: x = 'the'))"


@query(f"SELECT page_id, {_THE} AS hits, CASE WHEN 100.0 * {_THE} / {_UNITS} > 3.0 THEN 'R-C9' WHEN 100.0 * {_THE} / {_UNITS} < 0.3 THEN 'R-C9b' ELSE '' END AS density FROM pages WHERE {_UNITS} > 0")
def page_keyword(spark, d):
    rows = rules.content(facts(spark, d), "the").where("units > 0")
    found = F.get(F.filter("issues", lambda i: i.rule.startswith("R-C9")), F.lit(0))
    return rows.select("page_id", "hits", F.coalesce(found["rule"], F.lit("")).alias("density"))


_LEVELS = "(SELECT page_id, k AS pos, 1 + (page_id * k + k) % 4 AS level FROM pages, range(0, 8) t(k))"


@query(f"SELECT page_id, count(*) AS skips FROM (SELECT page_id, level - lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS jump FROM {_LEVELS}) WHERE jump > 1 GROUP BY page_id")
def heading_skips(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = table(spark, d, "pages").select("page_id", k.alias("pos")).withColumn("level", 1 + (F.col("page_id") * F.col("pos") + F.col("pos")) % 4)
    jump = F.col("level") - F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.withColumn("jump", jump).where("jump > 1").groupBy("page_id").agg(F.count("*").alias("skips"))


@query(f"SELECT page_id, count(*) FILTER (WHERE jump > 1) AS skips FROM (SELECT page_id, level - lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS jump FROM {_LEVELS}) GROUP BY page_id")
def heading_skips_parsed(spark, d):
    """The same headings written as markup, parsed, and measured by the audit's own expression."""
    tags = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.lit("<h"), (1 + (F.col("page_id") * k + k) % 4).cast("string"), F.lit("><a>x"), k.cast("string"), F.lit("</a></h"), (1 + (F.col("page_id") * k + k) % 4).cast("string"), F.lit(">")))
    rows = html.parsed(table(spark, d, "pages").select("page_id", F.array_join(tags, "").alias("html")))
    return rows.select("page_id", rules.skipped_levels(F.col("facts.headings")).cast("long").alias("skips"))


_IMG = "(SELECT page_id, page_id % 6 AS n, page_id % 3 AS m FROM pages)"


@query(f"""SELECT page_id, CAST(n AS INTEGER) AS total, CAST(CASE WHEN n > m THEN 1 ELSE 0 END AS INTEGER) AS missing_alt,
 CAST(CASE WHEN n = 0 THEN 100 ELSE 100 - CASE WHEN n > m THEN 5 ELSE 0 END - least(3 * n, 15) - least(2 * n, 10) END AS BIGINT) AS score, CASE WHEN n = 0 THEN 100 ELSE (n - CASE WHEN n > m THEN 1 ELSE 0 END) * 100 // n END AS coverage FROM {_IMG}""")
def image_audit(spark, d):
    """Pages with up to five images over http without dimensions, one of them without alt."""
    n, m = F.col("page_id") % 6, F.col("page_id") % 3
    tags = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(k < n, F.concat(F.lit('<img src="http://img.example/a'), k.cast("string"), F.lit('.JPG" '), F.when(k == m, "").otherwise('alt="x"'), F.lit(' width="3">'))).otherwise(""))
    rows = rules.images(html.parsed(table(spark, d, "pages").select("page_id", F.array_join(tags, "").alias("html"))))
    return rows.select("page_id", "total", "missing_alt", "score", report.alt_coverage(F.col("total"), F.col("missing_alt")).alias("coverage"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN 'en, de' WHEN page_id % 4 = 2 THEN 'en, de, englisch' ELSE 'en, de' END AS languages, CASE WHEN page_id % 4 = 3 THEN 'en (x2)' ELSE '' END AS repeated,
 CAST(CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 65 ELSE 80 END AS BIGINT) AS score FROM pages""")
def hreflang_audit(spark, d):
    """Four kinds of pages: none, right, an invalid code without x-default, a code given twice without x-default."""
    tag = lambda code, href: F.concat(F.lit(f'<link rel="alternate" hreflang="{code}" href="'), href, F.lit('">'))
    own, other, kind = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("/de/x"), F.col("page_id") % 4
    markup = F.when(kind == 0, "").when(kind == 1, F.concat(tag("en", own), tag("de", other), tag("x-default", other))).when(kind == 2, F.concat(tag("en", own), tag("de-AT", other), tag("englisch", other))).otherwise(F.concat(tag("en", own), tag("de", other), tag("en", other)))
    rows = rules.hreflang(html.parsed(table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("<head>"), markup).alias("html"))))
    return rows.select("page_id", F.array_join("languages", ", ").alias("languages"), F.array_join("repeated", ", ").alias("repeated"), "score")


_HEADER = """(SELECT page_id, CASE page_id % 23 WHEN 3 THEN 404 WHEN 5 THEN 503 WHEN 7 THEN 410 WHEN 9 THEN 403 ELSE 200 END AS status, page_id % 4 AS hops, page_id % 7 AS tag, page_id * 13 % 1500 AS ttfb, url LIKE 'https%' AS https FROM pages)"""


@query(f"""SELECT rule, count(*) AS pages FROM (
 SELECT CASE WHEN status = 200 THEN 'R-H1' WHEN status = 404 THEN 'R-H2' WHEN status = 410 THEN 'R-H3' WHEN status >= 500 THEN 'R-H4' ELSE 'R-H5' END AS rule FROM {_HEADER}
 UNION ALL SELECT 'R-H6' FROM {_HEADER} WHERE hops > 2 UNION ALL SELECT 'R-H7' FROM {_HEADER} WHERE hops > 0 UNION ALL SELECT 'R-H9' FROM {_HEADER} WHERE tag IN (1, 2) UNION ALL SELECT 'R-H10' FROM {_HEADER} WHERE tag IN (2, 3)
 UNION ALL SELECT 'R-H11' FROM {_HEADER} WHERE tag = 4 UNION ALL SELECT 'R-H12' FROM {_HEADER} WHERE tag <> 5 UNION ALL SELECT 'R-H13' FROM {_HEADER} WHERE ttfb > 800 UNION ALL SELECT 'R-H13b' FROM {_HEADER} WHERE ttfb BETWEEN 1 AND 200
 UNION ALL SELECT 'R-H14' FROM {_HEADER} WHERE https) GROUP BY rule""")
def header_audit(spark, d):
    tag = F.col("page_id") % 7
    value = F.when(tag == 1, "googlebot: noindex").when(tag == 2, "otherbot: none").when(tag == 3, "max-snippet:0, nofollow").otherwise("max-snippet: 20")
    headers = F.map_from_arrays(F.array(F.lit("x-robots-tag"), F.when(tag == 4, "link").otherwise("x-a"), F.when(tag == 5, "content-encoding").otherwise("x-b")), F.array(F.array(value), F.array(F.lit('<https://a.example/>; rel="canonical"')), F.array(F.lit("gzip"))))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in {i: {3: 404, 5: 503, 7: 410, 9: 403}.get(i, 200) for i in range(23)}.items() for x in kv]), (F.col("page_id") % 23).cast("int"))
    hops = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < F.col("page_id") % 4), lambda k: F.struct(F.col("url").alias("url"), F.when(k == 0, 302).otherwise(301).alias("status")))
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"), status.alias("status"), headers.alias("headers"), hops.alias("redirects"), (F.col("page_id") * 13 % 1500).alias("ttfb_ms"))
    return rules.issues(rules.headers(rows), "page_id").groupBy("rule").agg(F.count("*").alias("pages"))


_SCORES = f"(SELECT page_id, {_TECHNICAL} AS t, page_id % 101 AS s, 100 - page_id % 57 AS m, page_id * 7 % 101 AS c, page_id % 3 AS crit, page_id % 5 AS warn FROM pages)"


@query(f"SELECT page_id, CAST((t + s + m + c) // 4 AS BIGINT) AS score FROM {_SCORES}")
def page_score(spark, d):
    rows = rules.technical(facts(spark, d))
    i = F.col("page_id")
    return rows.select("page_id", report.page_score(F.col("score"), i % 101, 100 - i % 57, i * 7 % 101).alias("score"))


_OVERALL = f"(SELECT page_id, greatest(0, t - 20 * crit - 5 * warn) AS tech, s, c, m FROM {_SCORES})"


@query(f"SELECT page_id, CAST(tech AS BIGINT) AS technical, CAST((30 * tech + 25 * s + 25 * c + 20 * m) // 100 AS BIGINT) AS overall FROM {_OVERALL}")
def score_card(spark, d):
    i = F.col("page_id")
    rows = rules.technical(facts(spark, d)).select("page_id", report.technical_with_headers(F.col("score"), i % 3, i % 5).cast("long").alias("technical"))
    return rows.select("page_id", "technical", report.overall(F.col("technical"), i % 101, i * 7 % 101, 100 - i % 57).alias("overall"))


@query("""SELECT page_id, CASE WHEN s >= 90 THEN 'EXCELLENT (A+)' WHEN s >= 80 THEN 'GOOD (PASSING)' WHEN s >= 65 THEN 'FAIR (NEEDS WORK)' WHEN s >= 50 THEN 'POOR (AT RISK)' ELSE 'CRITICAL (DEFICIENT)' END AS grade,
 CASE WHEN s >= 80 THEN 'GOOD' WHEN s >= 50 THEN 'NEEDS WORK' ELSE 'POOR' END AS badge FROM (SELECT page_id, page_id % 101 AS s FROM pages)""")
def grade_label(spark, d):
    s = F.col("page_id") % 101
    return table(spark, d, "pages").select("page_id", report.grade(s).alias("grade"), report.badge(s).alias("badge"))


@query("""SELECT source, CASE WHEN source = 'hreflang' THEN 'WARNING' WHEN source IN ('technical', 'content', 'media') AND severity <> 'CRITICAL' THEN 'WARNING' ELSE severity END AS severity, count(*) AS issues FROM
 (SELECT ['technical','content','media','hreflang','headers'][1 + page_id % 5] AS source, ['CRITICAL','WARNING','INFO'][1 + page_id % 3] AS severity FROM pages) GROUP BY ALL""")
def severity_remap(spark, d):
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + F.col("page_id") % n).cast("int"))
    rows = table(spark, d, "pages").select(pick(("technical", "content", "media", "hreflang", "headers"), 5).alias("source"), pick(("CRITICAL", "WARNING", "INFO"), 3).alias("severity"))
    return report.remapped(rows).groupBy("source", "severity").agg(F.count("*").alias("issues"))
