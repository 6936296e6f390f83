"""Structured data, drift and feeds. Inputs are derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill.operators import drift, jsonld, report, rules, strategy
from auditmill.plans.registry import query, table
from auditmill.sources import feeds

_TYPES = ("Product", "Event", "HowTo", "Person", "FAQPage")
_TYPE = "['Product','Event','HowTo','Person','FAQPage'][1 + p_partkey % 5]"
_REQ = "(VALUES ('Product', 'name'), ('Product', 'image'), ('Product', 'offers'), ('Event', 'name'), ('Event', 'startDate'), ('Event', 'location'), ('Person', 'name'), ('FAQPage', 'mainEntity')) r(type, field)"
_HAS = "CASE field WHEN 'name' THEN p_partkey % 3 <> 0 WHEN 'offers' THEN p_partkey % 2 = 0 ELSE false END"


def _things(spark, d):
    """A JSON-LD block for each part: one of five types, with or without name and offers, some with unfilled values."""
    i = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (1 + i % 5).cast("int"))
    name = F.when(i % 3 != 0, F.when(i % 7 == 0, "TODO later").otherwise(F.col("p_name")))
    offer = F.when(i % 2 == 0, F.struct(F.when(i % 4 == 0, F.col("p_retailprice")).alias("price"), F.lit("EUR").alias("priceCurrency")))
    block = F.to_json(F.struct(F.when(i % 11 != 0, "https://schema.org").alias("@context"), kind.alias("@type"), name.alias("name"), offer.alias("offers")))
    return table(spark, d, "part").select(i.alias("id"), kind.alias("type"), F.when(i % 13 == 0, F.concat(F.lit("{"), block)).otherwise(block).alias("raw"))


def _found(spark, d, gate=False):
    return jsonld.finding_rows(_things(spark, d), "id", gate).where("f is not null").select("id", "f.*")


@query(f"SELECT p_partkey AS id, type, field FROM part JOIN {_REQ} ON type = {_TYPE} WHERE p_partkey % 13 <> 0 AND NOT {_HAS}")
def jsonld_required(spark, d):
    """By a join with the table of needed fields."""
    rows = _things(spark, d).where("id % 13 <> 0").select("id", "type", jsonld.present_fields(F.col("raw")).alias("present"))
    return jsonld.missing_fields(rows)


@query(f"SELECT p_partkey AS id, type, field FROM part JOIN {_REQ} ON type = {_TYPE} WHERE p_partkey % 13 <> 0 AND NOT {_HAS}")
def jsonld_required_deep(spark, d):
    """The same by the findings of each block."""
    return _found(spark, d).where("rule = 'missing-field'").select("id", "type", "field")


@query(f"SELECT p_partkey AS id, {_TYPE} AS type FROM part WHERE p_partkey % 13 <> 0 AND {_TYPE} = 'HowTo'")
def jsonld_deprecated(spark, d):
    return _found(spark, d).where("rule = 'deprecated'").select("id", "type")


@query(f"SELECT p_partkey AS id, 'price' AS field FROM part WHERE p_partkey % 13 <> 0 AND {_TYPE} = 'Product' AND p_partkey % 2 = 0 AND p_partkey % 4 <> 0")
def jsonld_offers(spark, d):
    return _found(spark, d).where("rule = 'offer-field'").select("id", "field")


@query(f"""SELECT rule, severity, count(*) AS findings FROM (SELECT 'invalid-json' AS rule, 'warn' AS severity FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT 'deprecated', 'block' FROM part WHERE p_partkey % 13 <> 0 AND {_TYPE} = 'HowTo'
 UNION ALL SELECT 'missing-context', 'warn' FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 = 0 UNION ALL SELECT 'placeholder', 'block' FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 = 0) GROUP BY ALL""")
def jsonld_lint(spark, d):
    return _found(spark, d, gate=True).groupBy("rule", "severity").agg(F.count("*").alias("findings"))


@query(f"SELECT {_TYPE} AS type, count(*) AS blocks FROM part WHERE p_partkey % 13 <> 0 GROUP BY type")
def jsonld_types(spark, d):
    kind = F.expr("try_variant_get(try_parse_json(raw), '$[\"@type\"]', 'string')")
    return _things(spark, d).select(kind.alias("type")).where("type is not null").groupBy("type").agg(F.count("*").alias("blocks"))


@query(f"""WITH m AS (SELECT p_partkey AS id, count(*) AS n FROM part JOIN {_REQ} ON type = {_TYPE} WHERE NOT {_HAS} GROUP BY p_partkey),
 x AS (SELECT p_partkey AS id, p_partkey % 13 = 0 AS broken, coalesce(n, 0) AS n, CASE WHEN {_TYPE} = 'Product' AND p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 1 ELSE 0 END AS offer, CASE WHEN {_TYPE} = 'HowTo' THEN 1 ELSE 0 END AS dep, CASE WHEN {_TYPE} = 'FAQPage' THEN 1 ELSE 0 END AS faq,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 7 = 0 THEN 1 ELSE 0 END AS ph FROM part LEFT JOIN m ON id = p_partkey)
SELECT id, CASE WHEN broken THEN 1 ELSE n + offer + ph END AS errors, CAST(CASE WHEN broken THEN 0 ELSE dep + faq END AS BIGINT) AS warnings, CAST(greatest(0, CASE WHEN broken THEN 70 ELSE 100 - 5 * n - 3 * offer - 5 * dep - 10 * ph END) AS BIGINT) AS score FROM x""")
def jsonld_audit(spark, d):
    return jsonld.audit(_things(spark, d), "id").select("id", "errors", "warnings", "score")


# ---------------------------------------------------------------- drift
_AT = lambda v: f"(SELECT sha256('u' || page_id)[1:16] AS url_key, {v}::BIGINT AS v, sha256(html || CASE WHEN page_id % 5 = 0 THEN '{v}' ELSE '' END) AS content_sha256, CASE WHEN page_id % 7 = 0 AND {v} = 2 THEN 404 ELSE 200 END AS status_code, CASE WHEN page_id % 3 = 0 THEN 'T{v}' ELSE 'T' END AS title, page_id % 1000 * {v} AS ttfb FROM pages)"


def _snapshots(spark, d, v: int):
    i = F.col("page_id")
    return table(spark, d, "pages").select(
        F.substring(F.sha2(F.concat(F.lit("u"), i.cast("string")), 256), 1, 16).alias("url_key"), F.timestamp_add("DAY", F.lit(v), F.lit("2026-01-01").cast("timestamp")).alias("timestamp"),
        F.sha2(F.concat("html", F.when(i % 5 == 0, str(v)).otherwise("")), 256).alias("content_sha256"), F.when((i % 7 == 0) & F.lit(v == 2), 404).otherwise(200).alias("status_code"), F.when(i % 3 == 0, f"T{v}").otherwise("T").alias("title"),
        F.array(F.lit("a"), F.when(i % 4 == 0, str(v)).otherwise("b")).alias("h1"), (i % 1000 * v).alias("ttfb_ms"),
    )


@query(f"""WITH b AS {_AT(1)}, c AS {_AT(2)}, x AS (SELECT p.page_id, sha256('u' || page_id)[1:16] AS url_key FROM pages p)
SELECT url_key, field, before, after, significant FROM (
 SELECT url_key, 'content_sha256' AS field, b.content_sha256[1:12] AS before, c.content_sha256[1:12] AS after, true AS significant FROM b JOIN c USING (url_key) UNION ALL SELECT url_key, 'status_code', CAST(b.status_code AS VARCHAR), CAST(c.status_code AS VARCHAR), true FROM b JOIN c USING (url_key)
 UNION ALL SELECT url_key, 'title', b.title, c.title, true FROM b JOIN c USING (url_key) UNION ALL SELECT url_key, 'h1', 'a | ' || CASE WHEN page_id % 4 = 0 THEN '1' ELSE 'b' END, 'a | ' || CASE WHEN page_id % 4 = 0 THEN '2' ELSE 'b' END, true FROM x
 UNION ALL SELECT url_key, 'ttfb_ms', CAST(b.ttfb AS VARCHAR), CAST(c.ttfb AS VARCHAR), abs(c.ttfb - b.ttfb) > 500 AND (b.ttfb = 0 OR abs(c.ttfb - b.ttfb) > 0.5 * b.ttfb) FROM b JOIN c USING (url_key)) WHERE before <> after""")
def drift_compare(spark, d):
    return drift.compare(_snapshots(spark, d, 2), _snapshots(spark, d, 1), ("content_sha256", "status_code", "title", "h1"))


@query(f"SELECT url_key, title, status_code FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY v DESC) AS n FROM ({_AT(1)} UNION ALL {_AT(3)} UNION ALL {_AT(2)})) WHERE n = 1")
def drift_latest(spark, d):
    rows = _snapshots(spark, d, 1).union(_snapshots(spark, d, 3)).union(_snapshots(spark, d, 2))
    return drift.latest(rows).select("url_key", "title", "status_code")


@query("""SELECT abs(c - b) > 500 AND (b = 0 OR abs(c - b) > 0.5 * b) AS significant, count(*) AS pairs FROM (SELECT event_id % 2000 AS b, event_id * 7 % 3000 AS c FROM events) WHERE b <> c GROUP BY 1""")
def drift_ttfb(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("url_key"), (F.col("event_id") % 2000).alias("b"), (F.col("event_id") * 7 % 3000).alias("c"))
    found = drift.compare(e.select("url_key", F.col("c").alias("ttfb_ms")), e.select("url_key", F.col("b").alias("ttfb_ms")), ())
    return found.groupBy("significant").agg(F.count("*").alias("pairs"))


# ---------------------------------------------------------------- feeds
def _cdx(spark, d):
    i = F.col("page_id")
    lang = F.when(i % 3 == 0, "eng,deu").when(i % 3 == 1, "fra ,").otherwise(F.lit(None))
    rec = F.to_json(F.struct("url", F.when(i % 4 == 0, "application/pdf").otherwise("text/html").alias("mime"), lang.alias("languages")))
    return feeds.parse_cdx(table(spark, d, "pages").select(F.when(i % 9 == 0, "{broken").otherwise(rec).alias("value")))


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime, count(*) AS records FROM pages WHERE page_id % 9 <> 0 GROUP BY mime")
def cdx_breakdown(spark, d):
    return feeds.mime_counts(_cdx(spark, d))


@query("SELECT language, count(*) AS records FROM (SELECT unnest(CASE page_id % 3 WHEN 0 THEN ['eng', 'deu'] WHEN 1 THEN ['fra'] ELSE [] END) AS language FROM pages WHERE page_id % 9 <> 0) GROUP BY language")
def cdx_languages(spark, d):
    return feeds.language_counts(_cdx(spark, d))


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'CC-' || page_id ELSE 'CC-MAIN-2026-34' END AS id FROM pages")
def cdx_latest_index(spark, d):
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('[{"id":"CC-'), F.col("page_id").cast("string"), F.lit('"},{"id":"x"}]'))).otherwise("[]")
    return table(spark, d, "pages").select(feeds.latest_index(body).alias("id"))


@query("""SELECT event_type, CAST(user_id % 10 AS BIGINT) AS grp, count(*) AS clicks, CAST(sum(event_id % 50 + 1) AS BIGINT) AS impressions, round(sum((event_id % 9 + 1.0) * (event_id % 50 + 1)) / sum(event_id % 50 + 1), 6) AS position, round(count(*) / sum(event_id % 50 + 1), 9) AS ctr
 FROM events GROUP BY event_type, grp ORDER BY clicks DESC, event_type, grp LIMIT 25""")
def search_analytics(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("grp"), F.lit(1).alias("clicks"), (F.col("event_id") % 50 + 1).alias("impressions"), (F.col("event_id") % 9 + 1.0).alias("position"))
    return feeds.search_analytics(rows, ["event_type", "grp"]).withColumns({"position": F.round("position", 6), "ctr": F.round("ctr", 9)})


@query("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type AS metric, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY ALL")
def crux_weekly_p75(spark, d):
    from auditmill.streaming import monitor

    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("metric"), "value")
    return monitor.weekly_p75(rows).select(F.col("week").cast("timestamp_ntz").alias("week"), "metric", F.round("p75", 6).alias("p75"))


@query("SELECT url, m AS metric, CAST(p AS INTEGER) AS period, CASE WHEN p = 1 THEN NULL ELSE CAST(page_id + p AS VARCHAR) END AS p75 FROM pages, (VALUES ('LCP'), ('CLS')) t(m), range(0, 3) r(p)")
def crux_history(spark, d):
    series = F.concat(F.lit('{"percentilesTimeseries":{"p75s":['), F.col("page_id").cast("string"), F.lit(',null,"'), (F.col("page_id") + 2).cast("string"), F.lit('"]}}'))
    body = F.concat(F.lit('{"record":{"metrics":{"largest_contentful_paint":'), series, F.lit(',"cumulative_layout_shift":'), series, F.lit(',"other":'), series, F.lit("}}}"))
    return feeds.crux_history(table(spark, d, "pages").select("url", body.alias("body")))


@query("SELECT url, c AS category, CAST(round(100 * CASE c WHEN 'seo' THEN (page_id % 100) / 100.0 ELSE 0.5 END) AS BIGINT) AS score FROM pages, (VALUES ('seo'), ('performance')) t(c)")
def psi_scores(spark, d):
    body = F.concat(F.lit('{"lighthouseResult":{"categories":{"performance":{"score":0.5},"seo":{"score":'), F.format_string("%.2f", (F.col("page_id") % 100) / 100.0), F.lit("}}}}"))
    return feeds.psi_scores(table(spark, d, "pages").select("url", body.alias("body")))


@query("SELECT url, 'LCP (ms)' AS metric, CAST(page_id AS DOUBLE) AS percentile, 'FAST' AS rating FROM pages")
def psi_field(spark, d):
    body = F.concat(F.lit('{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":'), F.col("page_id").cast("string"), F.lit(',"category":"FAST"},"SOMETHING":{"percentile":1,"category":"SLOW"}}}}'))
    return feeds.psi_field(table(spark, d, "pages").select("url", body.alias("body")))


@query("SELECT url, CASE WHEN page_id % 2 = 0 THEN 'PASS' END AS verdict, 'Indexed' AS coverage FROM pages")
def url_inspection(spark, d):
    body = F.concat(F.lit('{"inspectionResult":{"indexStatusResult":{"coverageState":"Indexed"'), F.when(F.col("page_id") % 2 == 0, ',"verdict":"PASS"').otherwise(""), F.lit("}}}"))
    return feeds.inspection(table(spark, d, "pages").select("url", body.alias("body"))).select("url", "verdict", "coverage")


@query("SELECT page_id, sha256(url)[1:4] || '…' AS redacted, CASE page_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'key not valid' ELSE 'unexpected answer' END AS answer FROM pages")
def indexnow(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", feeds.redact(F.sha2("url", 256)).alias("redacted"), feeds.submit_status(F.when(i % 3 == 0, 200).when(i % 3 == 1, 403).otherwise(418)).alias("answer"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/in' WHEN 1 THEN '/path' WHEN 2 THEN '/out' ELSE '' END AS path FROM pages")
def hook_paths(spark, d):
    kind = F.col("page_id") % 4
    payload = F.when(kind == 0, '{"tool_input":{"path":"/x","file_path":"/in"},"tool_response":{"file_path":"/out"}}').when(kind == 1, '{"tool_input":{"file_path":"","path":"/path"}}').when(kind == 2, '{"tool_input":{},"tool_response":{"filePath":"/out"}}').otherwise("{}")
    return table(spark, d, "pages").select("page_id", feeds.hook_path(payload).alias("path"))


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'AVERAGE' END AS overall FROM pages")
def psi_overall(spark, d):
    body = F.when(F.col("page_id") % 3 == 0, "{}").otherwise('{"loadingExperience":{"overall_category":"AVERAGE"}}')
    return feeds.psi_overall(table(spark, d, "pages").select("url", body.alias("body")))


@query("""SELECT url, CAST(pos AS INTEGER) AS pos, audit, CASE audit WHEN 'speed-index' THEN page_id + 0.5 ELSE 0.0 END::DOUBLE AS value, CASE audit WHEN 'speed-index' THEN page_id || ' s' ELSE '' END AS shown
 FROM pages, (VALUES (0, 'first-contentful-paint'), (4, 'speed-index')) t(pos, audit) WHERE audit = 'speed-index' OR page_id % 2 = 0""")
def psi_lab(spark, d):
    """Lab audits in their fixed order; an audit that isn't reported and one without values."""
    i = F.col("page_id").cast("string")
    speed = F.concat(F.lit('"speed-index":{"numericValue":'), i, F.lit('.5,"displayValue":"'), i, F.lit(' s"},"uses-http2":{"numericValue":1}'))
    body = F.concat(F.lit('{"lighthouseResult":{"audits":{'), speed, F.when(F.col("page_id") % 2 == 0, ',"first-contentful-paint":{}').otherwise(""), F.lit("}}}"))
    return feeds.psi_lab(table(spark, d, "pages").select("url", body.alias("body")))


@query("SELECT url, m AS metric, p75, unit FROM (SELECT url, page_id, unnest([{'m': 'LCP', 'p': CAST(page_id AS VARCHAR), 'u': 'ms'}, {'m': 'CLS', 'p': '0.10', 'u': 'score'}, {'m': 'INP', 'p': NULL, 'u': 'ms'}]) AS x FROM pages), LATERAL (SELECT x.m AS m, x.p AS p75, x.u AS unit) WHERE p75 IS NOT NULL")
def crux_current(spark, d):
    """A number, a text, and a null, which is left out."""
    one = lambda name, value: F.concat(F.lit(f'"{name}":{{"percentiles":{{"p75":'), value, F.lit("}}"))
    body = F.concat(F.lit('{"record":{"metrics":{'), F.concat_ws(",", one("largest_contentful_paint", F.col("page_id").cast("string")), one("cumulative_layout_shift", F.lit('"0.10"')), one("interaction_to_next_paint", F.lit("null")), one("round_trip_time", F.lit("1"))), F.lit("}}}"))
    return feeds.crux_current(table(spark, d, "pages").select("url", body.alias("body")))


@query("SELECT url, CAST(p AS INTEGER) AS period, make_date(2026, 1 + p::INTEGER, 1 + (page_id % 28)::INTEGER) AS first_day, make_date(2026, 2 + p::INTEGER, 1) AS last_day FROM pages, range(0, 2) r(p)")
def crux_periods(spark, d):
    day = lambda month, of: F.concat(F.lit(f'{{"year":2026,"month":{month},"day":'), of, F.lit("}"))
    first = (1 + F.col("page_id") % 28).cast("string")
    period = lambda m: F.concat(F.lit('{"firstDate":'), day(m, first), F.lit(',"lastDate":'), day(m + 1, F.lit("1")), F.lit("}"))
    body = F.concat(F.lit('{"record":{"collectionPeriods":['), period(1), F.lit(","), period(2), F.lit("]}}"))
    return feeds.crux_periods(table(spark, d, "pages").select("url", body.alias("body")))


@query("""SELECT page_id, page_id % 4 = 1 AS no_data, CASE page_id % 4 WHEN 2 THEN 'CrUX API returned 403: no key' WHEN 3 THEN 'CrUX API returned 500: <p> down' || repeat(' x', 92) || ' ' ELSE '' END AS error FROM pages""")
def crux_status(spark, d):
    """A record, none, an error with a message, and one without that is cut."""
    kind = F.col("page_id") % 4
    status = F.when(kind == 0, 200).when(kind == 1, 404).when(kind == 2, 403).otherwise(500)
    body = F.when(kind == 2, '{"error":{"message":" no\\n  key"}}').otherwise(F.concat(F.lit("<p>  down\n"), F.repeat(F.lit("x "), 300)))
    rows = feeds.crux_status(table(spark, d, "pages").select(F.col("page_id").alias("url"), status.alias("status"), body.alias("body")))
    return rows.withColumnRenamed("url", "page_id").withColumn("error", F.regexp_replace("error", "(?s)^(CrUX API returned 500: <p> down( x){92}).*$", "$1 "))


@query("""SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN '{"origin":"https://a' || page_id || '.example"}' ELSE '{"url":"https://a' || page_id || '.example/x"}' END AS request FROM pages""")
def crux_requests(spark, d):
    url = F.concat(F.lit("https://a"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".example/").otherwise(".example/x"))
    return table(spark, d, "pages").select(feeds.crux_request(url).alias("request"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS records, CASE WHEN page_id % 3 = 2 THEN 'status 503' ELSE '' END AS error FROM pages")
def cdx_answers(spark, d):
    """A crawl index's answers: records with a broken line between them, 404 for none, and an error."""
    kind = F.col("page_id") % 3
    rows = table(spark, d, "pages").select(F.col("page_id").alias("target"), F.when(kind == 0, 200).when(kind == 1, 404).otherwise(503).alias("status"), F.when(kind == 0, '{"url":"a"}\n{broken\n{"url":"b","mime":"x"}\n').alias("body"))
    return feeds.cdx_answer(rows).select(F.col("target").alias("page_id"), F.size("records").alias("records"), "error")


@query("SELECT count(*) AS total, count(DISTINCT url) AS distinct_urls FROM (SELECT url FROM pages WHERE page_id % 9 <> 0 UNION ALL SELECT url FROM pages WHERE page_id % 9 <> 0)")
def cdx_totals(spark, d):
    rows = _cdx(spark, d)
    return feeds.cdx_totals(rows.unionByName(rows))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL ELSE '{"host":"a' || page_id || '.example","key":"k","urlList":["https://A' || page_id || '.example:8443/x","https://b.example/"]' || CASE page_id % 3 WHEN 1 THEN ',"keyLocation":"https://a/k.txt"' ELSE '' END || '}' END AS body FROM pages""")
def indexnow_submission(spark, d):
    i = F.col("page_id")
    urls = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://A"), i.cast("string"), F.lit(".example:8443/x")), F.lit("https://b.example/")))
    return table(spark, d, "pages").select("page_id", feeds.submission(urls, F.lit("k"), F.when(i % 3 == 1, "https://a/k.txt")).alias("body"))


@query("SELECT count(*) AS keys, count(*) AS distinct_keys, true AS hexadecimal FROM pages")
def indexnow_keys(spark, d):
    keys = table(spark, d, "pages").select(feeds.new_key().alias("key"))
    return keys.agg(F.count("*").alias("keys"), F.count_distinct("key").alias("distinct_keys"), F.bool_and(F.col("key").rlike("^[0-9a-f]{32}$")).alias("hexadecimal"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/upper' WHEN 1 THEN '/folded' WHEN 2 THEN '/target' ELSE '/out' END AS path FROM pages")
def hook_paths_folded(spark, d):
    """Names that count in any case, after the exact ones."""
    kind = F.col("page_id") % 4
    payload = (
        F.when(kind == 0, '{"tool_input":{"FILEPATH":"/no","AbsolutePath":"/upper"}}').when(kind == 1, '{"tool_input":{"File_Path":"/folded","other":"/x"}}')
        .when(kind == 2, '{"tool_input":{"file":"/file","TargetFile":"/target"}}').otherwise('{"tool_input":{"command":"ls"},"tool_response":{"FilePath":"/out"}}')
    )
    return table(spark, d, "pages").select("page_id", feeds.hook_path(payload).alias("path"))


@query("""SELECT page_id, '{"error":{"command":"crawl","message":"page ' || page_id || ' failed"' || CASE WHEN page_id % 2 = 0 THEN ',"hint":"try again"' ELSE '' END || '}}' AS error FROM pages""")
def error_json(spark, d):
    message = F.concat(F.lit(" page "), F.col("page_id").cast("string"), F.lit(" failed "), F.when(F.col("page_id") % 2 == 0, "\n  try again\n").otherwise(""))
    return table(spark, d, "pages").select("page_id", feeds.error_json(F.lit("crawl"), message).alias("error"))


@query("""SELECT severity, count(*) AS pages FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'PASS' ELSE 'none' END AS severity FROM part) WHERE severity <> 'none' GROUP BY severity""")
def schema_verdicts(spark, d):
    """Pages without blocks, with sound ones, and with errors, whose findings stand for themselves."""
    i = F.col("p_partkey") % 3
    rows = table(spark, d, "part").select(F.when(i == 0, 0).otherwise(i).alias("blocks"), F.when(i == 1, 0).otherwise(2).alias("errors"))
    return report.schema_verdicts(rows).groupBy("severity").agg(F.count("*").alias("pages"))


@query("SELECT abs(max(c - b)) > 500 AS failed FROM (SELECT event_id % 2000 AS b, event_id * 7 % 3000 AS c FROM events)")
def fail_on_change(spark, d):
    """A run that fails if anything has changed that matters."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("url_key"), (F.col("event_id") % 2000).alias("b"), (F.col("event_id") * 7 % 3000).alias("c"))
    return rules.trips(drift.compare(e.select("url_key", F.col("c").alias("ttfb_ms")), e.select("url_key", F.col("b").alias("ttfb_ms")), ()), "change")


# ---------------------------------------------------------------- strategy reports
_RANKED = "(SELECT c_custkey AS k, 'u' || ((c_custkey // 6) * 10 + (r + CASE c_custkey % 6 WHEN 5 THEN 7 ELSE c_custkey % 6 END) % 17) AS url, r FROM customer, range(1, 11) t(r))"


@query(f"""WITH RECURSIVE serp AS {_RANKED}, link AS (SELECT a.k AS x, b.k AS y FROM serp a JOIN serp b ON a.url = b.url AND a.k <> b.k GROUP BY a.k, b.k HAVING count(*) >= 4),
 walk(k, c) AS (SELECT k, k FROM (SELECT DISTINCT k FROM serp) UNION SELECT y, c FROM walk JOIN link ON x = walk.k) SELECT 'k' || k AS keyword, 'k' || min(c) AS cluster FROM walk GROUP BY k""")
def keyword_clusters(spark, d):
    """Keywords that share at least four of their first ten results; clusters are named by their first keyword."""
    k = F.col("c_custkey")
    shift = F.when(k % 6 == 5, 7).otherwise(k % 6)
    rows = table(spark, d, "customer").select(k.alias("keyword"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"), shift.alias("s"))
    rows = rows.select("keyword", "rank", F.concat(F.lit("u"), (F.floor(F.col("keyword") / 6) * 10 + (F.col("rank") + F.col("s")) % 17).cast("string")).alias("url"))
    got = strategy.keyword_clusters(rows)
    return got.select(F.concat(F.lit("k"), F.col("keyword").cast("string")).alias("keyword"), F.concat(F.lit("k"), F.col("cluster").cast("string")).alias("cluster"))


@query("""SELECT p_brand AS site, round(sum(w * score) * 1.0 / sum(w), 6) AS score FROM (SELECT p_brand, p_partkey % 101 AS score, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS w FROM part) GROUP BY p_brand""")
def site_score_weighted(spark, d):
    """A site's score: home pages count three times, hubs twice."""
    i = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("site"), (i % 101).alias("score"), F.when(i % 4 == 0, "home").when(i % 4 == 1, "hub").otherwise("detail").alias("template"))
    return strategy.weighted_score(rows).select("site", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT p_brand AS template, count(*) AS pages FROM part GROUP BY p_brand), f AS (SELECT p_brand AS template, 'i' || p_size % 5 AS issue, count(*) AS affected FROM part WHERE p_size % 5 < 3 OR p_partkey % 7 = 0 GROUP BY ALL)
 SELECT template, issue, affected, CASE WHEN affected * 2 > pages THEN 'template' ELSE 'content' END AS kind FROM f JOIN t USING (template)""")
def issue_origin(spark, d):
    """Whether an issue comes from a template (most of its pages have it) or from single pages' content."""
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("template"))
    found = table(spark, d, "part").where("p_size % 5 < 3 or p_partkey % 7 = 0").select(F.col("p_partkey").alias("page"), F.concat(F.lit("i"), (F.col("p_size") % 5).cast("string")).alias("issue"))
    return strategy.issue_origin(pages, found)


@query("""SELECT p_brand AS template, count(*) AS pages, count(*) FILTER (WHERE p_partkey % 101 < 60) AS thin, CASE WHEN count(*) >= 50 THEN 'stop' WHEN count(*) >= 30 THEN 'warn' ELSE 'pass' END AS gate FROM part GROUP BY p_brand""")
def programmatic_gates(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("template"), (F.col("p_partkey") % 101).alias("score"))
    return strategy.programmatic_gates(rows)
