"""Fetched bodies, dates, reports, and a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.operators import drift, report, rules
from auditmill.plans.registry import query, table
from auditmill.sources import fetch, html, sitemap


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN '' ELSE 'text/plain' END AS kind, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN page_id % 2 = 0 ELSE false END AS is_html, octet_length(encode(html)) > 3000 AS truncated, least(octet_length(encode(html)), 3000) AS bytes FROM pages""")
def fetch_bodies(spark, d):
    i = F.col("page_id")
    head = F.when(i % 3 == 0, " text/html ; charset=utf-8").when(i % 3 == 1, "").otherwise("text/plain")
    body = F.when(i % 2 == 0, F.concat(F.lit("﻿ \n"), "html")).otherwise(F.concat(F.lit("x"), "html"))
    raw = F.col("html").cast("binary")
    return table(spark, d, "pages").select("page_id", fetch.content_type(head).alias("kind"), fetch.is_html(head, body).alias("is_html"), fetch.truncated(raw, 3000).alias("truncated"), F.octet_length(fetch.capped(raw, 3000)).cast("long").alias("bytes"))


@query("SELECT page_id, sha256(html) AS text_sha FROM pages")
def charset_decode(spark, d):
    """Pages in UTF-8 and in UTF-16, as their headers say."""
    wide = F.col("page_id") % 2 == 0
    rows = table(spark, d, "pages").select("page_id", F.when(wide, F.encode("html", "UTF-16BE")).otherwise(F.col("html").cast("binary")).alias("body"), F.when(wide, "text/html; charset=utf-16-be").otherwise("text/html").alias("head"))
    return rows.select("page_id", F.sha2(fetch.decoded("body", "head"), 256).alias("text_sha"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS lastmod FROM orders")
def lastmod_header(spark, d):
    head = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return table(spark, d, "orders").select(T.w3c_time(head).alias("lastmod")).distinct()


@query("SELECT n_nationkey, n_nationkey || CASE WHEN n_nationkey = 1 THEN ' page' ELSE ' pages' END AS label FROM nation")
def plural_labels(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.plural(F.col("n_nationkey"), "page").alias("label"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def json_rows(spark, d):
    return report.as_json(table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("""SELECT page_id, CASE WHEN page_id % 6 IN (0, 1) THEN '<urlset><url><loc>a</loc></url></urlset>' WHEN page_id % 6 = 5 THEN '<urlset><url><loc>a</loc></url>' ELSE '' END AS body, page_id % 6 IN (2, 3, 4) AS failed, CASE WHEN page_id % 6 = 5 THEN 'truncated' ELSE '' END AS warn FROM pages""")
def sitemap_gzip(spark, d):
    """Plain and zipped files, a zipped one that is cut, an HTML page, an answer that isn't 200, and a plain one that is too long."""
    import gzip

    whole = b"<urlset><url><loc>a</loc></url></urlset>"
    zipped = gzip.compress(whole)
    kind = F.col("page_id") % 6
    raw = F.when(kind == 0, F.lit(whole)).when(kind == 1, F.lit(zipped)).when(kind == 2, F.lit(zipped[:-12])).when(kind == 3, F.lit(b"<html>")).when(kind == 4, F.lit(whole)).otherwise(F.lit(whole[:-9] + b"<url>" * 90))
    files = table(spark, d, "pages").select(F.col("page_id").alias("file"), F.when(kind == 4, 404).otherwise(200).alias("status"), raw.alias("raw"))
    rows = sitemap.read_file(files, most=len(zipped))
    kept = F.regexp_replace("body", "(<url>)*(<u?r?l?)?$", "")
    return rows.select(F.col("file").alias("page_id"), F.when(F.col("warn") == "", F.col("body")).otherwise(kept).alias("body"), (F.col("error") != "").alias("failed"), "warn")


@query()
def html_report(spark, d):
    """Every page's report, rendered where its row is."""
    rows = rules.technical(html.parsed(table(spark, d, "pages")))
    return rows.select("url", report.technical_report(F.col("url"), F.col("score"), F.col("issues")).alias("html"))


@query(r"SELECT url, sha256(html) AS content_sha256, len(regexp_extract_all(html, '<a href=')) AS internal_links FROM pages")
def drift_capture(spark, d):
    rows = html.parsed(table(spark, d, "pages")).withColumns({"status": F.lit(200), "ttfb_ms": F.lit(1)})
    return drift.capture(rows, "2026-01-01").select("url", "content_sha256", "internal_links")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, CASE WHEN event_id % 20 = 0 THEN 404 ELSE 200 END AS status, count(*) AS fetches FROM events GROUP BY ALL")
def status_stream(spark, d):
    """Fetches by hour and status from a stream (an extension), read to its end; its results are written where all can read them."""
    import uuid

    from auditmill.streaming import monitor

    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/status-{uuid.uuid4().hex}"
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = monitor.status_counts(stream.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 20 == 0, 404).otherwise(200).alias("status")))

    def keep(rows, _):
        rows.write.mode("overwrite").parquet(folder + "/counts")

    counts.writeStream.outputMode("complete").option("checkpointLocation", folder + "/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(folder + "/counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _streamed(spark, d, plan, mode: str):
    """A stream over events, put through `plan` and read to its end; what it gave out is read from the shared folder."""
    import uuid

    from auditmill import shared

    out = shared.folder(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = plan(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    rows.writeStream.outputMode(mode).format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out + "/rows")


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS window_start, CASE WHEN event_id % 20 = 0 THEN 404 ELSE 200 END AS status FROM events)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, status, count(*) AS fetches FROM e WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def status_stream_final(spark, d):
    """Windows that the watermark has passed, each given out once; their state is gone."""
    from auditmill.streaming import monitor

    status = F.when(F.col("event_id") % 20 == 0, 404).otherwise(200)
    out = _streamed(spark, d, lambda s: monitor.status_counts(s.select("ts", status.alias("status"))), "append")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT 'u' || user_id AS url_key, event_id AS seq, before, event_type AS after FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND before <> event_type""")
def drift_stream(spark, d):
    """A page's visits as a stream: those that found something else than the visit before."""
    from auditmill.streaming import monitor

    visits = lambda s: s.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url_key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return _streamed(spark, d, lambda s: monitor.changes(visits(s)), "append").select("url_key", "seq", "before", "after")
