"""Snapshot files and batches to submit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditmill import shared
from auditmill.functions import urls as U
from auditmill.plans.registry import query, table
from auditmill.sources import snapshots, submit

_BARE = "regexp_replace(url, '^https?://', '')"


@query("""WITH s AS (SELECT page_id, url, v FROM pages CROSS JOIN (VALUES (1), (2)) t(v) WHERE v = 1 OR page_id % 3 = 0)
SELECT page_id, v AS version, 1767225600 + v * 3600 AS taken, CASE WHEN v = 2 THEN 404 ELSE 200 END AS status_code, 'T' || v AS title, page_id % 7 AS word_count, v = 2 OR page_id % 3 <> 0 AS newest FROM s""")
def snapshot_files(spark, d):
    """Snapshots of every page, of every third a second one, as files; each page's history read from them.

    Pages that are even have their files under their key, the others under the key of earlier versions.
    """
    from auditmill.operators import drift

    i = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://snap.example/p"), i.cast("string")).alias("url"))
    rows = pages.withColumn("_key", U.key_absolute(F.col("url")))
    rows = rows.withColumn("url_key", F.when(i % 2 == 0, U.store_key(F.col("_key"))).otherwise(U.legacy_store_key(F.concat("url", F.lit("/")))))
    rows = rows.withColumn("v", F.explode(F.when(i % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    v, text = F.col("v"), F.lit("")
    made = rows.select(
        "url_key", "url", F.timestamp_seconds(F.lit(1767225600) + v * 3600).alias("timestamp"), F.sha2("url", 256).alias("content_sha256"), F.when(v == 2, 404).otherwise(200).alias("status_code"),
        F.concat(F.lit("T"), v.cast("string")).alias("title"), text.alias("meta_description"), text.alias("canonical"), F.array().cast("array<string>").alias("h1"), F.array(F.lit("Person")).alias("schema_types"),
        (i % 7).cast("long").alias("word_count"), F.lit(0).cast("long").alias("image_count"), F.lit(0).cast("long").alias("internal_links"), F.lit(5).cast("long").alias("ttfb_ms"),
    )
    folder = shared.folder(spark).rstrip("/") + f"/snapshots-{uuid.uuid4().hex}"
    snapshots.save(made, folder)
    found = snapshots.history(snapshots.read(spark, folder), pages)
    newest = drift.latest(found.select("url_key", "timestamp", "content_sha256", "taken")).select("url_key", F.col("taken").alias("_last"))
    out = found.join(newest, "url_key").join(pages.select("page_id", F.col("url").alias("page")), "page")
    return out.select("page_id", F.when(F.col("title") == "T1", 1).otherwise(2).alias("version"), "taken", "status_code", "title", "word_count", (F.col("taken") == F.col("_last")).alias("newest"))


@query(f"""WITH u AS (SELECT DISTINCT lower(split_part({_BARE}, '/', 1)) AS host, url FROM pages), n AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY encode(url)) - 1) // 20 AS batch FROM u)
SELECT host, batch, count(*) AS urls, '{{"host":"' || host || '","key":"k","urlList":["' || string_agg(url, '","' ORDER BY encode(url)) || '"]}}' AS body FROM n GROUP BY host, batch""")
def indexnow_batches(spark, d):
    """Every page's URL in its host's requests of 20 at most."""
    return submit.batches(table(spark, d, "pages").select("url"), "k", size=20)
