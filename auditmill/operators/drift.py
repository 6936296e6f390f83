"""Snapshots of pages over time and what has changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.functions import urls as U

#: Change of the time to first byte, in ms and as a share, from which it matters.
TTFB_MS, TTFB_SHARE = 500, 0.5
FIELDS = ("content_sha256", "status_code", "title", "meta_description", "canonical", "h1", "schema_types", "word_count", "image_count", "internal_links")


def capture(pages: DataFrame, at) -> DataFrame:
    """A snapshot row for each parsed page: url, html, status, ttfb_ms, facts."""
    from auditmill.functions import text as T

    f = lambda n: F.col(f"facts.{n}")
    inside = F.size(F.filter(f("anchors"), lambda a: U.link_kind(a, U.host_of(F.col("url"))) == "internal"))
    # types stand alone or in a list
    lists = F.flatten(F.transform(f("jsonld"), lambda r: F.regexp_extract_all(r, F.lit(r'"@type"\s*:\s*("[^"]+"|\[[^\]]*\])'), F.lit(1))))
    types = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r'"([^"]+)"'), F.lit(1))))
    return pages.select(
        "url", U.store_key(U.key_absolute(F.col("url"))).alias("url_key"), F.lit(at).cast("timestamp").alias("timestamp"), F.sha2("html", 256).alias("content_sha256"), F.col("status").alias("status_code"), f("title").alias("title"),
        f("description").alias("meta_description"), f("canonical").alias("canonical"), f("h1").alias("h1"), F.array_sort(F.array_distinct(types)).alias("schema_types"), T.count_words(f("body_text")).alias("word_count"),
        F.size(f("images")).cast("long").alias("image_count"), inside.cast("long").alias("internal_links"), F.col("ttfb_ms").cast("long").alias("ttfb_ms"),
    )


def save(snapshots: DataFrame, path: str) -> None:
    """Appends snapshots; a page's are in one folder, so that its history is one directory's read."""
    snapshots.withColumn("bucket", F.substring("url_key", 1, 2)).write.partitionBy("bucket").mode("append").parquet(path)


def latest(snapshots: DataFrame) -> DataFrame:
    """Each page's newest snapshot. The newest is picked by an aggregate, so that no page's history is sorted."""
    rest = [c for c in snapshots.columns if c != "url_key"]
    return snapshots.groupBy("url_key").agg(F.max_by(F.struct(*rest), F.struct("timestamp", "content_sha256")).alias("s")).select("url_key", "s.*")


def history(snapshots: DataFrame, keys: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Snapshots of keys (url_key, legacy_key) by time; those under an old key only where the new one has none."""
    own = keys.join(snapshots, "url_key")
    if legacy is None:
        return own.orderBy("url_key", "timestamp")
    bare = keys.join(snapshots.select("url_key").distinct(), "url_key", "left_anti")
    old = bare.join(legacy.withColumnRenamed("url_key", "legacy_key"), "legacy_key").select(own.columns)
    return own.unionByName(old).orderBy("url_key", "timestamp")


def compare(current: DataFrame, baseline: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """url_key, field, before, after of every field that differs; of the time to first byte also whether it matters."""

    def shown(side: str, f: str):
        c = F.col(f"{side}.{f}")
        kind = dict(current.dtypes)[f]
        c = F.array_join(c, ", " if f == "schema_types" else " | ") if kind.startswith("array") else c.cast("string")
        return F.substring(c, 1, 12) if f == "content_sha256" else c

    both = current.alias("c").join(baseline.alias("b"), F.col("c.url_key") == F.col("b.url_key"))
    out = None
    cells = [F.struct(F.lit(f).alias("field"), shown("b", f).alias("before"), shown("c", f).alias("after"), F.lit(True).alias("significant")) for f in fields]
    if "ttfb_ms" in current.columns:
        b, c = F.col("b.ttfb_ms"), F.col("c.ttfb_ms")
        matters = (F.abs(c - b) > TTFB_MS) & ((b == 0) | (F.abs(c - b) > b * TTFB_SHARE))
        cells.append(F.struct(F.lit("ttfb_ms").alias("field"), b.cast("string").alias("before"), c.cast("string").alias("after"), matters.alias("significant")))
    out = both.select(F.col("c.url_key").alias("url_key"), F.explode(F.array(*cells)).alias("d")).select("url_key", "d.*")
    return out.where(~F.col("before").eqNullSafe(F.col("after")))
