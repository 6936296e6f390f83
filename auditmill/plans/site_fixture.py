"""A site derived from the pages table by integer formulas, the same in Spark's and DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_N = "(SELECT count(*) AS n FROM pages)"
_K = lambda n: "(VALUES " + ", ".join(f"({i})" for i in range(1, n + 1)) + ") AS t(k)"
_AT = lambda x: f"'https://s.example/p' || CAST({x} AS VARCHAR(20))"

SITE = f"""(SELECT page_id AS id, url, url AS key, CASE WHEN hops > 0 THEN {_AT('(page_id * 13 + 5) % n')} ELSE url END AS final_key, status, error, depth, hops, TRUE AS is_html, noindex, title, description, text_hash, canonical, canonical AS canonical_key FROM
 (SELECT page_id, n, {_AT('page_id')} AS url, CASE page_id % 23 WHEN 3 THEN 404 WHEN 5 THEN 503 WHEN 7 THEN 500 ELSE 200 END AS status, '' AS error, page_id % 6 AS depth,
  CASE WHEN page_id % 11 = 4 THEN 1 WHEN page_id % 29 = 6 THEN 2 ELSE 0 END AS hops, page_id % 19 = 8 AS noindex, CASE WHEN page_id % 13 = 0 THEN '' ELSE 'Title ' || CAST(page_id % 97 AS VARCHAR(20)) END AS title,
  CASE WHEN page_id % 9 = 0 THEN '' ELSE 'About ' || CAST(page_id % 83 AS VARCHAR(20)) END AS description, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'h' || CAST(page_id % 61 AS VARCHAR(20)) END AS text_hash,
  CASE WHEN page_id % 7 = 2 THEN {_AT('(page_id * 11 + 3) % n')} WHEN page_id % 17 = 1 THEN 'https://other.example/p' || CAST(page_id AS VARCHAR(20)) WHEN page_id % 31 = 9 THEN {_AT('n + page_id')} ELSE {_AT('page_id')} END AS canonical
  FROM pages CROSS JOIN {_N} AS c) AS x)"""
LINK = f"(SELECT id AS src_id, key AS src_key, (id * 3 + k) % n AS dst_id, {_AT('(id * 3 + k) % n')} AS dst_key FROM {SITE} AS s CROSS JOIN {_N} AS c CROSS JOIN {_K(4)} WHERE status = 200)"
ALTERNATE = f"(SELECT key AS src_key, {_AT('(41 - id + n) % n')} AS dst_key FROM {SITE} AS s CROSS JOIN {_N} AS c WHERE id % 5 < 3)"
SITEMAP = f"(SELECT key AS loc, key, id AS pos FROM {SITE} AS s WHERE id % 4 <> 0 UNION ALL SELECT {_AT('n + k')} AS loc, {_AT('n + k')} AS key, n + k AS pos FROM {_N} AS c CROSS JOIN {_K(10)})"


def _run(spark, d, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql.replace('FROM pages', 'FROM {pages}')} AS q", pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id"))


def site(spark, d) -> DataFrame:
    return _run(spark, d, SITE).withColumn("hops", F.col("hops").cast("int"))


def link(spark, d) -> DataFrame:
    return _run(spark, d, LINK)


def alternate(spark, d) -> DataFrame:
    return _run(spark, d, ALTERNATE)


def sitemap(spark, d) -> DataFrame:
    return _run(spark, d, SITEMAP)
