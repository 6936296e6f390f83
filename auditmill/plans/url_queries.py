"""URL functions over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill.functions import urls as U
from auditmill.operators import drift
from auditmill.plans.registry import query, table

_P = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
#: Parts of a page's URL, its normal form and its key, as SQL.
URLS = f"""(SELECT *, scheme || '://' || host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS norm,
  scheme || '://' || host || CASE WHEN path = '/' OR rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS key
 FROM (SELECT *, array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|gclid|fbclid|msclkid|yclid|mc_cid|mc_eid|_ga|_gl)(=|$)')),
   lambda x: {{'k': regexp_extract(x, '^[^=]*'), 'v': regexp_extract(x, '=(.*)$', 1)}})), lambda s: s.k || '=' || s.v), '&') AS kept
  FROM (SELECT page_id, url, html, scheme, CASE scheme WHEN 'https' THEN regexp_replace(host, ':443$', '') WHEN 'http' THEN regexp_replace(host, ':80$', '') ELSE host END AS host, CASE WHEN path = '' THEN '/' ELSE path END AS path, query
   FROM (SELECT page_id, url, html, lower(regexp_extract(trim(url), {_P}, 1)) AS scheme, lower(regexp_extract(trim(url), {_P}, 2)) AS host, regexp_extract(trim(url), {_P}, 3) AS path, regexp_extract(trim(url), {_P}, 4) AS query FROM pages))))"""


def pages(spark, d):
    return table(spark, d, "pages")


@query(f"SELECT page_id, scheme, host, path, query FROM {URLS}")
def url_parts(spark, d):
    return pages(spark, d).select("page_id", *[c.alias(n) for n, c in U.parts(F.col("url")).items()])


@query(f"SELECT page_id, norm AS normalized, norm AS general FROM {URLS}")
def url_normalize(spark, d):
    """The column expression and the general function, side by side."""
    return pages(spark, d).select("page_id", U.normalize_absolute(F.col("url")).alias("normalized"), U.normalize(F.col("url"), F.lit("")).alias("general"))


@query(f"SELECT page_id, key, key AS general FROM {URLS}")
def url_key(spark, d):
    return pages(spark, d).select("page_id", U.key_absolute(F.col("url")).alias("key"), U.key(F.col("url"), F.lit("")).alias("general"))


@query(f"SELECT key, count(*) AS urls, min(url) AS first_url FROM {URLS} GROUP BY key HAVING count(*) > 1")
def url_key_dupes(spark, d):
    return pages(spark, d).groupBy(U.key_absolute(F.col("url")).alias("key")).agg(F.count("*").alias("urls"), F.min("url").alias("first_url")).where("urls > 1")


@query(f"SELECT page_id, norm <> key AS changed, len(string_split(query, '&')) AS params FROM {URLS}")
def tracking_params_stripped(spark, d):
    q = U.parts(F.col("url"))["query"]
    return pages(spark, d).select("page_id", (U.normalize_absolute(F.col("url")) != U.key_absolute(F.col("url"))).alias("changed"), F.size(F.split(q, "&")).cast("long").alias("params"))


@query()
def tracking_params_all(spark, d):
    """tracking_params_stripped over every URL, with the number of parameters that its key leaves out."""
    params = F.filter(F.split(U.parts(F.col("url"))["query"], "&"), lambda p: p != "")
    stripped = F.size(F.filter(params, lambda p: p.rlike(U._DROP)))
    changed = U.normalize_absolute(F.col("url")) != U.key_absolute(F.col("url"))
    return pages(spark, d).select("page_id", changed.alias("changed"), F.size(params).cast("long").alias("params"), stripped.cast("long").alias("stripped"))


@query(f"SELECT page_id, path = '/' AND query = '' AS is_origin, scheme || '://' || host AS origin FROM {URLS}")
def origin_check(spark, d):
    return pages(spark, d).select("page_id", U.is_origin(F.col("url")).alias("is_origin"), U.origin_of(F.col("url")).alias("origin"))


@query(f"SELECT page_id, host LIKE '%.com' AS dot_com, page_id % 4 IN (0, 2) AS own_host FROM {URLS}")
def same_origin(spark, d):
    """Each URL against its own host in capitals, another one, its own with the other scheme, and its own under another scheme that isn't the web's."""
    rows = pages(spark, d)
    host, k = U.host_of(F.col("url")), F.col("page_id") % 4
    link = F.when(k == 2, F.regexp_replace("url", "^https?", "HTTP")).when(k == 3, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    against = F.when(k == 0, F.upper(host)).when(k == 1, F.concat(F.lit("x."), host)).otherwise(host)
    return rows.select("page_id", host.endswith(".com").alias("dot_com"), U.same_origin(link, against).alias("own_host"))


@query(f"""SELECT page_id, NOT regexp_matches(lower(path || sfx), '\\.(jpg|jpeg|png|gif|webp|avif|svg|ico|css|js|json|xml|pdf|zip|gz|mp4|webm|woff|woff2|ttf|eot)$')
 AND NOT list_has_any(string_split(lower(path || sfx), '/'), ['wp-admin','admin','cart','checkout','login','logout','search','feed']) AS crawlable
 FROM (SELECT *, CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '/cart/x' WHEN 2 THEN '/Feed' ELSE '' END AS sfx FROM {URLS})""")
def crawlable_path(spark, d):
    suffix = F.when(F.col("page_id") % 5 == 0, ".PDF").when(F.col("page_id") % 5 == 1, "/cart/x").when(F.col("page_id") % 5 == 2, "/Feed").otherwise("")
    return pages(spark, d).select("page_id", U.crawlable_path(F.concat(U.parts(F.col("url"))["path"], suffix)).alias("crawlable"))


@query(f"SELECT page_id, sha256(key)[1:16] AS url_key, sha256(lower(rtrim(trim(url), '/')))[1:16] AS legacy_key FROM {URLS}")
def drift_key(spark, d):
    return pages(spark, d).select("page_id", U.store_key(U.key_absolute(F.col("url"))).alias("url_key"), U.legacy_store_key(F.col("url")).alias("legacy_key"))


@query(f"SELECT host, count(*) AS pages, count(DISTINCT path) AS paths, CAST(sum(length(html)) AS BIGINT) AS chars FROM {URLS} GROUP BY host")
def host_rollup(spark, d):
    rows = pages(spark, d).select(U.host_of(F.col("url")).alias("host"), U.parts(F.col("url"))["path"].alias("path"), F.length("html").alias("n"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("path").alias("paths"), F.sum("n").alias("chars"))


@query(f"SELECT scheme, query <> '' AS has_query, url LIKE '%#%' AS has_fragment, count(*) AS pages FROM {URLS} GROUP BY ALL")
def scheme_breakdown(spark, d):
    p = U.parts(F.col("url"))
    return pages(spark, d).groupBy(p["scheme"].alias("scheme"), (p["query"] != "").alias("has_query"), F.col("url").contains("#").alias("has_fragment")).agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, CASE WHEN bare LIKE 'http%' THEN bare ELSE 'https://' || bare END AS with_scheme, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS simple_host, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS domain FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN url ELSE host || path END AS bare FROM {URLS})")
def url_cleanup(spark, d):
    bare = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(U.host_of(F.col("url")), U.parts(F.col("url"))["path"]))
    return pages(spark, d).select("page_id", U.with_scheme(bare).alias("with_scheme"), U.simple_host(F.col("url")).alias("simple_host"), U.domain_target(F.concat(F.lit(" *."), U.simple_host(F.col("url")), F.lit(":80/x"))).alias("domain"))


@query(f"SELECT page_id, path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS escaped, url_decode(path) || CASE WHEN query = '' THEN '' ELSE '?' || query END AS decoded FROM {URLS}")
def robots_targets(spark, d):
    escaped, decoded = U.robots_targets(F.col("url"))
    return pages(spark, d).select("page_id", escaped.alias("escaped"), decoded.alias("decoded"))


@query("""WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, (l_orderkey * 37 + l_linenumber) % 256 AS a, (l_partkey * 29) % 256 AS b, l_suppkey % 256 AS c FROM lineitem)
SELECT DISTINCT a || '.' || b || '.' || c || '.4' AS address, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR a BETWEEN 224 AND 239 AS blocked FROM x""")
def ssrf_blocklist(spark, d):
    """Addresses out of the numbers of order lines, of which some lie in ranges that no reader may reach."""
    octet = lambda c: (c % 256).cast("string")
    address = F.concat_ws(".", octet(F.col("l_orderkey") * 37 + F.col("l_linenumber")), octet(F.col("l_partkey") * 29), octet(F.col("l_suppkey")), F.lit("4"))
    return table(spark, d, "lineitem").select(address.alias("address")).distinct().select("address", U.blocked_ipv4(F.col("address")).alias("blocked"))


@query(f"""SELECT url_key, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS found, timestamp FROM (SELECT sha256(key)[1:16] AS url_key, page_id, TIMESTAMP '2026-01-01' + INTERVAL 1 HOUR * CAST(page_id % 50 AS INTEGER) AS timestamp FROM {URLS} WHERE page_id IN (SELECT min(page_id) FROM {URLS} GROUP BY key))""")
def drift_history(spark, d):
    """Half of the pages have snapshots under their key, the others under the key of earlier versions only."""
    rows = pages(spark, d).select("page_id", U.store_key(U.key_absolute(F.col("url"))).alias("url_key"), U.legacy_store_key(F.col("url")).alias("legacy_key"))
    rows = rows.groupBy("url_key").agg(F.min_by(F.struct("page_id", "legacy_key"), "page_id").alias("p")).select("url_key", "p.*")
    at = F.timestamp_add("HOUR", (F.col("page_id") % 50).cast("int"), F.lit("2026-01-01").cast("timestamp_ntz"))
    made = rows.select("page_id", "url_key", "legacy_key", at.alias("timestamp"))
    new = made.where("page_id % 2 = 0").select("url_key", F.lit("new").alias("found"), "timestamp")
    old = made.select(F.col("legacy_key").alias("url_key"), F.lit("old").alias("found"), "timestamp")
    return drift.history(new, made.select("url_key", "legacy_key"), old).select("url_key", "found", "timestamp")
