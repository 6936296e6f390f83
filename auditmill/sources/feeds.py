"""Readers of saved feeds: crawl indexes, page speed, field data, search analytics, URL inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.functions import urls as U

CDX = "urlkey string, timestamp string, url string, mime string, status string, digest string, languages string, filename string"
DEFAULT_INDEX = "CC-MAIN-2026-34"
# Field metrics, lab audits and history metrics that reports name, with units.
FIELD_METRICS = {"LARGEST_CONTENTFUL_PAINT_MS": "LCP (ms)", "INTERACTION_TO_NEXT_PAINT_MS": "INP (ms)", "FIRST_CONTENTFUL_PAINT_MS": "FCP (ms)", "CUMULATIVE_LAYOUT_SHIFT_SCORE": "CLS (score)", "TIME_TO_FIRST_BYTE_MS": "TTFB (ms)"}
LAB_AUDITS = ("first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index", "interactive")
HISTORY_METRICS = {"largest_contentful_paint": "LCP", "interaction_to_next_paint": "INP", "cumulative_layout_shift": "CLS", "first_contentful_paint": "FCP", "experimental_time_to_first_byte": "TTFB"}
UNITS = {"LCP": "ms", "INP": "ms", "CLS": "score", "FCP": "ms", "TTFB": "ms"}


def read_cdx(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """Records of a crawl index, one JSON object a line; lines that are none are left out."""
    return spark.read.schema(CDX).option("mode", "DROPMALFORMED").json(path).limit(clamped(limit))


def parse_cdx(lines: DataFrame) -> DataFrame:
    """The same for lines (value) at hand, all of them."""
    return lines.select(F.from_json("value", CDX, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("url is not null")


def latest_index(collinfo: Column) -> Column:
    return F.coalesce(F.get(F.from_json(collinfo, "array<struct<id:string>>"), F.lit(0))["id"], F.lit(DEFAULT_INDEX))


def clamped(limit: int | None) -> int:
    """Records that a crawl index is asked for: 50 unless told otherwise, at most 500."""
    return 50 if not limit or limit < 1 else min(limit, 500)


def cdx_answer(answers: DataFrame) -> DataFrame:
    """answers (target, status, body) -> target, records (array), error. Lines that are no record are left out; 404 means that there are none."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: F.from_json(x, CDX))
    found = F.filter(lines, lambda r: r["url"].isNotNull())
    error = F.when(F.col("status").isin(200, 404), "").otherwise(F.concat(F.lit("status "), F.col("status").cast("string")))
    return answers.select("target", F.when(F.col("status") == 200, found).otherwise(F.array().cast(f"array<struct<{CDX.replace(' string', ':string')}>>")).alias("records"), error.alias("error"))


def cdx_totals(records: DataFrame) -> DataFrame:
    """One row: total records and distinct URLs."""
    return records.agg(F.count("*").alias("total"), F.count_distinct("url").alias("distinct_urls"))


def mime_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("mime").agg(F.count("*").alias("records"))


def language_counts(records: DataFrame) -> DataFrame:
    rows = records.select(F.explode(F.split("languages", ",")).alias("l")).select(F.trim("l").alias("language")).where("language <> ''")
    return rows.groupBy("language").agg(F.count("*").alias("records"))


def psi_scores(responses: DataFrame) -> DataFrame:
    """responses (url, body) -> url, category, score of 100; categories without a score are left out."""
    cats = F.from_json(F.get_json_object("body", "$.lighthouseResult.categories"), "map<string,struct<score:double>>")
    return responses.select("url", F.explode(cats).alias("category", "c")).select("url", "category", F.round(F.col("c.score") * 100).cast("long").alias("score")).where("score is not null")


def psi_overall(responses: DataFrame) -> DataFrame:
    """url, overall: the field data's category for the page as a whole; empty without field data."""
    return responses.select("url", F.coalesce(F.get_json_object("body", "$.loadingExperience.overall_category"), F.lit("")).alias("overall"))


def psi_lab(responses: DataFrame) -> DataFrame:
    """url, pos, audit, value, shown: the six lab audits in their fixed order, those that the answer has."""
    audits = F.from_json(F.get_json_object("body", "$.lighthouseResult.audits"), "map<string,struct<numericValue:double,displayValue:string>>")
    names = F.array(*[F.lit(a) for a in LAB_AUDITS])
    rows = responses.select("url", audits.alias("audits"), F.posexplode(names).alias("pos", "audit")).withColumn("a", F.try_element_at("audits", F.col("audit")))
    return rows.where("a is not null").select("url", "pos", "audit", F.coalesce("a.numericValue", F.lit(0.0)).alias("value"), F.coalesce("a.displayValue", F.lit("")).alias("shown"))


def psi_field(responses: DataFrame) -> DataFrame:
    """url, metric, percentile, rating of the field metrics known."""
    m = F.from_json(F.get_json_object("body", "$.loadingExperience.metrics"), "map<string,struct<percentile:double,category:string>>")
    names = F.create_map(*[F.lit(x) for kv in FIELD_METRICS.items() for x in kv])
    rows = responses.select("url", F.explode(m).alias("name", "m"))
    return rows.select("url", F.try_element_at(names, "name").alias("metric"), "m.percentile", F.col("m.category").alias("rating")).where("metric is not null")


def _known_metrics(responses: DataFrame, of_metric: str) -> DataFrame:
    """url, metric, m: the record's metrics that reports name, each parsed as `of_metric`."""
    metrics = F.from_json(F.get_json_object("body", "$.record.metrics"), f"map<string,struct<{of_metric}>>")
    names = F.create_map(*[F.lit(x) for kv in HISTORY_METRICS.items() for x in kv])
    return responses.select("url", F.explode(metrics).alias("name", "m")).select("url", F.try_element_at(names, "name").alias("metric"), "m").where("metric is not null")


def crux_history(responses: DataFrame) -> DataFrame:
    """responses (url, body) -> url, metric, period, p75 as text (numbers and texts alike; null stays null). Reports show it by metric and period."""
    rows = _known_metrics(responses, "percentilesTimeseries:struct<p75s:array<string>>")
    return rows.select("url", "metric", F.posexplode("m.percentilesTimeseries.p75s").alias("period", "p75"))


def crux_periods(responses: DataFrame) -> DataFrame:
    """url, period, first_day, last_day of a history's collection periods."""
    day = "struct<year:int,month:int,day:int>"
    periods = F.from_json(F.get_json_object("body", "$.record.collectionPeriods"), f"array<struct<firstDate:{day},lastDate:{day}>>")
    rows = responses.select("url", F.posexplode(periods).alias("period", "p"))
    date = lambda c: F.make_date(F.col(f"{c}.year"), F.col(f"{c}.month"), F.col(f"{c}.day"))
    return rows.select("url", "period", date("p.firstDate").alias("first_day"), date("p.lastDate").alias("last_day"))


def crux_current(responses: DataFrame) -> DataFrame:
    """url, metric, p75, unit of a current record; metrics whose 75th percentile is null are left out."""
    rows = _known_metrics(responses, "percentiles:struct<p75:string>").select("url", "metric", F.col("m.percentiles.p75").alias("p75"))
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return rows.where("p75 is not null").withColumn("unit", F.try_element_at(units, "metric"))


def crux_status(answers: DataFrame) -> DataFrame:
    """answers (url, status, body) -> url, no_data, error: 404 means that there is no record, every other answer than 200 is an error."""
    bad = ~F.col("status").isin(200, 404)
    message = F.concat(F.lit("CrUX API returned "), F.col("status").cast("string"), F.lit(": "), api_error(F.col("body")))
    return answers.select("url", (F.col("status") == 404).alias("no_data"), F.when(bad, message).otherwise("").alias("error"))


def crux_request(url: Column) -> Column:
    """What the field data is asked for: a whole origin for its root, else the URL."""
    return F.when(U.is_origin(url), F.to_json(F.struct(U.origin_of(url).alias("origin")))).otherwise(F.to_json(F.struct(url.alias("url"))))


def api_error(body: Column) -> Column:
    """The message in an error's JSON, else the body, on one line of at most 200 characters."""
    message = F.get_json_object(body, "$.error.message")
    return T.truncate(T.collapse_space(F.when(F.coalesce(message, F.lit("")) != "", message).otherwise(body)), 200)


def error_json(command: Column, message: Column) -> Column:
    """A command's error as JSON: the first line is the message, what follows the hint."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = trimmed(message)
    first, rest = trimmed(F.regexp_extract(whole, r"^[^\n]*", 0)), trimmed(F.regexp_extract(whole, r"(?s)^[^\n]*\n(.*)$", 1))
    return F.to_json(F.struct(F.struct(command.alias("command"), first.alias("message"), F.when(rest != "", rest).alias("hint")).alias("error")))


def search_analytics(rows: DataFrame, dimensions: list[str], limit: int = 25) -> DataFrame:
    """rows (dimensions, clicks, impressions, position) -> a row for each combination: clicks, impressions, ctr, mean position; most clicks first."""
    out = rows.groupBy(*dimensions).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), (F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions")).alias("position"))
    return out.withColumn("ctr", F.try_divide("clicks", "impressions")).orderBy(F.desc("clicks"), *dimensions).limit(limit)


def default_window(today: Column) -> tuple[Column, Column]:
    """The days that search analytics covers unless told otherwise: data is two days late."""
    return F.date_sub(today, 30), F.date_sub(today, 2)


def inspection(responses: DataFrame) -> DataFrame:
    """responses (url, body) -> url, verdict, coverage, robots, indexing, last_crawl, google_canonical, user_canonical."""
    schema = "struct<verdict:string,coverageState:string,robotsTxtState:string,indexingState:string,lastCrawlTime:string,googleCanonical:string,userCanonical:string>"
    r = F.from_json(F.get_json_object("body", "$.inspectionResult.indexStatusResult"), schema)
    return responses.select("url", r.alias("r")).select("url", F.col("r.verdict").alias("verdict"), F.col("r.coverageState").alias("coverage"), F.col("r.robotsTxtState").alias("robots"), F.col("r.indexingState").alias("indexing"), F.col("r.lastCrawlTime").alias("last_crawl"), F.col("r.googleCanonical").alias("google_canonical"), F.col("r.userCanonical").alias("user_canonical"))


def submit_status(code: Column) -> Column:
    """What an index-now endpoint's answer means."""
    return F.when(code == 200, "accepted").when(code == 202, "accepted, key validation pending").when(code == 400, "invalid format").when(code == 403, "key not valid").when(code == 422, "URLs don't belong to the host").when(code == 429, "too many requests").otherwise("unexpected answer")


def submission(urls: Column, key: Column, location: Column) -> Column:
    """The body that an index-now endpoint takes: the host is that of the first URL; null without URLs or a host."""
    host = F.regexp_replace(U.host_of(F.get(urls, F.lit(0))), r":\d+$", "")
    body = F.to_json(F.struct(host.alias("host"), key.alias("key"), urls.alias("urlList"), F.when(F.coalesce(location, F.lit("")) != "", location).alias("keyLocation")))
    return F.when(F.coalesce(host, F.lit("")) != "", body)


def redact(key: Column) -> Column:
    return F.when(F.length(key) > 4, F.concat(F.substring(key, 1, 4), F.lit("…"))).otherwise(key)


def new_key() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


# ---------------------------------------------------------------- files and hook payloads
HTML_LIKE = "html htm php erb hbs ejs liquid astro vue jsx tsx md mdx json jsonld".split()


def lint_files(spark: SparkSession, path: str, most: int = 10 << 20) -> DataFrame:
    """path, content of the files that the lint looks at: not too large, and HTML-like by name or JSON by their beginning."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    text = F.col("content").cast("string")
    named = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*HTML_LIKE)
    return files.where(named | F.ltrim(text).rlike(r"^[{\[]")).select("path", text.alias("text"))


# Names under which a tool call gives a file, in the order in which they are looked for, and those that count in any case.
HOOK_KEYS = ("TargetFile", "target_file", "targetFile", "file_path", "filePath", "AbsolutePath", "absolutePath", "path", "filename", "file")
HOOK_FOLDED = ("targetfile", "target_file", "filepath", "file_path", "absolutepath", "absolute_path")


def hook_path(payload: Column) -> Column:
    """The first path that a tool call names; its input goes before its response, exact names before those in other cases."""
    found = []
    for part in ("tool_input", "tool_response"):
        held = F.from_json(F.get_json_object(payload, f"$.{part}"), "map<string,string>")
        found += [F.try_element_at(held, F.lit(k)) for k in HOOK_KEYS]
        # of several names that differ in case alone the first in order
        folded = F.filter(F.array_sort(F.map_entries(held)), lambda e: F.lower(e["key"]).isin(*HOOK_FOLDED) & (e["value"] != ""))
        found.append(F.get(folded, F.lit(0))["value"])
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))
