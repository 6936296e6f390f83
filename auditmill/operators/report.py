"""Score cards and reports."""

from __future__ import annotations

import html
from collections.abc import Iterator
from string import Template

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditmill.shared import parts


def clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def page_score(technical: Column, schema: Column, images: Column, content: Column) -> Column:
    return F.floor((technical + schema + images + content) / 4).cast("long")


def technical_with_headers(technical: Column, critical: Column, warning: Column) -> Column:
    """Headers cost the technical score 20 for each critical finding, 5 for each warning."""
    return clamp(technical - critical * 20 - warning * 5)


def overall(technical: Column, schema: Column, content: Column, media: Column) -> Column:
    return F.floor((technical * 30 + schema * 25 + content * 25 + media * 20) / 100).cast("long")


# Grades and badges of scores.
def grade(score: Column) -> Column:
    return F.when(score >= 90, "EXCELLENT (A+)").when(score >= 80, "GOOD (PASSING)").when(score >= 65, "FAIR (NEEDS WORK)").when(score >= 50, "POOR (AT RISK)").otherwise("CRITICAL (DEFICIENT)")


def badge(score: Column) -> Column:
    return F.when(score >= 80, "GOOD").when(score >= 50, "NEEDS WORK").otherwise("POOR")


def alt_coverage(total: Column, missing: Column) -> Column:
    return F.when(total == 0, 100).otherwise(F.floor((total - missing) * 100 / total)).cast("long")


def remapped(found: DataFrame) -> DataFrame:
    """issues (source, severity, ...) as a report shows them: what isn't critical in a page's audits is a warning, hreflang always; a block's errors are critical."""
    s, of = F.col("severity"), F.col("source")
    own = F.when(of.isin("technical", "content", "media") & (s != "CRITICAL"), "WARNING").when(of == "schema", F.when(s == "error", "CRITICAL").otherwise("WARNING"))
    return found.withColumn("severity", F.when(of == "hreflang", "WARNING").otherwise(F.coalesce(own, s)))


def schema_verdicts(pages: DataFrame) -> DataFrame:
    """pages (key columns, blocks, errors) -> severity, message of structured data as a whole: none at all is critical, blocks without errors pass."""
    n = F.coalesce("blocks", F.lit(0))
    severity = F.when(n == 0, "CRITICAL").when(F.col("errors") == 0, "PASS")
    message = F.when(n == 0, "No JSON-LD").when(F.col("errors") == 0, F.concat(n.cast("string"), F.lit(" valid")))
    return pages.withColumns({"severity": severity, "message": message}).where("severity is not null")


def console(found: DataFrame, notes: DataFrame | None = None, affected: int = 5) -> DataFrame:
    """pos, line: a site's issues (category, severity, url, detail) as text, the worst first, each with its first few pages, then the notes (note, n)."""
    few = Window.partitionBy("category").orderBy("url", "detail")
    counts = found.groupBy("severity", "category").agg(F.count("*").alias("n"))
    top = found.withColumn("k", F.row_number().over(few)).where(F.col("k") <= affected).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("k", "url", "detail"))).alias("top"))
    entry = lambda x: F.concat(F.array(F.concat(F.lit("  - "), x["url"])), F.when(x["detail"] != "", F.array(F.concat(F.lit("      "), x["detail"]))).otherwise(F.array().cast("array<string>")))
    head = F.array(F.concat(F.lit("["), "severity", F.lit("] "), "category", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    rest = F.when(F.col("n") > affected, F.array(F.concat(F.lit("  … and "), (F.col("n") - affected).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    order = F.struct(rank.alias("rank"), (-F.col("n")).alias("n"), "category")
    out = counts.join(top, "category").select(order.alias("o"), F.posexplode(F.concat(head, F.flatten(F.transform("top", entry)), rest)).alias("p", "line"))
    if notes is not None:
        out = out.unionByName(notes.select(F.struct(F.lit(3).alias("rank"), F.lit(0).cast("long").alias("n"), F.col("note").alias("category")).alias("o"), F.lit(0).alias("p"), F.concat(F.lit("  * "), "note", F.lit(": "), F.col("n").cast("string")).alias("line")))
    return out.select("o.rank", F.col("o.n").alias("n"), F.col("o.category").alias("category"), "p", "line")


_PAGE = Template("<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>$title</title><style>body{font-family:sans-serif;max-width:60em;margin:2em auto}.good{color:#276749}.fair{color:#975a16}.poor{color:#9b2c2c}td,th{padding:.3em .8em;text-align:left}</style></head><body><h1>$title</h1><table>$scores</table><h2>Findings</h2><table><tr><th>Severity<th>Category<th>Finding<th>Details</tr>$rows</table></body></html>")


def render_html(title: str, scores: dict[str, int], findings: list[tuple[str, str, str, str]]) -> str:
    """A page for one report; its scores and findings are few."""
    shade = lambda n: "good" if n >= 80 else "fair" if n >= 50 else "poor"
    cells = "".join(f'<tr><th>{html.escape(k)}<td class="{shade(v)}">{v}</tr>' for k, v in scores.items())
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}" for x in f) + "</tr>" for f in findings)
    return _PAGE.substitute(title=html.escape(title), scores=cells, rows=rows)


@F.arrow_udf(StringType())
def technical_report(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Each page's report from its own row; a page without URL has no title."""
    for batch in batches:
        for part in parts(*batch, most=1 << 14):  # a report is many times its page's URL
            rows = zip(*[x.to_pylist() for x in part])
            yield pa.array([render_html(u or "", {"technical": s}, [(i["severity"], i["category"], i["message"], i["details"]) for i in found]) for u, s, found in rows], pa.string())


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
