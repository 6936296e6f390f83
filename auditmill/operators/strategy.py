"""Reports above single pages: clusters of keywords, scores weighted by template, gates for generated pages."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.shared import forget, written

#: Results of a keyword that are compared, and how many of them two keywords of a cluster share at least.
RESULTS, SHARED = 10, 4
#: Fixed value: keywords that are compared pair by pair if they have a result in common.
FEW = 32
# Weights of a page's template in its site's score; pages of a template that are looked at twice, and too many; score of thin content.
WEIGHTS = {"home": 3, "hub": 2, "detail": 1}
MANY, TOO_MANY, THIN = 30, 50, 60


def shared_results(results: DataFrame, shared: int = SHARED) -> DataFrame:
    """Links (x, y) that connect all keywords of results (keyword, rank, url) which share at least `shared` of their first RESULTS.

    A keyword's URLs are put in order, those of fewest keywords first. The first URL that two keywords share stands
    among the first seven of ten in both, if they share four. If at most FEW keywords have it, it's a bucket in which all pairs are
    compared. Else all that they share are URLs of more than FEW, and they have a choice of four of these in common; all that have one
    such choice are linked to the smallest of them. So a keyword has seven rows at most in buckets and 210 in choices, work grows with
    keywords alone, however many have a result in common, and only URLs of many keywords are ever chosen from.
    URLs that one keyword alone has are left out first. URLs are compared by 64 bits. Spark takes a
    table's size from its files, before results and choices multiply its rows: without the hints it would send
    the larger ones through the driver.
    """
    top = results.where((F.col("rank") <= RESULTS) & F.col("keyword").isNotNull() & F.col("url").isNotNull()).select("keyword", F.xxhash64("url").alias("h")).distinct()
    known = top.join(top.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "h")
    ranked = F.sort_array(F.collect_list(F.struct(F.least("n", F.lit(FEW + 1)).alias("n"), "h")))
    sets = known.groupBy("keyword").agg(ranked.alias("urls")).where(F.size("urls") >= shared)
    urls = F.col("urls")

    rest = F.transform(urls, lambda u, i: F.struct(u["n"].alias("n"), u["h"].alias("h"), F.slice(urls["h"], i + 2, RESULTS).alias("rest")))
    open_ = F.filter(rest, lambda u: (u["n"] <= FEW) & (F.size(u["rest"]) >= shared - 1))
    buckets = sets.select("keyword", F.explode(open_).alias("u")).groupBy("u.h").agg(F.sort_array(F.collect_list(F.struct("keyword", "u.rest"))).alias("m")).where(F.size("m") > 1)
    alike = lambda a, b: F.size(F.array_intersect(a["rest"], b["rest"])) >= shared - 1
    later = lambda a, i: F.filter(F.slice("m", i + 2, FEW), lambda b: alike(a, b))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(later(a, i), lambda b: F.struct(a["keyword"].alias("x"), b["keyword"].alias("y")))))
    near = buckets.select(F.explode(pairs).alias("p")).select("p.x", "p.y")

    many = sets.select("keyword", F.filter(urls, lambda u: u["n"] > FEW)["h"].alias("urls")).where(F.size("urls") >= shared)
    picks = ", ".join(f"array({', '.join(map(str, c))})" for c in combinations(range(RESULTS), shared))
    picked = many.select("keyword", "urls", F.explode(F.expr(f"array({picks})")).alias("p")).where(F.col("p")[shared - 1] < F.size("urls"))
    # two hashes name a choice: 128 bits
    chosen = picked.select("keyword", *[F.xxhash64(F.lit(seed), *[F.get("urls", F.col("p")[i]) for i in range(shared)]).alias(f"h{seed}") for seed in (1, 2)])
    first = chosen.groupBy("h1", "h2").agg(F.min("keyword").alias("x"), F.max("keyword").alias("last")).where("x < last").select("h1", "h2", "x")
    stars = chosen.join(first.hint("merge"), ["h1", "h2"]).where("keyword <> x").select("x", F.col("keyword").alias("y"))
    links = near.unionByName(stars).distinct()
    return links.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("l")).select("l.*")


def keyword_clusters(results: DataFrame, shared: int = SHARED) -> DataFrame:
    """results (keyword, rank, url) -> keyword, cluster: the smallest keyword that shared results lead to."""
    top = results.where(F.col("rank") <= RESULTS)
    label = _smallest(shared_results(results, shared).where("x < y"))
    return top.select("keyword").distinct().join(label.hint("merge"), "keyword", "left").select("keyword", F.coalesce("cluster", "keyword").alias("cluster"))


def _smallest(links: DataFrame) -> DataFrame:
    """links (x, y), each once -> keyword, cluster: the smallest keyword that links lead to, for every keyword of a link.

    In each round a keyword goes to its neighbour of smallest hash, if that is smaller than its own, and from there once more; links are
    then those of the keywords that were gone to. Hashes are new in every round, so that few remain, and all rounds together
    write a few times what the first one does, however long a chain is. The smallest keyword is taken along, and handed down in the end.
    """
    links, steps, smallest = written(links, "links"), [], None
    while not links.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(steps)), c)
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        best = both.groupBy("x").agg(F.min(F.struct(rank("y").alias("r"), "y")).alias("to"))
        to = F.struct(F.col("to.r").alias("r"), F.col("to.y").alias("y"))
        goes = written(best.select("x", F.least(to, F.struct(rank("x").alias("r"), F.col("x").alias("y")))["y"].alias("to")), "goes")
        twice = goes.join(goes.select(F.col("x").alias("to"), F.col("to").alias("end")).hint("merge"), "to").select("x", "end")
        twice = twice.withColumn("least", F.col("x")) if smallest is None else twice.join(smallest.withColumnRenamed("end", "x").hint("merge"), "x")
        step = written(twice.select("x", "end", "least"), "step")
        forget(goes)
        steps.append(step)
        smallest = step.groupBy("end").agg(F.min("least").alias("least"))
        left = step.select("x", F.col("end").alias("u")).hint("merge")
        right = step.select(F.col("x").alias("y"), F.col("end").alias("v")).hint("merge")
        ends = links.join(left, "x").join(right, "y").where("u <> v").select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct()
        was, links = links, written(ends, "links")
        forget(was)
    label = links.select(F.col("x").alias("end"), F.col("y").alias("cluster"))  # none is left
    for step in reversed(steps):
        ends = step.groupBy("end").agg(F.min("least").alias("least")).join(label.hint("merge"), "end", "left").select("end", F.coalesce("cluster", "least").alias("cluster"))
        was, label = label, written(step.join(ends.hint("merge"), "end").select(F.col("x").alias("end"), "cluster"), "clusters")
        forget(was)
        forget(step)
    if steps:
        forget(links)
    return label.withColumnRenamed("end", "keyword")


def weighted_score(pages: DataFrame) -> DataFrame:
    """pages (site, template, score) -> site, score: the mean in which home pages and hubs count more."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), "template"), F.lit(1))
    return pages.groupBy("site").agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("score"))


def issue_origin(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages (page, template), found (page, issue) -> template, issue, affected, kind: an issue of most pages of a template is the template's."""
    of = pages.groupBy("template").agg(F.count("*").alias("pages"))
    per = found.distinct().join(pages, "page").groupBy("template", "issue").agg(F.count("*").alias("affected"))
    return per.join(of, "template").select("template", "issue", "affected", F.when(F.col("affected") * 2 > F.col("pages"), "template").otherwise("content").alias("kind"))


def programmatic_gates(pages: DataFrame) -> DataFrame:
    """pages (template, score) -> template, pages, thin (pages of thin content), gate: pass, warn or stop by the number of generated pages."""
    out = pages.groupBy("template").agg(F.count("*").alias("pages"), F.count_if(F.col("score") < THIN).alias("thin"))
    return out.withColumn("gate", F.when(F.col("pages") >= TOO_MANY, "stop").when(F.col("pages") >= MANY, "warn").otherwise("pass"))
