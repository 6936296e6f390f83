"""robots.txt: groups and rules as rows, longest match as a window, policy of crawlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditmill.functions import urls as U

# Crawlers that a policy is reported for.
CRAWLERS = ("Googlebot", "Google-Extended", "OAI-SearchBot", "GPTBot", "ClaudeBot", "PerplexityBot", "CCBot", "Bytespider", "Applebot-Extended")


def lines(files: DataFrame) -> DataFrame:
    """files (site, body) -> site, line, directive, value of the directives known."""
    rows = files.select("site", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
    rows = rows.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    rows = rows.select("site", "line", F.lower(F.trim(F.regexp_extract("raw", "^([^:]*):", 1))).alias("directive"), F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1)).alias("value"))
    return rows.where(F.col("directive").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))


def groups(files: DataFrame) -> DataFrame:
    """Directives with their group's number from 1: an agent after a rule begins a group; what stands before any agent has group 0."""
    rows = lines(files).where("directive <> 'sitemap'")
    w = Window.partitionBy("site").orderBy("line")
    begins = (F.col("directive") == "user-agent") & F.coalesce(F.lag("directive").over(w) != "user-agent", F.lit(True))
    return rows.withColumn("grp", F.sum(begins.cast("int")).over(w))


def agents(grouped: DataFrame) -> DataFrame:
    return grouped.where("directive = 'user-agent' and grp > 0").select("site", "grp", F.lower("value").alias("agent"), "line")


def rules(grouped: DataFrame) -> DataFrame:
    """site, grp, allow, pattern; an empty Disallow allows all and is an allow rule of length 0."""
    rows = grouped.where("directive in ('allow', 'disallow') and grp > 0")
    return rows.select("site", "grp", "line", ((F.col("directive") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("pattern"))


def sitemaps(files: DataFrame) -> DataFrame:
    return lines(files).where("directive = 'sitemap' and value <> ''").groupBy("site", "value").agg(F.min("line").alias("line"))


def counts(files: DataFrame) -> DataFrame:
    """site, rules, groups, agents (distinct), delay lines."""
    g = groups(files)
    return g.groupBy("site").agg(
        F.count_if((F.col("grp") > 0) & F.col("directive").isin("allow", "disallow")).alias("rules"), F.max("grp").cast("long").alias("groups"),
        F.count_distinct(F.when(F.col("directive") == "user-agent", F.lower("value"))).alias("agents"),
    )


def blocks_all(files: DataFrame) -> DataFrame:
    """site, blocked: whether the rules for all agents (*) forbid the whole site, by a rule for / that nothing allows again."""
    g = groups(files)
    everyone = agents(g).where("agent = '*'").select("site", "grp").distinct()
    ruled = rules(g).join(everyone, ["site", "grp"], "left_semi")
    whole = F.coalesce(F.bool_or(~F.col("allow") & (F.col("pattern") == "/")), F.lit(False))
    root = verdicts(files.select("site", F.lit("/").alias("path")).distinct(), ruled).select("site", "allowed")
    per = ruled.groupBy("site").agg(whole.alias("whole"))
    return root.join(per, "site", "left").select("site", (F.coalesce("whole", F.lit(False)) & ~F.col("allowed")).alias("blocked"))


def indexed(ruled: DataFrame) -> DataFrame:
    """Rules (site, pattern, ...) with head, the text before the first *, rest, the texts between the others, and ends, whether $ ends the path.

    A pattern can match a path only if the path begins with its head and holds the others.
    """
    ends = F.endswith("pattern", F.lit("$"))
    body = F.when(ends, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    parts = F.split(body, r"\*")
    return ruled.withColumns({"head": parts[0], "rest": F.slice(parts, 2, F.size(parts)), "ends": ends})


def _rest_matches(path: Column, head: Column, rest: Column, ends: Column) -> Column:
    """Whether the texts between wildcards follow the head in order, the last at the path's end if it is anchored.

    Each text is taken where it first stands: whatever follows has then most room, so no other place need be tried.
    """
    last, size = F.try_element_at(rest, F.lit(-1)), F.length(path)
    middle = F.when(ends, F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, path, at + 1)
        return F.when(at < 0, at).when(part == "", at).when(found == 0, F.lit(-1)).otherwise(found - 1 + F.length(part))

    at = F.aggregate(middle, F.length(head), step)
    closes = F.when(F.size(rest) == 0, at == size).otherwise((at <= size - F.length(last)) & F.endswith(path, last))
    return F.startswith(path, head) & (at >= 0) & (~ends | closes)


def _anchored(ruled: DataFrame) -> DataFrame:
    """Rules (site, pattern) with anchor, the text that a rule is looked up by, and inside, whether it stands behind the head.

    A path that a pattern matches begins with its head and holds each text between its wildcards. Of these the one
    is taken that fewest of the site's patterns have, the longest among equals; a pattern of wildcards alone has ''.
    """
    held = F.transform(F.array_distinct(F.filter("rest", lambda x: x != "")), lambda x: F.struct(F.lit(True).alias("inside"), x.alias("anchor")))
    head = F.when((F.col("head") != "") | (F.size(held) == 0), F.array(F.struct(F.lit(False).alias("inside"), F.col("head").alias("anchor")))).otherwise(F.array())
    own = indexed(ruled.select("site", "pattern").distinct()).select("site", "pattern", F.explode(F.concat(head, held)).alias("x")).select("site", "pattern", "x.*")
    shared = own.groupBy("site", "inside", "anchor").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("inside", "anchor"), F.struct("n", -F.length("anchor"), "inside", "anchor")).alias("x")
    return own.join(shared, ["site", "inside", "anchor"]).groupBy("site", "pattern").agg(best).select("site", "pattern", "x.*")


def candidates(paths: DataFrame, ruled: DataFrame) -> DataFrame:
    """paths (site, path), each once, with the rules (site, pattern, ...) that they may match, taken apart as `indexed` does: an equi-join on texts within the path.

    A rule is looked up by its rarest text. Of a path only the beginnings and the texts within are looked up that
    have the lengths of its site's rarest texts, so a path meets the rules whose rarest text it holds, however many
    others its site has that begin alike.
    """
    ruled = ruled.where("pattern <> ''")
    anchors = _anchored(ruled)
    rules_ = indexed(ruled).join(anchors, ["site", "pattern"])
    sizes = anchors.groupBy("site").agg(F.collect_set(F.struct("inside", F.length("anchor").alias("size"))).alias("sizes"))

    def texts(s: Column) -> Column:
        starts = F.when(s["inside"], F.sequence(F.lit(1), F.length("path") - s["size"] + 1)).otherwise(F.array(F.lit(1)))
        return F.transform(starts, lambda at: F.struct(s["inside"].alias("inside"), F.substring(F.col("path"), at, s["size"]).alias("anchor")))

    fits = F.filter("sizes", lambda s: s["size"] <= F.length("path"))
    looked = paths.join(sizes, "site").select("site", "path", F.explode(F.array_distinct(F.flatten(F.transform(fits, texts)))).alias("x")).select("site", "path", "x.*")
    return looked.join(rules_, ["site", "inside", "anchor"]).drop("inside", "anchor")


def matches(paths: DataFrame, ruled: DataFrame) -> DataFrame:
    """paths (site, path), each once, with the rules (site, pattern, ...) that match them."""
    return candidates(paths, ruled).where(_rest_matches(F.col("path"), F.col("head"), F.col("rest"), F.col("ends"))).drop("head", "rest", "ends")


def group_of(grouped: DataFrame, bots: DataFrame) -> DataFrame:
    """bots (bot) -> site, bot, grp: the group of the bot's own name, else of the longest prefix of it, else of *."""
    a = agents(grouped)
    bot = F.lower("bot")
    # agents are few rows a site, bots are the caller's short list; the match is by prefix
    hit = a.join(bots, (F.col("agent") == bot) | (F.col("agent") == "*") | F.startswith(bot, F.col("agent")))
    w = Window.partitionBy("site", "bot").orderBy((F.col("agent") == bot).desc(), (F.col("agent") != "*").desc(), F.length("agent").desc(), "line")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select("site", "bot", "grp", "agent")


def verdicts(paths: DataFrame, ruled: DataFrame) -> DataFrame:
    """paths (site, path) against rules (site, allow, pattern) -> site, path, allowed.

    The longest matching pattern decides, allow among equals; without a match all is allowed. Null paths are
    allowed; paths that repeat give a row each.
    """
    best = matches(paths.select("site", "path").distinct(), ruled.select("site", "allow", "pattern").distinct())
    best = best.groupBy("site", "path").agg(F.max(F.struct(F.octet_length("pattern").alias("size"), "allow")).alias("best"))
    return paths.join(best, ["site", "path"], "left").select("site", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))


def allowed_urls(urls: DataFrame, ruled: DataFrame, url: str = "url") -> DataFrame:
    """urls (site, url) with allowed: rules must let both the escaped and the decoded form of a URL's path through."""
    escaped, decoded = U.robots_targets(F.col(url))
    forms = urls.select("site", url).distinct().withColumn("path", F.explode(F.array_distinct(F.array(escaped, decoded))))
    said = verdicts(forms.select("site", "path").distinct(), ruled)
    per = forms.join(said, ["site", "path"]).groupBy("site", url).agg(F.bool_and("allowed").alias("allowed"))
    return urls.join(per, ["site", url], "left")


def delays(grouped: DataFrame, bots: DataFrame) -> DataFrame:
    """bots (bot) -> site, bot, delay: the seconds that the bot's group asks for between requests; the group's last valid line counts."""
    said = grouped.where("directive = 'crawl-delay' and grp > 0").withColumn("delay", F.expr("try_cast(value as double)")).where("delay >= 0")
    per = said.groupBy("site", "grp").agg(F.max_by("delay", "line").alias("delay"))
    return group_of(grouped, bots).join(per, ["site", "grp"]).select("site", "bot", "delay")


def crawlers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CRAWLERS], "bot string")


def policy(files: DataFrame) -> DataFrame:
    """site, bot, label, status: Allowed, Disallowed (all), or Partial Restrictions for each known crawler."""
    g = groups(files)
    bots = crawlers(files.sparkSession)
    of = group_of(g, bots).join(rules(g).select("site", "grp", "allow", "pattern"), ["site", "grp"], "left")
    per = of.groupBy("site", "bot").agg(
        F.max("agent").alias("agent"), F.coalesce(F.bool_or(~F.col("allow") & (F.col("pattern") == "/")), F.lit(False)).alias("whole"),
        F.coalesce(F.bool_or(~F.col("allow") & (F.col("pattern") != "")), F.lit(False)).alias("some"),
    )
    # what the longest matching rule of its group says of the root
    own = of.select(F.concat_ws("\n", "site", "bot").alias("site"), "allow", "pattern").where("pattern is not null")
    root = verdicts(of.select(F.concat_ws("\n", "site", "bot").alias("site"), F.lit("/").alias("path")).distinct(), own).select(F.col("site").alias("_of"), "allowed")
    per = per.join(root, F.concat_ws("\n", "site", "bot") == F.col("_of")).drop("_of")
    per = files.select("site").distinct().join(bots).join(per, ["site", "bot"], "left")
    blocked = F.coalesce(F.col("whole") & ~F.col("allowed"), F.lit(False))
    # What a crawler's policy is called.
    status = F.when(blocked, "Disallowed").when(F.col("some"), "Partial Restrictions").otherwise("Allowed")
    label = F.when(F.col("agent") == F.lower("bot"), F.col("bot")).otherwise(F.coalesce("agent", F.lit("")))
    return per.select("site", "bot", label.alias("label"), status.alias("status"))
