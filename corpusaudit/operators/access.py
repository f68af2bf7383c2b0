"""Crawler access: robots files, infrastructure and open or closed status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Crawlers of answer engines, in report order.
AI_BOTS = ["gptbot", "chatgpt-user", "google-extended", "claudebot", "perplexitybot", "applebot-extended"]

# Texts of the robots report.
ABSENT = "Fichier absent"
ALL_BLOCKED = "Disallow: / global (tous les bots bloques)"
SOME_BLOCKED = "Bots IA bloques: "
NONE_BLOCKED = "Aucun blocage detecte pour les crawlers IA"


def robots_access(robots: DataFrame) -> DataFrame:
    """(site, accessible, details, blocked_bots, allowed_bots) from the text of a robots file.

    Each file is folded line by line inside its row: the current user-agent is the state. A group
    with several user-agent lines keeps the last; reading stops at the first total block.
    """
    text = F.lower(F.coalesce("content", F.lit("")))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    bots = F.array(*map(F.lit, AI_BOTS))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("agent"), empty.alias("blocked"), empty.alias("allowed"),
                     F.lit(False).alias("stopped"), F.lit(False).alias("all_blocked"))

    def after(line: Column) -> Column:
        return F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))

    def step(acc: Column, line: Column) -> Column:
        agent = F.when(line.startswith("user-agent:"), after(line)).otherwise(acc["agent"])
        root = after(line) == "/"
        deny = line.startswith("disallow:") & root & (acc["agent"] != "")
        grant = line.startswith("allow:") & root & (acc["agent"] != "") & ~acc["stopped"]
        named = F.filter(bots, lambda b: F.contains(acc["agent"], b))
        everyone = deny & (acc["agent"] == "*")
        blocked = (F.when(acc["stopped"], acc["blocked"]).when(everyone, bots)
                   .when(deny, F.concat(acc["blocked"], named)).otherwise(acc["blocked"]))
        allowed = F.when(grant, F.concat(acc["allowed"], named)).otherwise(acc["allowed"])
        return F.struct(agent.alias("agent"), blocked.alias("blocked"), allowed.alias("allowed"),
                        (acc["stopped"] | everyone).alias("stopped"), (acc["all_blocked"] | everyone).alias("all_blocked"))

    r = robots.select("site", text.alias("_t"), F.aggregate(lines, start, step).alias("r"))
    absent, closed = F.col("_t") == "", F.col("r.all_blocked") & (F.size("r.allowed") == 0)
    some = F.size("r.blocked") > 0
    return r.select(
        "site", (~absent & ~closed & ~some).alias("accessible"),
        F.when(absent, ABSENT).when(closed, ALL_BLOCKED)
        .when(some, F.concat(F.lit(SOME_BLOCKED), F.array_join("r.blocked", ", "))).otherwise(NONE_BLOCKED).alias("details"),
        F.when(absent, empty).when(closed, bots).otherwise(F.col("r.blocked")).alias("blocked_bots"),
        F.when(absent | closed, empty).otherwise(F.col("r.allowed")).alias("allowed_bots"))


def infra_score(files: DataFrame, pages: DataFrame) -> DataFrame:
    """25 points each for a robots file, a sitemap, an llms file and any page with JSON-LD.

    ``files`` holds (site, name, found), ``pages`` (site, has_structured_data).
    """
    has = lambda n: F.coalesce(F.bool_or(F.when(F.col("name") == n, F.col("found"))), F.lit(False))
    f = files.groupBy("site").agg(has("robots.txt").alias("robots"), has("sitemap.xml").alias("sitemap"), has("llms.txt").alias("llms"))
    p = pages.groupBy("site").agg(F.bool_or(F.coalesce("has_structured_data", F.lit(False))).alias("jsonld"))
    flags = ["robots", "sitemap", "llms", "jsonld"]
    both = f.join(p, "site", "full").select("site", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
    return both.withColumn("score", sum((F.when(F.col(c), 25).otherwise(0) for c in flags[1:]), F.when(F.col("robots"), 25).otherwise(0)))


def access_summary(robots: DataFrame, metas: DataFrame, apis: DataFrame) -> DataFrame:
    """Front and interface status per site.

    ``robots`` holds (site, accessible), ``metas`` (site, indexable), ``apis`` (site, candidate, rank, accessible): the
    candidate of the lowest rank counts, sniffed ones before guesses. Where ``accessible`` is missing, the candidate's own row of ``robots`` decides.
    """
    r = robots.select("site", "accessible")
    m = metas.select("site", "indexable")
    if "accessible" not in apis.columns:
        own = robots.select(F.col("site").alias("candidate"), "accessible")
        apis = apis.join(own, "candidate", "left").filter("accessible is not null")
    a = apis.groupBy("site").agg(F.min_by("accessible", F.struct("rank", "candidate")).alias("_api"))
    joined = r.join(m, "site", "left").join(a, "site", "left")
    front = F.col("accessible") & F.coalesce("indexable", F.lit(True))
    status = lambda c: F.when(c, "OUVERT").otherwise("FERME")
    return joined.select("site", status(front).alias("site_accessible"), F.col("_api").isNotNull().alias("api_detected"),
                         F.when(F.col("_api").isNull(), "NON DETECTEE").otherwise(status(F.col("_api"))).alias("api_accessible"))
