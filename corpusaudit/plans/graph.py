"""Iterative graph jobs on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shapes import checkpoint, compact, number_in_groups, top_k


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Connected components as (id, component), the component being its smallest vertex.

    Each round every vertex takes the smallest label among itself and its neighbours and then
    follows that label to the label's own label, which halves the remaining distance.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = compact(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    first = both.groupBy("src").agg(F.min("dst").alias("near"))
    touched = vertices.join(first, vertices["id"] == first["src"], "left")
    labels = compact(touched.select("id", F.least("id", F.coalesce("near", "id")).alias("component")))
    while True:
        lab = labels.select(F.col("id").alias("dst"), F.col("component").alias("label"))
        near = both.join(lab, "dst").groupBy("src").agg(F.min("label").alias("near"))
        joined = labels.join(near, labels["id"] == near["src"], "left")
        lowered = joined.select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        new = compact(lowered.join(jump, "low").select(
            "id", F.least("low", "jump").alias("component"), (F.least("low", "jump") < F.col("component")).alias("moved")))
        moved = not new.filter("moved").isEmpty()
        labels = new.select("id", "component")
        if not moved:
            return labels


def breadth_first(edges: DataFrame, seeds: DataFrame, max_urls: int | None = 500) -> DataFrame:
    """Replay the crawl frontiers of many sites at once over stored links: (site, url, depth, position), first come first served.

    ``edges`` holds (site, src, dst), ``seeds`` (site, url) and may hold their ``turn``. Within its site, a page is visited in order of
    discovery: by the position of the page that linked to it, then by url. Every site has its own budget of ``max_urls`` visits and drops out when it is
    spent; ``None`` visits everything reachable. Rounds grow with the depth of the deepest site, not with the number of sites. A level is
    trimmed to the budget in every partition before its rows are shuffled. A waiting queue of 5,000 urls cannot change the first 5,000 visits, so no queue
    bound is applied.
    """
    links = checkpoint(edges.select("site", "src", "dst").distinct())
    turn = F.col("turn").cast("long") if "turn" in seeds.columns else F.lit(0).cast("long")
    start = seeds.select("site", "url", turn.alias("_via")).groupBy("site", "url").agg(F.min("_via").alias("_via")).withColumn("_done", F.lit(0).cast("long"))
    level, depth = _numbered(start, 0, max_urls), 0
    visited = level
    while not level.isEmpty():
        depth += 1
        done = level.groupBy("site").agg(F.max("position").alias("_done"))
        if max_urls is not None:
            done = done.filter(F.col("_done") < max_urls)
        found = (level.join(links, (level["site"] == links["site"]) & (level["url"] == links["src"]))
                 .groupBy(level["site"].alias("site"), F.col("dst").alias("url")).agg(F.min("position").alias("_via"))
                 .join(visited.select("site", "url"), ["site", "url"], "left_anti").join(done, "site"))
        level = _numbered(found, depth, max_urls)
        # Levels are fixed tables, so they are only appended; now and then they become one, to keep the plan short.
        visited = visited.unionByName(level)
        if depth % 16 == 0:
            visited = checkpoint(visited)
    return visited


def _numbered(found: DataFrame, depth: int, limit: int | None) -> DataFrame:
    """A level's rows with their position in their site, behind the ``_done`` visits of earlier levels."""
    order = [F.col("_via"), F.col("url")]
    if limit is None:
        numbered = number_in_groups(found, ["site"], order, "_n")
    else:
        numbered = top_k(found, ["site"], order, limit, "_n").filter(F.col("_done") + F.col("_n") <= limit)
    return checkpoint(numbered.select("site", "url", F.lit(depth).alias("depth"), (F.col("_done") + F.col("_n")).cast("long").alias("position")))
