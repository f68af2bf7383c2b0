"""Plans stay free of what does not scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from corpusaudit.operators import geo, links, offpage, sitemap
from corpusaudit.operators.pages import page_facts

EAGER = ("cluster_", "crawl_frontier", "snapshot_")
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]


def plan(df) -> str:
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan"):]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert [u for u in UNWANTED if u in text] == []


def test_scoring_is_one_projection(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(
        "page_id", "url", "html", "'' as title", "'' as h1", "'' as description", "cast(null as double) as response_time", "cast(null as string) as last_modified")
    assert "Exchange" not in plan(geo.geo_score(pages, "2024-01-31"))
    assert "Exchange" not in plan(page_facts(pages.select("page_id", "url", "html")))


def test_top_k_trims_before_the_shuffle(spark, sf_dir):
    mentions = QUERIES["mention_top"](spark, sf_dir)
    text = plan(mentions)
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("user_id", "project_id")
    listed = raw.filter(F.col("project_id") == 3).select("event_id")
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan(listed)
    counts = plan(links.api_subdomains(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    assert "page_id" not in counts[counts.index("ReadSchema"):].split("\n")[0]


def test_listing_uses_top_n(spark, sf_dir):
    rated = sitemap.recompute_priorities(QUERIES["sitemap_upsert"](spark, sf_dir).withColumn("page_id", F.xxhash64("url")), sitemap.SitemapConfig("2024-01-31"))
    assert "TakeOrderedAndProject" in plan(sitemap.list_pages(rated, limit=10))


def test_sources_table_is_small_and_fixed(spark):
    assert offpage.source_table(spark).count() == len(offpage.SOURCES) == 10
