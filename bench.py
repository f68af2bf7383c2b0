"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from corpusaudit.session import local_session  # noqa: E402

HEADLINE = [
    "page_scores", "site_scores", "html_semantic_features", "html_visible_text", "link_edges", "crawl_stats", "page_categories",
    "page_tokens", "jsonld_blocks", "jsonld_types", "jsonld_validation", "jsonld_diff", "cluster_components", "crawl_frontier",
    "sitemap_seo_list", "sitemap_geo_list", "authority_semantic_vector", "authority_semantic_lexical", "authority_freshness",
    "prediction_decisions", "mention_concepts", "saves_visible", "saves_with_masters",
]


def in_splits(spark, sf_dir: str, parts: int) -> str:
    """A folder with the given tables, those of long rows as several files, as a corpus has them; one row group is one split."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name in ("pages.parquet", "documents.parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(parts).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, shuffle_partitions=cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
    tables = in_splits(spark, sf_dir, cores)
    times = {}
    for name in only.split(",") if only else HEADLINE:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(min(took), 3)
        print(name, [round(t, 2) for t in took], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times,
                      "median": round(statistics.median(times.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
