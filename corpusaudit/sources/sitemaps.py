"""Sitemap XML in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shapes import checkpoint

# Namespace of the sitemap protocol and the most urls one file may hold.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_URLS = 50_000

ENTRY = "loc string, lastmod string"
DOCUMENT = f"url array<struct<{ENTRY.replace(' string', ':string')}>>, sitemap array<struct<loc:string>>"


def read_sitemap(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(loc, lastmod) of every ``url`` element of the files, after the folder keys asked for."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(ENTRY).load(path)
    return rows.select(*keys, F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod")).filter("loc <> ''")


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("loc", F.from_xml("content", DOCUMENT).alias("x"))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(source, loc, lastmod) of fetched documents (loc, content); unreadable documents give none."""
    rows = _parsed(docs).select(F.col("loc").alias("source"), F.explode("x.url").alias("u"))
    return rows.select("source", F.trim("u.loc").alias("loc"), F.trim("u.lastmod").alias("lastmod")).filter("loc <> ''")


def expand_sitemap_index(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the root documents and of everything their indexes lead to: (root, source, loc, lastmod).

    ``docs`` holds fetched documents (loc, content), ``roots`` (loc). A document met twice is read once per root.
    """
    children = _parsed(docs).select("loc", F.explode("x.sitemap").alias("s")).select("loc", F.trim("s.loc").alias("child")).filter("child <> ''")
    children = checkpoint(children.distinct())
    level = seen = checkpoint(roots.select(F.col("loc").alias("root"), "loc").distinct())
    while True:
        found = level.join(children, "loc").select("root", F.col("child").alias("loc")).distinct()
        level = checkpoint(found.join(seen, ["root", "loc"], "left_anti"))
        if level.isEmpty():
            break
        seen = checkpoint(seen.unionByName(level))
    entries = sitemap_entries(docs)
    return seen.join(entries, seen["loc"] == entries["source"]).select("root", "source", entries["loc"], "lastmod")


def sitemap_rows(entries: DataFrame, *keys: str) -> DataFrame:
    """Elements of a sitemap in protocol order, after the given keys; absent ones are null and left out when written."""
    have = set(entries.columns)
    opt = lambda c, e: (e if c in have else F.lit(None).cast("string")).alias(c)
    return entries.select(
        *keys, F.col("url").alias("loc"),
        opt("lastmod", F.nullif(F.substring(F.col("lastmod").cast("string"), 1, 10), F.lit(""))),
        opt("changefreq", F.nullif(F.col("changefreq"), F.lit(""))),
        opt("priority", F.format_string("%.2f", F.col("priority").cast("double"))))


def read_index(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(loc) of every file that the indexes under ``path`` name, after the folder keys asked for."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    return rows.select(*keys, F.trim("loc").alias("loc")).filter("loc <> ''")


def write_sitemap(entries: DataFrame, path: str) -> None:
    """Write entries as sitemap files of at most 50,000 urls each; every task writes its own files."""
    (sitemap_rows(entries).write.format("xml").mode("overwrite").option("rootTag", f'urlset xmlns="{NAMESPACE}"')
     .option("rowTag", "url").option("declaration", 'version="1.0" encoding="UTF-8"').option("maxRecordsPerFile", MAX_URLS).save(path))


def write_sitemap_index(urls: DataFrame, path: str) -> None:
    """Write an index of sitemap addresses (url)."""
    (urls.select(F.col("url").alias("loc")).write.format("xml").mode("overwrite").option("rootTag", f'sitemapindex xmlns="{NAMESPACE}"')
     .option("rowTag", "sitemap").option("declaration", 'version="1.0" encoding="UTF-8"').option("maxRecordsPerFile", MAX_URLS).save(path))


def write_project_sitemaps(entries: DataFrame, path: str, project: str = "project_id") -> None:
    """Write every project's entries to files of its own (a folder per project), since a sitemap names one host only.

    Rows are range-partitioned by project and url: small projects share a task, a large one spans several.
    """
    rows = sitemap_rows(entries, project).repartitionByRange(project, "loc")
    (rows.write.format("xml").mode("overwrite").partitionBy(project).option("rootTag", f'urlset xmlns="{NAMESPACE}"')
     .option("rowTag", "url").option("declaration", 'version="1.0" encoding="UTF-8"').option("maxRecordsPerFile", MAX_URLS).save(path))


def project_sitemap_index(spark: SparkSession, path: str, base: str, project: str = "project_id") -> DataFrame:
    """(project, url) of every sitemap file under ``path``, as it will be fetched below ``base``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(project, "path")
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(project, F.concat(F.lit(base.rstrip("/") + "/"), name).alias("url"))


def write_project_indexes(index: DataFrame, path: str, project: str = "project_id") -> None:
    """Write one index per project from (project, url)."""
    (index.select(project, F.col("url").alias("loc")).repartition(project).write.format("xml").mode("overwrite").partitionBy(project)
     .option("rootTag", f'sitemapindex xmlns="{NAMESPACE}"').option("rowTag", "sitemap").option("declaration", 'version="1.0" encoding="UTF-8"')
     .option("maxRecordsPerFile", MAX_URLS).save(path))
