"""Page snapshots and page lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shapes import align

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("h1", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())), T.StructField("response_time", T.DoubleType()),
    T.StructField("last_modified", T.StringType()), T.StructField("has_structured_data", T.BooleanType()),
    T.StructField("json_ld", T.ArrayType(T.StringType())), T.StructField("h2_count", T.IntegerType()),
    T.StructField("lists_count", T.IntegerType()), T.StructField("html_full_size", T.LongType()),
    T.StructField("fallback_used", T.BooleanType()), T.StructField("markdown", T.StringType()),
    T.StructField("fit_markdown", T.StringType()), T.StructField("success", T.BooleanType()),
])

SITEMAP_CSV = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("has_jsonld", T.BooleanType()), T.StructField("jsonld_quality", T.DoubleType()),
    T.StructField("content_quality", T.DoubleType()), T.StructField("monthly_traffic", T.LongType()),
    T.StructField("backlinks", T.LongType()), T.StructField("last_modified", T.StringType()),
])
REQUIRED = ["url", "content_type"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshot with all page columns; those the files lack are null."""
    return align(spark.read.parquet(path), PAGE_SCHEMA)


def read_pages_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV page list with typed columns; ``url`` and ``content_type`` must be there, the rest may be missing."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    have = set(raw.columns)
    cell = lambda f: F.trim(F.col(f.name)).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return raw.select(*[cell(f).alias(f.name) for f in SITEMAP_CSV.fields])


def parse_pages_csv(lines: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Uploaded page lists as (upload, line_no, page columns), and the uploads refused with their missing columns.

    ``lines`` holds (upload, line_no, line), line 0 being the header, of at most ``most`` columns in any order and any case of names. An upload without
    ``url`` and ``content_type`` is refused whole; other columns may be missing, cells that can't be read are null, rows without url go.
    """
    cells = F.from_csv("line", ", ".join(f"c{k} string" for k in range(most)))
    parsed = lines.select("upload", "line_no", F.array(*[cells[f"c{k}"] for k in range(most)]).alias("cells"))
    # One header per upload: Spark broadcasts them or not by their size.
    heads = parsed.filter("line_no = 0").select("upload", F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))).alias("names"))
    missing = F.filter(F.array(*map(F.lit, REQUIRED)), lambda r: ~F.array_contains("names", r))
    heads = heads.withColumn("missing", missing)
    at = lambda name: F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)
    rows = parsed.filter("line_no > 0").join(heads.filter(F.size("missing") == 0), "upload")
    typed = rows.select("upload", "line_no", *[F.nullif(F.trim(at(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in SITEMAP_CSV.fields])
    return typed.filter("url IS NOT NULL"), heads.filter(F.size("missing") > 0).select("upload", F.array_join("missing", ", ").alias("missing"))


def truncate_html(pages: DataFrame, n: int = 5120) -> DataFrame:
    """Keep the first ``n`` characters of each page and its full size."""
    return pages.withColumn("html_full_size", F.length("html").cast("long")).withColumn("html", F.substring("html", 1, n))
