"""Exports of cluster models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_or


def _name() -> Column:
    name = strip(F.coalesce("model_name", F.lit("")))
    return F.when(name == "", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).otherwise(name)


def export_models(models: DataFrame) -> DataFrame:
    """One JSON text per cluster model: names, counts, pattern, at most five urls, documents and delta.

    ``models`` holds (cluster_id, model_name, schema_type, page_count, url_pattern, sample_urls array, and
    dom_structure, existing_jsonld, optimized_jsonld, delta as JSON text).
    """
    doc = lambda c: F.try_parse_json(F.col(c))
    body = F.struct(
        _name().alias("model_name"), text_or(strip(F.coalesce("schema_type", F.lit(""))), "WebPage").alias("schema_type"),
        F.col("page_count"), F.col("url_pattern"), F.slice("sample_urls", 1, 5).alias("sample_urls"),
        doc("dom_structure").alias("dom_structure"), doc("existing_jsonld").alias("existing_jsonld"),
        doc("optimized_jsonld").alias("optimized_jsonld"), doc("delta").alias("optimized_jsonld_delta"))
    return models.select("cluster_id", F.to_json(body).alias("json"))


def export_manifest(models: DataFrame) -> DataFrame:
    """Manifest rows with the file name of every model."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_name()), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return models.select(
        F.col("cluster_id").alias("id"), _name().alias("name"), F.coalesce("schema_type", F.lit("WebPage")).alias("schema_type"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce(F.col("optimized_jsonld") != "", F.lit(False)).alias("has_jsonld"),
        F.format_string("%02d_%s.json", F.col("cluster_id"), slug).alias("file"))


def write_json(exported: DataFrame, path: str) -> None:
    exported.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
