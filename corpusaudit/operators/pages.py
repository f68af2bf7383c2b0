"""Page facts: one projection over the raw HTML, shared by every later operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.numbers import round_to
from ..functions.text import falsy, word_count
from . import jsonld


def page_facts(pages: DataFrame) -> DataFrame:
    """Everything later operators need from ``html``, so that it is read and cleaned once.

    Cleaned text and tag names are columns of their own: each is computed once per page
    however many facts read it. Write the result to Parquet; no later step reads ``html``.
    """
    staged = pages.withColumn("_clean", H.drop_elements(F.col("html"))).withColumn("_tags", H.tag_names(F.col("_clean")))
    for name, value in H.heads(F.col("_clean"), F.col("url")).items():
        staged = staged.withColumn(name, value)
    blocks = F.filter(F.transform(F.regexp_extract_all("html", F.lit(jsonld.BLOCK), F.lit(1)), H.strip),
                      lambda b: (b != "") & jsonld.V.parse(b).isNotNull())
    types = F.flatten(F.transform(F.col("json_ld"), lambda b: jsonld.top_level_types(jsonld.V.parse(b))))
    return (staged
            .withColumn("json_ld", blocks)
            .select(
                *[c for c in pages.columns if c not in ("html", "h1", "description", "title", "json_ld")],
                U.host(F.col("url")).alias("site"),
                F.col("_raw_title").alias("raw_title"), "title", "h1", "description", "json_ld",
                (F.size("json_ld") > 0).alias("has_structured_data"),
                H.structure_of(F.col("_tags")).alias("dom_structure"),
                H.semantics_of(F.col("_clean"), F.col("_tags"), types).alias("semantic_features"),
                F.coalesce(U.path_pattern(F.col("url")), F.array().cast("array<string>")).alias("pattern"),
                H.count_tags(F.col("_tags"), "h2").alias("h2_count"),
                H.count_tags(F.col("_tags"), "ul", "ol").alias("lists_count"),
                word_count(H.visible_text(F.col("html"))).alias("word_count"),
                F.length("html").alias("html_full_size"),
                H.links_of(F.col("_clean")).alias("hrefs")))


def script_type_counts(pages: DataFrame, *keys: str) -> DataFrame:
    """Number of script elements per type, over the corpus or per given key, most frequent first."""
    rows = pages.select(*keys, F.explode(H.script_types(F.col("html"))).alias("type"))
    return rows.groupBy(*keys, "type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type", *keys)


def light_pages(facts: DataFrame) -> DataFrame:
    """Eight keys of a page with capped texts, and its JSON-LD in short form."""
    light = F.transform(F.col("json_ld"), jsonld.light_jsonld)
    return facts.select(
        *[c for c in ("page_id", "site") if c in facts.columns], "url",
        F.substring("title", 1, 300).alias("title"), F.substring("description", 1, 400).alias("description"),
        F.substring("h1", 1, 400).alias("h1"), "h2_count", "has_structured_data",
        *[(F.col(c) if c in facts.columns else F.lit(None).cast(t)).alias(c)
          for c, t in (("response_time", "double"), ("last_modified", "string"))],
        F.when(F.size("json_ld") > 0, F.flatten(F.array_compact(light))).alias("json_ld"))


def content_quality(facts: DataFrame) -> DataFrame:
    """Add ``content_quality``: title, description, h1, sub-headings and JSON-LD, each with its share."""
    c = F.col
    parts = [(~falsy(c("title")), 0.25), (F.length("description") > 50, 0.25), (~falsy(c("h1")), 0.20),
             (c("h2_count") >= 2, 0.15), (c("has_structured_data"), 0.15)]
    total = sum((F.when(test, w).otherwise(0.0) for test, w in parts[1:]), F.when(parts[0][0], parts[0][1]).otherwise(0.0))
    return facts.withColumn("content_quality", round_to(F.least(F.lit(1.0), total), 2))


