"""Sitemap prioritisation: scores, citable pages, lists, statistics and table maintenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numbers import round_to
from ..functions.text import falsy, literal_map, trimmed_or
from ..plans.shapes import in_turn, latest, top_k, with_row_number
from .jsonld import jsonld_quality
from .pages import content_quality

# Weight of each content type for search engines.
SEO_WEIGHTS = {
    "guide": 0.90, "article": 0.85, "product": 0.80, "category": 0.75, "service": 0.75, "landing": 0.70, "page": 0.60,
    "faq": 0.65, "blog": 0.70, "news": 0.80, "event": 0.65, "job": 0.55, "legal": 0.20, "other": 0.40,
}

# Weight of each content type for answer engines.
GEO_WEIGHTS = {
    "guide": 0.95, "article": 0.90, "faq": 0.85, "product": 0.70, "service": 0.80, "category": 0.50, "landing": 0.55,
    "page": 0.45, "blog": 0.75, "news": 0.70, "event": 0.60, "job": 0.40, "legal": 0.10, "other": 0.30,
}

# Content types that never enter a sitemap.
EXCLUDED_TYPES = ["legal", "login", "404", "redirect", "admin"]

# Schema types and the content type each one stands for.
SCHEMA_CONTENT_TYPES = {
    "jobposting": "job", "product": "product", "article": "article", "newsarticle": "news", "blogposting": "blog",
    "event": "event", "faqpage": "faq", "localbusiness": "service", "organization": "page", "webpage": "page",
    "collectionpage": "category",
}

# Default name of a workspace.
DEFAULT_WORKSPACE = "Non classé"

# The columns a user may edit.
EDITABLE = ["status", "content_type", "has_jsonld", "jsonld_quality", "content_quality", "monthly_traffic", "backlinks"]


@dataclass(frozen=True)
class SitemapConfig:
    as_of: str
    min_jsonld_quality: float = 0.5
    min_content_quality: float = 0.5
    max_urls_geo: int = 500
    exclude_content_types: list = field(default_factory=list)


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(table), key), F.lit(default))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def content_type() -> Column:
    return F.lower(F.when(falsy(F.col("content_type")), "page").otherwise(F.col("content_type")))


def freshness(last_modified: Column, as_of) -> Column:
    """0.3 to 1.0 by age in days; unknown dates count as old."""
    age = D.days_between(D.sitemap_date(last_modified), D.as_moment(as_of))
    return (F.when(age <= 7, 1.0).when(age <= 30, 0.9).when(age <= 90, 0.7).when(age <= 365, 0.5).otherwise(0.3))


def _log_score(count: Column, decades: float) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n <= 0, F.lit(0.0)).otherwise(_clamp(F.log10(n + 1) / F.lit(decades)))


def traffic_score(visits: Column) -> Column:
    return _log_score(visits, 5.0)


def backlink_score(links: Column) -> Column:
    return _log_score(links, 4.0)


def _trusted_jsonld() -> Column:
    return F.when(F.coalesce("has_jsonld", F.lit(False)), _or_zero("jsonld_quality")).otherwise(F.lit(0.0))


def _weighted(*parts) -> Column:
    first, *rest = [F.lit(w) * c for w, c in parts]
    return round_to(_clamp(sum(rest, first)), 2)


def seo_priority(as_of) -> Column:
    return _weighted((0.25, _lookup(SEO_WEIGHTS, content_type(), 0.40)), (0.20, _or_zero("content_quality")),
                     (0.20, traffic_score(F.col("monthly_traffic"))), (0.15, backlink_score(F.col("backlinks"))),
                     (0.10, freshness(F.col("last_modified"), as_of)), (0.10, _trusted_jsonld()))


def geo_priority(as_of) -> Column:
    return _weighted((0.30, _trusted_jsonld()), (0.25, _or_zero("content_quality")),
                     (0.20, _lookup(GEO_WEIGHTS, content_type(), 0.30)), (0.15, freshness(F.col("last_modified"), as_of)),
                     (0.10, traffic_score(F.col("monthly_traffic"))))


def _active() -> Column:
    return F.when(falsy(F.col("status")), "active").otherwise(F.col("status")) == "active"


def is_citable(cfg: SitemapConfig) -> Column:
    """Active page of an allowed type with JSON-LD and both qualities at their thresholds."""
    return (~content_type().isin(EXCLUDED_TYPES) & _active() & F.coalesce("has_jsonld", F.lit(False))
            & (_or_zero("jsonld_quality") >= cfg.min_jsonld_quality) & (_or_zero("content_quality") >= cfg.min_content_quality))


def changefreq(as_of) -> Column:
    t, fresh = content_type(), freshness(F.col("last_modified"), as_of)
    return (F.when(t.isin("news", "blog"), "daily").when(t.isin("product", "event", "job"), "weekly")
            .when(fresh >= 0.9, "daily").when(fresh >= 0.7, "weekly").when(fresh >= 0.5, "monthly").otherwise("yearly"))


def apply_exclusions(pages: DataFrame, cfg: SitemapConfig) -> DataFrame:
    dropped = [*EXCLUDED_TYPES, *cfg.exclude_content_types]
    return pages.filter(~falsy(F.col("url")) & ~content_type().isin(dropped) & _active())


def _entry(cfg: SitemapConfig, priority: Column, *more: Column) -> list[Column]:
    day = F.substring("last_modified", 1, 10)
    return [F.col("project_id"), F.col("page_id"), F.col("url"), F.nullif(day, F.lit("")).alias("lastmod"), priority.alias("priority"),
            changefreq(cfg.as_of).alias("changefreq"), F.coalesce("content_type", F.lit("page")).alias("content_type"), *more]


def seo_sitemap(pages: DataFrame, cfg: SitemapConfig) -> DataFrame:
    """Entries of every eligible page, highest priority first, in input order on ties."""
    rows = apply_exclusions(pages, cfg).select(*_entry(cfg, seo_priority(cfg.as_of)))
    return rows.orderBy(F.desc("priority"), "page_id")


def geo_sitemap(pages: DataFrame, cfg: SitemapConfig) -> DataFrame:
    """The best ``max_urls_geo`` citable pages of every project."""
    rows = apply_exclusions(pages, cfg).filter(is_citable(cfg)).select(
        *_entry(cfg, geo_priority(cfg.as_of), F.col("has_jsonld"), _or_zero("jsonld_quality").alias("jsonld_quality")))
    best = top_k(rows, ["project_id"], [F.desc("priority"), F.col("page_id")], cfg.max_urls_geo)
    return best.orderBy("project_id", F.desc("priority"), "page_id")


def sitemap_stats(entries: DataFrame) -> DataFrame:
    """Total and mean priority, and counts by type and by change frequency, from one pass over the list."""
    dims = entries.select("content_type", "changefreq", "priority")
    sets = dims.groupingSets([[], ["content_type"], ["changefreq"]], "content_type", "changefreq").agg(
        F.count("*").alias("count"), round_to(F.avg("priority"), 3).alias("avg_priority"), F.grouping_id().alias("_set"))
    kind = F.when(F.col("_set") == 3, "total").when(F.col("_set") == 1, "content_type").otherwise("changefreq")
    return sets.select(kind.alias("dimension"), F.coalesce("content_type", "changefreq", F.lit("")).alias("value"), "count",
                       F.when(kind == "total", F.col("avg_priority")).alias("avg_priority"))


def recompute_priorities(pages: DataFrame, cfg: SitemapConfig) -> DataFrame:
    """Both priorities and the citable flag of active pages; other pages keep theirs."""
    keep = lambda name, new: F.when(_active(), new).otherwise(
        F.col(name) if name in pages.columns else F.lit(None)).alias(name)
    base = [c for c in pages.columns if c not in ("seo_priority", "geo_priority", "is_citable")]
    return pages.select(*base, keep("seo_priority", seo_priority(cfg.as_of)), keep("geo_priority", geo_priority(cfg.as_of)),
                        keep("is_citable", is_citable(cfg)))


def list_pages(pages: DataFrame, project_id=None, status=None, is_citable=None, content_type=None, limit: int | None = None) -> DataFrame:
    """Page listing of a project, best first: whole, unless the caller asks for so many."""
    wanted = {"project_id": project_id, "status": status, "is_citable": is_citable, "content_type": content_type}
    for name, value in wanted.items():
        if value is not None:
            pages = pages.filter(F.col(name) == value)
    listed = pages.orderBy(F.desc("seo_priority"), "page_id")
    return listed if limit is None else listed.limit(limit)


def page_counts(pages: DataFrame) -> DataFrame:
    """Per project: pages, distinct types, pages with JSON-LD and, where known, citable pages.

    Types are reduced per project first, so the distinct count never expands a hot project.
    """
    flag = lambda c: F.count_if(F.col(c)) if c in pages.columns else F.lit(0).cast("long")
    per_type = pages.groupBy("project_id", "content_type").agg(
        F.count("*").alias("n"), flag("has_jsonld").alias("with_jsonld"), flag("is_citable").alias("citable"))
    return per_type.groupBy("project_id").agg(F.sum("n").alias("pages"), F.count("content_type").alias("types"),
                                              F.sum("with_jsonld").alias("with_jsonld"), F.sum("citable").alias("citable"))


def content_type_of(schema_type: Column) -> Column:
    """Content type of a schema type, ``page`` by default."""
    return _lookup(SCHEMA_CONTENT_TYPES, F.lower(F.when(falsy(schema_type), "WebPage").otherwise(schema_type)), "page")


def page_types(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Content type of every clustered url and whether its cluster has an optimised document.

    ``members`` holds (cluster_id, url), ``labels`` (cluster_id, schema_type, optimized). A url in
    several clusters takes the type of the last one.
    """
    opt = F.coalesce(F.col("optimized") != "", F.lit(False))
    tagged = members.filter(~falsy(F.col("url"))).join(
        labels.select("cluster_id", content_type_of(F.col("schema_type")).alias("content_type"), opt.alias("has_optimized")), "cluster_id")
    return tagged.groupBy("url").agg(F.max_by("content_type", "cluster_id").alias("content_type"),
                                     F.max("has_optimized").alias("has_optimized"))


def pages_to_sitemap(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Sitemap rows of a crawl: type from the page's cluster, qualities from its facts, no traffic yet.

    ``json_ld`` is the array of a page's blocks; an array as such has quality 0.6.
    """
    rated = content_quality(facts.filter(~falsy(F.col("url")))).join(types, "url", "left")
    blocks = F.when(F.col("has_structured_data"), F.lit("[0]"))
    return rated.select(
        "page_id", "url", F.coalesce(F.col("content_type"), F.lit("page")).alias("content_type"),
        F.col("has_structured_data").alias("has_jsonld"),
        jsonld_quality(blocks, F.col("has_optimized")).alias("jsonld_quality"), "content_quality",
        F.lit(0).cast("long").alias("monthly_traffic"), F.lit(0).cast("long").alias("backlinks"),
        (F.col("last_modified") if "last_modified" in facts.columns else F.lit(None).cast("string")).alias("last_modified"))


def clean_import(incoming: DataFrame, *carried: str) -> DataFrame:
    """Rows fit for the page table: web addresses only, qualities within 0..1, counts at least 0, active."""
    c = F.col
    url = F.trim(F.coalesce("url", F.lit("")))
    return incoming.filter(url.rlike("^https?://")).select(
        "project_id", url.alias("url"), F.substring(content_type(), 1, 100).alias("content_type"),
        F.coalesce(c("has_jsonld"), F.lit(False)).alias("has_jsonld"),
        _clamp(_or_zero("jsonld_quality")).alias("jsonld_quality"), _clamp(_or_zero("content_quality")).alias("content_quality"),
        F.greatest(F.lit(0), F.coalesce(c("monthly_traffic").cast("long"), F.lit(0))).alias("monthly_traffic"),
        F.greatest(F.lit(0), F.coalesce(c("backlinks").cast("long"), F.lit(0))).alias("backlinks"),
        F.nullif(c("last_modified"), F.lit("")).alias("last_modified"), F.lit("active").alias("status"), *carried)


def upsert_pages(existing: DataFrame, incoming: DataFrame, order: str = "batch") -> DataFrame:
    """New pages added, known ones (same project and url) replaced; the last row of a batch wins."""
    fresh = clean_import(incoming, order)
    fresh = latest(fresh, ["project_id", "url"], [F.desc(order)]).drop(order)
    kept = existing.join(fresh.select("project_id", "url"), ["project_id", "url"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def update_pages(pages: DataFrame, patch: DataFrame, key: str = "page_id", order: str | None = None) -> DataFrame:
    """Apply a patch table to the editable columns; null means unchanged, and of several patches the last by ``order`` wins."""
    cols = [c for c in EDITABLE if c in patch.columns]
    p = in_turn(patch, [key], cols, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return pages.join(p, key, "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in pages.columns])


def delete_pages(pages: DataFrame, ids: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages without those listed, by page id or by project id."""
    return pages.join(ids.select(key).distinct(), key, "left_anti").select(*pages.columns)


def delete_projects(projects: DataFrame, pages: DataFrame, generations: DataFrame, ids: DataFrame):
    """Projects without those listed, with their pages and generations."""
    gone = ids.select("project_id").distinct()
    return tuple(t.join(gone, "project_id", "left_anti").select(*t.columns) for t in (projects, pages, generations))


def register_projects(projects: DataFrame, incoming: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
    """Add projects with defaults; names must be unique per workspace. Returns (projects, rejects)."""
    c = F.col
    base = int(projects.agg(F.coalesce(F.max("project_id"), F.lit(0))).head()[0])
    rows = incoming.select(
        c("batch"), trimmed_or(c("workspace"), DEFAULT_WORKSPACE).alias("workspace"),
        F.lower(F.trim(F.coalesce("user_email", F.lit("")))).alias("user_email"), "name",
        F.coalesce("description", F.lit("")).alias("description"), "domain",
        F.coalesce("max_urls_geo", F.lit(500)).alias("max_urls_geo"),
        F.coalesce("exclude_content_types", F.lit("[]")).alias("exclude_content_types"),
        F.coalesce("min_content_quality", F.lit(0.5)).alias("min_content_quality"),
        F.coalesce("min_jsonld_quality", F.lit(0.5)).alias("min_jsonld_quality"))
    key = ["workspace", "name"]
    first = latest(rows.join(projects.select(*key), key, "left_anti"), key, [c("batch")])
    numbered = with_row_number(first, ["batch"], "project_id").withColumn("project_id", c("project_id") + base)
    added = numbered.withColumn("created_at", F.lit(created_at))
    rejects = rows.join(added.select("batch"), "batch", "left_anti")
    return projects.unionByName(added.select(*projects.columns)), rejects


def list_projects(projects: DataFrame, workspace: str) -> DataFrame:
    ws = (workspace or "").strip() or DEFAULT_WORKSPACE
    return projects.filter(F.col("workspace") == ws).orderBy(F.desc("created_at"), "project_id")


def update_projects(projects: DataFrame, patch: DataFrame, order: str | None = None) -> DataFrame:
    """Partial update by project id; null means unchanged, and of several patches the last by ``order`` wins."""
    cols = [c for c in patch.columns if c not in ("project_id", order) and c in projects.columns]
    p = in_turn(patch, ["project_id"], cols, order).select("project_id", *[F.col(c).alias(f"_new_{c}") for c in cols])
    return projects.join(p, "project_id", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in projects.columns])


def append_generations(generations: DataFrame, rows: DataFrame) -> DataFrame:
    clean = rows.withColumn("generated_by", F.lower(F.trim(F.coalesce("generated_by", F.lit("")))))
    return generations.unionByName(clean.select(*generations.columns))


def latest_generations(generations: DataFrame, limit: int = 20) -> DataFrame:
    """The newest generations of every project."""
    return top_k(generations, ["project_id"], [F.desc("generated_at"), F.desc("generation_id")], limit, "position")


def delete_generations(generations: DataFrame, ids: DataFrame) -> DataFrame:
    return generations.join(ids.select("generation_id").distinct(), "generation_id", "left_anti").select(*generations.columns)
