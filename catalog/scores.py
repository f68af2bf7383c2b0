"""Readability scores, sitemap priorities, crawler access and the authority index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.operators import access, authority, geo, links, sitemap as M
from corpusaudit.operators.entity import kg_features
from corpusaudit.operators.jsonld import structured_footprint
from corpusaudit.operators.pages import content_quality
from corpusaudit.plans.shapes import shared_folder
from corpusaudit.sources.pages import parse_pages_csv
from corpusaudit.sources.sitemaps import (expand_sitemap_index, project_sitemap_index, read_index, read_sitemap, sitemap_entries, sitemap_rows, write_project_indexes,
                                          write_project_sitemaps)

from . import sqlfn as S
from .base import AS_OF, query, table, view, with_views
from .pages import FACTS, facts, rich

c = F.col
PIPE = "'|'"

# ---------------------------------------------------------------- page scores

EXTRA = """CASE WHEN page_id % 11 = 0 THEN NULL ELSE CAST(page_id % 25 AS DOUBLE) / 10 END AS response_time,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(DATE '2024-01-31' - CAST((page_id * 13) % 500 AS INT) AS STRING)
    WHEN 2 THEN CAST(DATE '2024-01-31' - CAST((page_id * 7) % 200 AS INT) AS STRING) || 'T10:00:00+02:00'
    WHEN 3 THEN 'Tue, 02 Jan 2024 10:00:00 GMT' WHEN 4 THEN 'hier' ELSE '2023-08-04T00:00:00' END AS last_modified"""


def scoring_input(spark, sf):
    return rich(spark, sf).selectExpr("page_id", "url", "html", EXTRA.split(" AS response_time,")[0] + " AS response_time",
                                      EXTRA.split(" AS response_time,")[1])


def scored_pages(spark, sf):
    return geo.geo_score(scoring_input(spark, sf), AS_OF)


AGE = "floor((epoch(TIMESTAMP '2024-01-31') - epoch(d)) / 86400)"
ENTITY = " + ".join(S.rcount("full_text", p.replace(r"\b", r"\b")) for p in geo.ENTITY_PATTERNS)
GEO_SQL = f"""{FACTS}, g0 AS (SELECT page_id, url, html, clean, tag, title, h1, description, {EXTRA} FROM facts),
g1 AS (SELECT *, length(description) AS dl, string_split_regex(lower(trim(description)), '\\s+') AS dw,
  list_reduce([list_transform({S.rall('html', '''(?is)<script\\b[^>]*\\btype\\s*=\\s*["']?application/ld\\+json[^>]*>(.*?)</script''', 1)}, lambda b:
    CASE WHEN contains(b, '@type') THEN list_filter({S.list_of(["Organization", "Article", "FAQPage", "HowTo", "Product", "Person"])}, lambda k: contains(b, k)) ELSE [] END)], lambda x, y: x) AS hits,
  {S.drop('html', S.CHROME)} AS body, concat_ws(' ', title, description, html) AS full_text, string_split(last_modified, '+')[1] AS lm FROM g0),
g2 AS (SELECT *, flatten(hits) AS types, {S.words(S.decode(S.rr('body', S.TAG, ' ')))} AS words, {S.n_tags(S.tags('body'), 'p')} AS paragraphs,
  len(list_filter({S.hrefs('body')}, lambda z: starts_with(z, 'http') AND NOT contains(z, {S.netloc('url')}))) AS ext,
  {S.n_tags('tag', 'h2')} AS h2, {S.n_tags('tag', 'ul', 'ol')} AS lists, {ENTITY} AS entities,
  coalesce(try_strptime(lm, '%Y-%m-%d'), try_strptime(lm, '%Y-%m-%dT%H:%M:%S'), try_strptime(lm, '%a, %d %b %Y %H:%M:%S GMT')) AS d FROM g1),
g3 AS (SELECT page_id, url,
  CASE WHEN dl = 0 THEN 0 ELSE CASE WHEN dl BETWEEN 120 AND 160 THEN 10 WHEN dl BETWEEN 100 AND 200 THEN 7 ELSE 3 END
    + CASE WHEN {S.any_in('lower(description)', geo.ACTION_WORDS)} THEN 3 ELSE 0 END
    + CASE WHEN len(list_distinct(dw))::DOUBLE / len(dw) > 0.7::DOUBLE THEN 2 ELSE 0 END END AS meta_description,
  CASE WHEN length(h1) = 0 THEN 0 ELSE 5 + CASE WHEN length(h1) BETWEEN 40 AND 70 THEN 3 WHEN length(h1) < 40 THEN 1 ELSE 2 END
    + CASE WHEN contains(h1, '?') THEN 2 ELSE 0 END END AS h1_quality,
  CASE WHEN response_time IS NULL OR response_time < 0.5::DOUBLE THEN 10 WHEN response_time < 1 THEN 7 WHEN response_time < 2 THEN 4 ELSE 1 END AS response_time,
  CASE WHEN len(hits) = 0 THEN 0 ELSE 8 + CASE WHEN list_contains(types, 'FAQPage') OR list_contains(types, 'HowTo') THEN 5 WHEN len(types) >= 2 THEN 3 ELSE 2 END END AS structured_data,
  CASE WHEN h2 >= 3 THEN 5 WHEN h2 >= 1 THEN 3 ELSE 0 END + CASE WHEN lists >= 3 THEN 5 WHEN lists >= 1 THEN 3 ELSE 0 END
    + CASE WHEN {S.n_tags('tag', 'table')} > 0 THEN 3 ELSE 0 END + CASE WHEN {S.n_tags('tag', 'strong', 'b')} >= 5 THEN 2 ELSE 0 END
    + CASE WHEN {S.n_tags('tag', 'dt', 'dd', 'blockquote')} > 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 10 = 0 THEN 3 ELSE 0 END AS semantic_structure,
  CASE WHEN words >= 1500 THEN 8 WHEN words >= 800 THEN 6 WHEN words >= 300 THEN 3 ELSE 0 END + CASE WHEN paragraphs >= 5 THEN 4 WHEN paragraphs >= 3 THEN 2 ELSE 0 END
    + CASE WHEN ext >= 3 THEN 3 WHEN ext >= 1 THEN 1 ELSE 0 END AS content_depth,
  CASE WHEN entities >= 10 THEN 10 WHEN entities >= 5 THEN 7 WHEN entities >= 2 THEN 4 ELSE 0 END AS entity_richness,
  CASE WHEN {AGE} <= 90 THEN 5 WHEN {AGE} <= 180 THEN 3 WHEN {AGE} <= 365 THEN 2 ELSE 0 END AS freshness,
  [CASE WHEN dl = 0 THEN 'Aucune meta description' END, CASE WHEN dl > 0 AND (dl BETWEEN 100 AND 119 OR dl BETWEEN 161 AND 200) THEN 'Longueur sous-optimale (' || dl || ' caractères)' END,
   CASE WHEN dl > 0 AND NOT dl BETWEEN 100 AND 200 THEN 'Longueur inappropriée (' || dl || ' caractères)' END,
   CASE WHEN dl > 0 AND len(list_distinct(dw))::DOUBLE / len(dw) <= 0.7::DOUBLE THEN 'Trop de répétitions de mots' END] AS meta_issues,
  [CASE WHEN length(h1) = 0 THEN 'Pas de balise H1' WHEN length(h1) < 40 THEN 'H1 trop court' WHEN length(h1) > 70 THEN 'H1 trop long' END] AS h1_issues,
  [CASE WHEN response_time >= 2 THEN printf('Temps de réponse très lent (%.2fs)', response_time) WHEN response_time >= 1 THEN printf('Temps de réponse lent (%.2fs)', response_time) END] AS time_issues,
  [CASE WHEN len(hits) = 0 THEN 'Aucune donnée structurée JSON-LD' WHEN NOT (list_contains(types, 'FAQPage') OR list_contains(types, 'HowTo')) AND len(types) < 2 THEN 'Schema basique seulement' END] AS data_issues,
  [CASE WHEN h2 = 0 THEN 'Aucun sous-titre H2' WHEN h2 < 3 THEN 'Peu de sous-titres H2' END, CASE WHEN lists = 0 THEN 'Aucune liste' WHEN lists < 3 THEN 'Peu de listes' END] AS structure_issues,
  [CASE WHEN words < 300 THEN 'Contenu insuffisant' WHEN words < 800 THEN 'Contenu léger' WHEN words < 1500 THEN 'Contenu moyen' END, CASE WHEN ext = 0 THEN 'Pas de liens externes' END] AS depth_issues,
  [CASE WHEN entities < 2 THEN 'Manque d''entités' WHEN entities < 5 THEN 'Peu d''entités détectées' END] AS entity_issues,
  [CASE WHEN last_modified IS NULL THEN 'Date de modification inconnue' WHEN {AGE} > 365 THEN 'Contenu ancien (' || CAST({AGE} AS BIGINT) || ' jours)' WHEN {AGE} > 180 THEN 'Contenu de plus de 6 mois' END] AS fresh_issues
  FROM g2),
g4 AS (SELECT *, meta_description + h1_quality + response_time + structured_data + semantic_structure + content_depth + entity_richness + freshness AS total FROM g3),
scored AS (SELECT *, CASE WHEN total >= 90 THEN 'A+' WHEN total >= 80 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 50 THEN 'D' ELSE 'F' END AS grade FROM g4)"""

ISSUES = {"meta_description": "meta_issues", "h1_quality": "h1_issues", "response_time": "time_issues", "structured_data": "data_issues",
          "semantic_structure": "structure_issues", "content_depth": "depth_issues", "entity_richness": "entity_issues", "freshness": "fresh_issues"}

for _i, (_k, _issues) in enumerate(ISSUES.items()):
    def _criterion(spark, sf, k=_k, i=_i):
        own = {"meta_description": "Meta Description", "freshness": "Fraîcheur", "response_time": "Performance", "content_depth": "Contenu",
               "entity_richness": "Entités", "structured_data": "Données Structurées", "semantic_structure": "Structure Sémantique"}
        mine = lambda r: r["category"].isin("H1", "Structure HTML") if k == "h1_quality" else r["category"] == own[k]
        issues = F.transform(F.filter("recommendations", mine), lambda r: r["issue"])
        return scored_pages(spark, sf).select("page_id", c(f"breakdown.{k}").alias("points"), F.array_join(issues, "|").alias("issues"))

    query(f"score_{_k}", f"GEO-{_i + 1}", f"{GEO_SQL} SELECT page_id, CAST({_k} AS INTEGER) AS points, array_to_string(list_filter({_issues}, lambda x: x IS NOT NULL), {PIPE}) AS issues FROM scored")(_criterion)


@query("page_scores", "GEO-9", f"{GEO_SQL} SELECT page_id, url, CAST(total AS INTEGER) AS total_score, grade, {', '.join(f'CAST({k} AS INTEGER) AS {k}' for k in geo.CRITERIA)} FROM scored")
def _(spark, sf):
    return scored_pages(spark, sf).select("page_id", "url", "total_score", "grade", "breakdown.*")


@query("page_recommendations", "GEO-10", f"""{GEO_SQL}, r AS (SELECT page_id, list_filter(flatten([{', '.join(ISSUES.values())}]), lambda x: x IS NOT NULL) AS issues FROM scored)
SELECT page_id, CAST(len(issues) AS BIGINT) AS n, array_to_string(issues, {PIPE}) AS issues FROM r""")
def _(spark, sf):
    issues = F.transform("recommendations", lambda r: r["issue"])
    return scored_pages(spark, sf).select("page_id", F.size("recommendations").cast("long").alias("n"), F.array_join(issues, "|").alias("issues"))


@query("score_severity", "GEO-11", """SELECT page_id, CASE WHEN s >= 95 THEN 'OPTIMISE' WHEN s >= 50 THEN 'NON OPTIMISE' ELSE 'CRITIQUE' END AS severity,
  CASE WHEN s >= 95 THEN '#10b981' WHEN s >= 50 THEN '#FFA500' ELSE '#FF4B4B' END AS color,
  CASE WHEN s >= 80 THEN '#10b981' WHEN s >= 60 THEN '#FFA500' ELSE '#FF4B4B' END AS grade_color FROM (SELECT page_id, page_id % 101 AS s FROM pages)""")
def _(spark, sf):
    s = c("page_id") % 101
    return table(spark, sf, "pages").select("page_id", geo.severity(s).alias("severity"), links.score_color(s).alias("color"),
                                            geo.grade_color(geo.grade(s)).alias("grade_color"))


@query("site_scores", "GEO-9 §7.1", f"""{GEO_SQL} SELECT {S.host('url')} AS site, CAST(count(*) AS BIGINT) AS pages, round(avg(total), 2) AS avg_score,
  {', '.join(f"CAST(count(*) FILTER (grade = '{g}') AS BIGINT) AS {n}" for g, n in (("A+", "grade_a_plus"), ("A", "grade_a"), ("B", "grade_b"), ("C", "grade_c"), ("D", "grade_d"), ("F", "grade_f")))}
FROM scored GROUP BY 1""")
def _(spark, sf):
    return geo.site_scores(scored_pages(spark, sf))


@query("content_quality", "MAP-15", f"""{FACTS} SELECT page_id, CAST(printf('%.2f', CAST(least(1.0::DOUBLE, CASE WHEN title <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(description) > 50 THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN h1 <> '' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN h2_count >= 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN has_structured_data THEN 0.15::DOUBLE ELSE 0 END) AS DOUBLE)) AS DOUBLE) AS content_quality FROM facts""")
def _(spark, sf):
    return content_quality(facts(spark, sf)).select("page_id", "content_quality")


# ---------------------------------------------------------------- sitemap

CFG = M.SitemapConfig(as_of=AS_OF)


def lookup(weights: dict, default: float) -> str:
    return "CASE ct " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + f" ELSE {default}::DOUBLE END"


def log_score(col: str, decades: int) -> str:
    return f"CASE WHEN {col} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, log10(({col} + 1)::DOUBLE) / {decades}.0::DOUBLE) END"


MAP_SQL = f"""{with_views('site_pages')}, s1 AS (SELECT *, lower(coalesce(nullif(content_type, ''), 'page')) AS ct,
  date_diff('day', try_strptime(last_modified, '%Y-%m-%d'), TIMESTAMP '2024-01-31') AS age FROM site_pages),
s2 AS (SELECT *, CASE WHEN age <= 7 THEN 1.0::DOUBLE WHEN age <= 30 THEN 0.9::DOUBLE WHEN age <= 90 THEN 0.7::DOUBLE WHEN age <= 365 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS fresh,
  {log_score('monthly_traffic', 5)} AS traffic, {log_score('backlinks', 4)} AS links, CASE WHEN has_jsonld THEN jsonld_quality ELSE 0.0::DOUBLE END AS jld FROM s1),
s3 AS (SELECT *, CAST(printf('%.2f', CAST(greatest(0, least(1, 0.25::DOUBLE * {lookup(M.SEO_WEIGHTS, 0.4)} + 0.2::DOUBLE * content_quality + 0.2::DOUBLE * traffic + 0.15::DOUBLE * links + 0.1::DOUBLE * fresh + 0.1::DOUBLE * jld)) AS DOUBLE)) AS DOUBLE) AS seo,
  CAST(printf('%.2f', CAST(greatest(0, least(1, 0.3::DOUBLE * jld + 0.25::DOUBLE * content_quality + 0.2::DOUBLE * {lookup(M.GEO_WEIGHTS, 0.3)} + 0.15::DOUBLE * fresh + 0.1::DOUBLE * traffic)) AS DOUBLE)) AS DOUBLE) AS geo,
  ct NOT IN ('legal', 'login', '404', 'redirect', 'admin') AND status = 'active' AS eligible,
  CASE WHEN ct IN ('news', 'blog') THEN 'daily' WHEN ct IN ('product', 'event', 'job') THEN 'weekly' WHEN fresh >= 0.9::DOUBLE THEN 'daily' WHEN fresh >= 0.7::DOUBLE THEN 'weekly'
    WHEN fresh >= 0.5::DOUBLE THEN 'monthly' ELSE 'yearly' END AS freq FROM s2),
s AS (SELECT *, eligible AND has_jsonld AND jsonld_quality >= 0.5::DOUBLE AND content_quality >= 0.5::DOUBLE AS citable FROM s3)"""
ENTRY = "project_id, page_id, url, substring(last_modified, 1, 10) AS lastmod, {p} AS priority, freq AS changefreq, coalesce(content_type, 'page') AS content_type"


def site_pages(spark, sf):
    return view(spark, sf, "site_pages")


@query("sitemap_freshness", "MAP-1", f"{MAP_SQL} SELECT page_id, fresh FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", M.freshness(c("last_modified"), AS_OF).alias("fresh"))


@query("sitemap_traffic_score", "MAP-2", f"{MAP_SQL} SELECT page_id, round(traffic, 9) AS traffic FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", F.round(M.traffic_score(c("monthly_traffic")), 9).alias("traffic"))


@query("sitemap_backlink_score", "MAP-3", f"{MAP_SQL} SELECT page_id, round(links, 9) AS links FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", F.round(M.backlink_score(c("backlinks")), 9).alias("links"))


@query("sitemap_seo_priority", "MAP-4", f"{MAP_SQL} SELECT page_id, seo FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", M.seo_priority(AS_OF).alias("seo"))


@query("sitemap_geo_priority", "MAP-5", f"{MAP_SQL} SELECT page_id, geo FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", M.geo_priority(AS_OF).alias("geo"))


@query("sitemap_citable", "MAP-6", f"{MAP_SQL} SELECT page_id, citable FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", M.is_citable(CFG).alias("citable"))


@query("sitemap_changefreq", "MAP-7", f"{MAP_SQL} SELECT page_id, freq FROM s")
def _(spark, sf):
    return site_pages(spark, sf).select("page_id", M.changefreq(AS_OF).alias("freq"))


@query("sitemap_exclusions", "MAP-8", f"{MAP_SQL} SELECT page_id FROM s WHERE eligible AND ct NOT IN ('job')")
def _(spark, sf):
    return M.apply_exclusions(site_pages(spark, sf), M.SitemapConfig(AS_OF, exclude_content_types=["job"])).select("page_id")


@query("sitemap_seo_list", "MAP-9", f"{MAP_SQL} SELECT {ENTRY.format(p='seo')} FROM s WHERE eligible")
def _(spark, sf):
    return M.seo_sitemap(site_pages(spark, sf), CFG)


@query("sitemap_geo_list", "MAP-10", f"""{MAP_SQL} SELECT {ENTRY.format(p='geo')}, has_jsonld, jsonld_quality FROM s WHERE citable
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY geo DESC, page_id) <= 5""")
def _(spark, sf):
    return M.geo_sitemap(site_pages(spark, sf), M.SitemapConfig(AS_OF, max_urls_geo=5))


@query("sitemap_stats", "MAP-11", f"""{MAP_SQL}, l AS (SELECT {ENTRY.format(p='seo')} FROM s WHERE eligible)
SELECT 'total' AS dimension, '' AS value, CAST(count(*) AS BIGINT) AS count, CAST(printf('%.3f', CAST(avg(priority) AS DOUBLE)) AS DOUBLE) AS avg_priority FROM l
UNION ALL SELECT 'content_type', content_type, count(*), NULL FROM l GROUP BY content_type UNION ALL SELECT 'changefreq', changefreq, count(*), NULL FROM l GROUP BY changefreq""")
def _(spark, sf):
    return M.sitemap_stats(M.seo_sitemap(site_pages(spark, sf), CFG))


@query("sitemap_recomputed", "MAP-12", f"""{MAP_SQL} SELECT page_id, CASE WHEN status = 'active' THEN seo END AS seo_priority, CASE WHEN status = 'active' THEN geo END AS geo_priority,
  CASE WHEN status = 'active' THEN citable END AS is_citable FROM s""")
def _(spark, sf):
    return M.recompute_priorities(site_pages(spark, sf), CFG).select("page_id", "seo_priority", "geo_priority", "is_citable")


@query("sitemap_listing", "MAP-13", f"""{MAP_SQL} SELECT page_id, seo AS seo_priority FROM s WHERE project_id = 2 AND status = 'active' AND citable ORDER BY seo DESC, page_id LIMIT 20""")
def _(spark, sf):
    rated = M.recompute_priorities(site_pages(spark, sf), CFG)
    return M.list_pages(rated, project_id=2, status="active", is_citable=True, limit=20).select("page_id", "seo_priority")


@query("sitemap_page_counts", "MAP-14", f"""{MAP_SQL} SELECT project_id, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT content_type) AS BIGINT) AS types,
  CAST(count(*) FILTER (has_jsonld) AS BIGINT) AS with_jsonld, CAST(count(*) FILTER (citable AND status = 'active') AS BIGINT) AS citable FROM s GROUP BY project_id""")
def _(spark, sf):
    return M.page_counts(M.recompute_priorities(site_pages(spark, sf), CFG))


@query("sitemap_content_types", "MAP-16", f"""{with_views('cluster_labels')} SELECT cluster_id, CASE schema_type WHEN 'JobPosting' THEN 'job' WHEN 'Product' THEN 'product' WHEN 'Article' THEN 'article'
  WHEN 'FAQPage' THEN 'faq' ELSE 'page' END AS content_type FROM cluster_labels""")
def _(spark, sf):
    return view(spark, sf, "cluster_labels").select("cluster_id", M.content_type_of(c("schema_type")).alias("content_type"))


MEMBERS = "SELECT 1 + page_id % 100 AS cluster_id, page_id, url FROM pages"
TYPES_CTE = f"""members AS ({MEMBERS}), typed AS (SELECT m.url, max_by(CASE schema_type WHEN 'JobPosting' THEN 'job' WHEN 'Product' THEN 'product' WHEN 'Article' THEN 'article' WHEN 'FAQPage' THEN 'faq' ELSE 'page' END, m.cluster_id) AS content_type,
  bool_or(cluster_id % 2 = 0) AS has_optimized FROM members m JOIN cluster_labels USING (cluster_id) GROUP BY m.url)"""


def clustered_types(spark, sf):
    members = table(spark, sf, "pages").select((F.lit(1) + c("page_id") % 100).alias("cluster_id"), "url")
    labels = view(spark, sf, "cluster_labels").withColumn("optimized", F.when(c("cluster_id") % 2 == 0, "{}"))
    return M.page_types(members, labels)


@query("sitemap_page_types", "MAP-17", f"{with_views('cluster_labels')}, {TYPES_CTE} SELECT * FROM typed")
def _(spark, sf):
    return clustered_types(spark, sf)


@query("sitemap_from_crawl", "SRC-3", f"""{FACTS}, cluster_labels AS ({with_views('cluster_labels').split(' AS (', 1)[1][:-1]}), {TYPES_CTE}
SELECT page_id, f.url, coalesce(content_type, 'page') AS content_type, has_structured_data AS has_jsonld,
  CASE WHEN has_optimized THEN 0.85::DOUBLE WHEN has_structured_data THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS jsonld_quality,
  CAST(printf('%.2f', CAST(least(1.0::DOUBLE, CASE WHEN title <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(description) > 50 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN h1 <> '' THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN h2_count >= 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN has_structured_data THEN 0.15::DOUBLE ELSE 0 END) AS DOUBLE)) AS DOUBLE) AS content_quality,
  CAST(0 AS BIGINT) AS monthly_traffic, CAST(0 AS BIGINT) AS backlinks, NULL::VARCHAR AS last_modified FROM facts f LEFT JOIN typed USING (url)""")
def _(spark, sf):
    return M.pages_to_sitemap(facts(spark, sf), clustered_types(spark, sf))


INCOMING = """SELECT project_id, CASE WHEN page_id % 10 = 0 THEN 'ftp://x' WHEN page_id % 4 = 0 THEN url ELSE ' ' || url || '/n' || CAST(page_id % 30 AS STRING) END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'GUIDE' ELSE content_type END AS content_type, has_jsonld, jsonld_quality * 3 - 1 AS jsonld_quality, content_quality * 2 AS content_quality,
  monthly_traffic - 3 AS monthly_traffic, backlinks, CASE WHEN page_id % 2 = 0 THEN '' ELSE last_modified END AS last_modified, page_id AS batch FROM site_pages"""
UPSERT = ["project_id", "url", "content_type", "has_jsonld", "jsonld_quality", "content_quality", "monthly_traffic", "backlinks", "last_modified", "status"]


@query("sitemap_upsert", "SRC-10", f"""{with_views('site_pages')}, i AS ({INCOMING}),
n AS (SELECT project_id, trim(url) AS url, lower(coalesce(content_type, 'page')) AS content_type, has_jsonld, greatest(0, least(1, jsonld_quality)) AS jsonld_quality,
  greatest(0, least(1, content_quality)) AS content_quality, greatest(0, monthly_traffic) AS monthly_traffic, backlinks, nullif(last_modified, '') AS last_modified, 'active' AS status
  FROM i WHERE trim(url) SIMILAR TO 'https?://.*' QUALIFY row_number() OVER (PARTITION BY project_id, trim(url) ORDER BY batch DESC) = 1)
SELECT * FROM n UNION ALL SELECT {', '.join('e.' + x for x in UPSERT)} FROM site_pages e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project_id = e.project_id AND n.url = e.url)""")
def _(spark, sf):
    existing = site_pages(spark, sf)
    existing.createOrReplaceTempView("site_pages")
    return M.upsert_pages(existing.drop("page_id"), spark.sql(INCOMING))


@query("sitemap_bulk_update", "MAP-18", f"""{with_views('site_pages')} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'paused' ELSE status END AS status,
  CASE WHEN page_id % 4 = 0 AND page_id % 8 = 0 THEN 'guide' ELSE content_type END AS content_type FROM site_pages""")
def _(spark, sf):
    p = site_pages(spark, sf)
    patch = p.filter("page_id % 4 = 0").select("page_id", F.lit("paused").alias("status"), F.when(c("page_id") % 8 == 0, "guide").alias("content_type"))
    return M.update_pages(p, patch).select("page_id", "status", "content_type")


@query("sitemap_delete_pages", "MAP-18", f"{with_views('site_pages')} SELECT page_id, project_id FROM site_pages WHERE page_id % 3 <> 0")
def _(spark, sf):
    p = site_pages(spark, sf)
    return M.delete_pages(p, p.filter("page_id % 3 = 0")).select("page_id", "project_id")


PROJECTS = """SELECT c_custkey AS project_id, c_mktsegment AS workspace, LOWER(c_name) || '@x.com' AS user_email, 'projet ' || CAST(c_custkey AS STRING) AS name, '' AS description,
  'site' || CAST(c_custkey AS STRING) || '.fr' AS domain, 500 AS max_urls_geo, '[]' AS exclude_content_types, CAST(0.5 AS DOUBLE) AS min_content_quality, CAST(0.5 AS DOUBLE) AS min_jsonld_quality,
  CAST(DATE '2024-01-01' + CAST(c_custkey % 90 AS INT) AS STRING) AS created_at FROM customer"""
GENERATIONS = """SELECT o_orderkey AS generation_id, o_custkey AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'seo' ELSE 'geo' END AS type, o_orderkey % 500 AS urls_count,
  CAST(o_orderdate AS STRING) AS generated_at, ' A@B.fr ' AS generated_by FROM orders"""
NEW_PROJECTS = """SELECT o_orderkey AS batch, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'BUILDING' END AS workspace, ' Z@Y.fr' AS user_email, 'projet ' || CAST(o_custkey % 40 AS STRING) AS name,
  CAST(NULL AS STRING) AS description, 'd.fr' AS domain, CAST(NULL AS INT) AS max_urls_geo, CAST(NULL AS STRING) AS exclude_content_types,
  CAST(NULL AS DOUBLE) AS min_content_quality, CAST(NULL AS DOUBLE) AS min_jsonld_quality FROM orders"""


def text_view(spark, sf, tables, text):
    for t in tables:
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(text)


def projects(spark, sf):
    return text_view(spark, sf, ["customer"], PROJECTS)


def generations(spark, sf):
    return text_view(spark, sf, ["orders"], GENERATIONS)


@query("sitemap_delete_projects", "MAP-18", f"""WITH p AS ({PROJECTS}), g AS ({GENERATIONS}), {with_views('site_pages')[5:]}
SELECT 'projects' AS tab, CAST(count(*) AS BIGINT) AS n FROM p WHERE project_id % 4 <> 0 UNION ALL SELECT 'pages', count(*) FROM site_pages WHERE project_id NOT IN (SELECT project_id FROM p WHERE project_id % 4 = 0)
UNION ALL SELECT 'generations', count(*) FROM g WHERE project_id NOT IN (SELECT project_id FROM p WHERE project_id % 4 = 0)""")
def _(spark, sf):
    p = projects(spark, sf)
    left = M.delete_projects(p, site_pages(spark, sf), generations(spark, sf), p.filter("project_id % 4 = 0"))
    named = [t.select(F.lit(n).alias("tab")) for n, t in zip(("projects", "pages", "generations"), left)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("tab").agg(F.count("*").alias("n"))


REGISTER = f"""WITH p AS ({PROJECTS}), i AS ({NEW_PROJECTS}), j AS (SELECT batch, CASE WHEN trim(workspace) = '' THEN 'Non classé' ELSE trim(workspace) END AS workspace, name, domain FROM i),
f AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.workspace = j.workspace AND p.name = j.name) QUALIFY row_number() OVER (PARTITION BY workspace, name ORDER BY batch) = 1)"""


@query("sitemap_register_projects", "MAP-19", f"""{REGISTER} SELECT project_id, workspace, user_email, name, max_urls_geo FROM p UNION ALL
SELECT (SELECT max(project_id) FROM p) + row_number() OVER (ORDER BY batch), workspace, 'z@y.fr', name, 500 FROM f""")
def _(spark, sf):
    new = text_view(spark, sf, ["orders"], NEW_PROJECTS)
    return M.register_projects(projects(spark, sf), new, AS_OF)[0].select("project_id", "workspace", "user_email", "name", "max_urls_geo")


@query("sitemap_rejected_projects", "MAP-19", f"{REGISTER} SELECT batch, workspace, name FROM j WHERE batch NOT IN (SELECT batch FROM f)")
def _(spark, sf):
    new = text_view(spark, sf, ["orders"], NEW_PROJECTS)
    return M.register_projects(projects(spark, sf), new, AS_OF)[1].select("batch", "workspace", "name")


@query("sitemap_project_list", "MAP-19", f"""WITH p AS ({PROJECTS}) SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'neuf' ELSE name END AS name, created_at FROM p WHERE workspace = 'BUILDING'""")
def _(spark, sf):
    p = projects(spark, sf)
    patch = p.filter("project_id % 2 = 0").select("project_id", F.lit("neuf").alias("name"), F.lit(None).cast("string").alias("domain"))
    return M.list_projects(M.update_projects(p, patch), " BUILDING ").select("project_id", "name", "created_at")


@query("sitemap_generations", "MAP-20", f"""WITH g AS ({GENERATIONS}) SELECT project_id, generation_id, generated_by, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY generated_at DESC, generation_id DESC) AS position FROM (
  SELECT generation_id, project_id, generated_at, ' A@B.fr ' AS generated_by FROM g WHERE generation_id % 9 <> 0 UNION ALL SELECT generation_id + 100000000, project_id, '2030-01-01', 'a@b.fr' FROM g WHERE generation_id % 50 = 0)) WHERE position <= 20""")
def _(spark, sf):
    g = generations(spark, sf)
    more = g.filter("generation_id % 50 = 0").withColumn("generation_id", c("generation_id") + 100000000).withColumn("generated_at", F.lit("2030-01-01"))
    kept = M.append_generations(M.delete_generations(g, g.filter("generation_id % 9 = 0")), more)
    return M.latest_generations(kept, 20).select("project_id", "generation_id", "generated_by", "position")


@query("sitemap_xml_rows", "SRC-6 SRC-7", f"""{MAP_SQL} SELECT url AS loc, substring(last_modified, 1, 10) AS lastmod, freq AS changefreq, printf('%.2f', seo) AS priority FROM s WHERE eligible""")
def _(spark, sf):
    return sitemap_rows(M.seo_sitemap(site_pages(spark, sf), CFG))


@query("sitemap_written", "SRC-6 SRC-7", f"""{MAP_SQL} SELECT page_id % 5 AS project_id, CAST(count(*) AS BIGINT) AS urls, md5(string_agg(url || ' ' || coalesce(substring(last_modified, 1, 10), '-'), '|' ORDER BY url || ' ' || coalesce(substring(last_modified, 1, 10), '-'))) AS digest, true AS index_is_whole
  FROM s WHERE eligible GROUP BY 1""")
def _(spark, sf):
    """Every project's sitemap files and its index are written and read back."""
    path = shared_folder(spark, "sitemaps")
    write_project_sitemaps(M.seo_sitemap(site_pages(spark, sf), CFG), f"{path}/maps")
    files = project_sitemap_index(spark, f"{path}/maps", "https://cdn.fr/")
    write_project_indexes(files, f"{path}/indexes")
    line = F.concat_ws(" ", "loc", F.coalesce("lastmod", F.lit("-")))
    back = read_sitemap(spark, f"{path}/maps", "project_id").groupBy("project_id").agg(
        F.count("*").alias("urls"), F.md5(F.array_join(F.array_sort(F.collect_list(line)), "|").cast("binary")).alias("digest"))
    named = read_index(spark, f"{path}/indexes", "project_id").select("project_id", c("loc").alias("url"))
    lost = files.join(named.withColumn("named", F.lit(1)), ["project_id", "url"], "full").groupBy("project_id").agg(F.count_if(c("named").isNull()).alias("lost"))
    return back.join(lost, "project_id").select(c("project_id").cast("long").alias("project_id"), "urls", "digest", (c("lost") == 0).alias("index_is_whole"))


# Uploaded page lists: one per project, with headers of their own; one lacks a column, one names it otherwise.
UPLOADS = """
SELECT 'list-' || CAST(project_id AS STRING) AS upload, page_id + 1 AS line_no, '"' || url || '?a,b"' ||
  CASE project_id WHEN 0 THEN ',' || COALESCE(content_type, '') || ',' || CAST(monthly_traffic AS STRING) WHEN 1 THEN ', yes ,' || COALESCE(content_type, '') || ',x' WHEN 2 THEN ',' || CAST(backlinks AS STRING) ELSE ',' || COALESCE(content_type, '') || ',,"a, b"' END AS line FROM site_pages
UNION ALL SELECT * FROM (VALUES ('list-0', 0, 'url,content_type,monthly_traffic'), ('list-1', 0, 'URL, has_jsonld , Content_Type ,backlinks'), ('list-2', 0, 'url,backlinks'), ('list-3', 0, 'url,content_type,last_modified,note'), ('list-4', 0, 'url,content_type'), ('list-5', 0, '')) AS h(upload, line_no, line)"""


def uploads(spark, sf):
    view(spark, sf, "site_pages").createOrReplaceTempView("site_pages")
    return parse_pages_csv(spark.sql(UPLOADS))


@query("csv_pages", "SRC-2", f"""{with_views('site_pages')} SELECT 'list-' || project_id AS upload, page_id + 1 AS line_no, url || '?a,b' AS url, content_type, CASE WHEN project_id = 1 THEN true END AS has_jsonld,
  CASE WHEN project_id = 0 THEN monthly_traffic END AS monthly_traffic, CAST(NULL AS BIGINT) AS backlinks, CAST(NULL AS VARCHAR) AS last_modified FROM site_pages WHERE project_id <> 2""")
def _(spark, sf):
    return uploads(spark, sf)[0].drop("jsonld_quality", "content_quality")


@query("csv_refused", "SRC-2", "SELECT * FROM (VALUES ('list-2', 'content_type'), ('list-5', 'url, content_type')) AS r(upload, missing) WHERE EXISTS (SELECT 1 FROM pages WHERE page_id % 5 = 2)")
def _(spark, sf):
    return uploads(spark, sf)[1]


# Fetched documents as text: an index per region, a sitemap per nation with its customers, one broken document.
FETCHED = """
SELECT 'https://r.fr/' || CAST(r_regionkey AS STRING) || '.xml' AS loc, '<sitemapindex>' || (CASE WHEN r_regionkey = 0 THEN '<sitemap><loc> https://r.fr/1.xml </loc></sitemap>' ELSE '' END) || n.maps || '</sitemapindex>' AS content
FROM region JOIN (SELECT n_regionkey, {join}('<sitemap><loc>https://n.fr/' || CAST(n_nationkey AS STRING) || '.xml</loc></sitemap>') AS maps FROM nation GROUP BY n_regionkey) n ON n_regionkey = r_regionkey
UNION ALL
SELECT 'https://n.fr/' || CAST(c_nationkey AS STRING) || '.xml', CASE WHEN c_nationkey = 3 THEN '<urlset><url>' ELSE '<?xml version="1.0"?><urlset>' || {join}('<url><loc> https://c.fr/' || CAST(c_custkey AS STRING) ||
  ' </loc>' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '<lastmod>2024-01-0' || CAST(c_custkey % 9 + 1 AS STRING) || '</lastmod>' END || '</url>') || '</urlset>' END FROM customer GROUP BY c_nationkey"""


def fetched(spark, sf):
    for t in ("region", "nation", "customer"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(FETCHED.format(join="listagg"))


LISTED = """SELECT 'https://n.fr/' || CAST(c_nationkey AS STRING) || '.xml' AS source, 'https://c.fr/' || CAST(c_custkey AS STRING) AS loc,
  CASE WHEN c_custkey % 3 <> 0 THEN '2024-01-0' || CAST(c_custkey % 9 + 1 AS STRING) END AS lastmod, c_nationkey FROM customer WHERE c_nationkey <> 3"""


@query("sitemap_fetched_entries", "SRC-4", f"SELECT source, loc, lastmod FROM ({LISTED})")
def _(spark, sf):
    return sitemap_entries(fetched(spark, sf))


@query("sitemap_index_expansion", "SRC-5", f"""WITH RECURSIVE below(root, r) AS (SELECT r_regionkey, r_regionkey FROM region UNION SELECT root, 1 FROM below WHERE r = 0)
SELECT 'https://r.fr/' || CAST(root AS STRING) || '.xml' AS root, source, loc, lastmod FROM (SELECT DISTINCT root, r FROM below) b JOIN nation ON n_regionkey = r JOIN ({LISTED}) l ON l.c_nationkey = n_nationkey""")
def _(spark, sf):
    docs = fetched(spark, sf)
    return expand_sitemap_index(docs, docs.select("loc").filter("loc like 'https://r.fr/%'"))


# ---------------------------------------------------------------- access

BOTS = "['gptbot', 'chatgpt-user', 'google-extended', 'claudebot', 'perplexitybot', 'applebot-extended']"
ROBOTS_SQL = f"""{with_views('robots')}, ln AS (SELECT site, lower(content) AS t, unnest(string_split(lower(content), chr(10))) AS line, generate_subscripts(string_split(lower(content), chr(10)), 1) AS i FROM robots),
ag AS (SELECT *, last_value(CASE WHEN starts_with(trim(line), 'user-agent:') THEN trim(substring(trim(line), 12)) END IGNORE NULLS) OVER (PARTITION BY site ORDER BY i) AS agent,
  trim(regexp_replace(trim(line), '^[^:]*:', '')) AS val FROM ln),
ev AS (SELECT *, starts_with(trim(line), 'disallow:') AND val = '/' AND agent = '*' AS everyone, starts_with(trim(line), 'disallow:') AND val = '/' AS deny, starts_with(trim(line), 'allow:') AND val = '/' AS grants FROM ag),
st AS (SELECT *, min(CASE WHEN everyone THEN i END) OVER (PARTITION BY site) AS stop FROM ev),
hit AS (SELECT site, any_value(t) AS t, max(stop) IS NOT NULL AS closed,
  coalesce(flatten(list(list_filter({BOTS}, lambda b: contains(agent, b)) ORDER BY i) FILTER (deny AND agent IS NOT NULL AND (stop IS NULL OR i < stop))), []) AS named,
  coalesce(flatten(list(list_filter({BOTS}, lambda b: contains(agent, b)) ORDER BY i) FILTER (grants AND agent IS NOT NULL AND (stop IS NULL OR i < stop))), []) AS allowed FROM st GROUP BY site),
acc AS (SELECT site, t, closed, allowed, CASE WHEN closed THEN {BOTS} ELSE named END AS blocked FROM hit),
robots_result AS (SELECT site, t <> '' AND len(blocked) = 0 AS accessible, CASE WHEN t = '' THEN 'Fichier absent' WHEN closed AND len(allowed) = 0 THEN 'Disallow: / global (tous les bots bloques)'
  WHEN len(blocked) > 0 THEN 'Bots IA bloques: ' || array_to_string(blocked, ', ') ELSE 'Aucun blocage detecte pour les crawlers IA' END AS details,
  CASE WHEN t = '' THEN '' ELSE array_to_string(blocked, {PIPE}) END AS blocked_bots, array_to_string(allowed, {PIPE}) AS allowed_bots FROM acc)"""


def robots_result(spark, sf):
    return access.robots_access(view(spark, sf, "robots"))


@query("robots_access", "ACC-1", f"{ROBOTS_SQL} SELECT site, accessible, details, blocked_bots, allowed_bots FROM robots_result")
def _(spark, sf):
    return robots_result(spark, sf).select("site", "accessible", "details", F.array_join("blocked_bots", "|").alias("blocked_bots"), F.array_join("allowed_bots", "|").alias("allowed_bots"))


FILES = """SELECT s_name AS site, 'robots.txt' AS name, s_suppkey % 6 <> 0 AS found, s_suppkey AS k FROM supplier UNION ALL SELECT s_name, 'sitemap.xml', s_suppkey % 2 = 0, s_suppkey FROM supplier
UNION ALL SELECT s_name, 'llms.txt', s_suppkey % 5 = 0, s_suppkey FROM supplier"""


@query("infra_scores", "ACC-2", f"""{FACTS}, o AS (SELECT 'Supplier#' || lpad(CAST(1 + page_id % 100 AS VARCHAR), 9, '0') AS site, bool_or(has_structured_data) AS jsonld FROM facts GROUP BY 1),
f AS ({FILES}), g AS (SELECT site, bool_or(found) FILTER (name = 'robots.txt') AS robots, bool_or(found) FILTER (name = 'sitemap.xml') AS sitemap, bool_or(found) FILTER (name = 'llms.txt') AS llms FROM f GROUP BY site)
SELECT site, coalesce(robots, false) AS robots, coalesce(sitemap, false) AS sitemap, coalesce(llms, false) AS llms, coalesce(jsonld, false) AS jsonld,
  25 * (coalesce(robots, false)::INT + coalesce(sitemap, false)::INT + coalesce(llms, false)::INT + coalesce(jsonld, false)::INT) AS score FROM g FULL JOIN o USING (site)""")
def _(spark, sf):
    site = F.concat(F.lit("Supplier#"), F.lpad((F.lit(1) + c("page_id") % 100).cast("string"), 9, "0"))
    p = facts(spark, sf).select(site.alias("site"), "has_structured_data")
    return access.infra_score(text_view(spark, sf, ["supplier"], FILES), p)


@query("access_summary", "ACC-3", f"""{ROBOTS_SQL}, k AS (SELECT s_name AS site, s_suppkey FROM supplier)
SELECT site, CASE WHEN accessible AND s_suppkey % 4 <> 0 THEN 'OUVERT' ELSE 'FERME' END AS site_accessible, s_suppkey % 3 = 0 AS api_detected,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'NON DETECTEE' WHEN (SELECT r.accessible FROM robots_result r JOIN k o ON o.site = r.site WHERE o.s_suppkey = k.s_suppkey // 2 + 1) THEN 'OUVERT' ELSE 'FERME' END AS api_accessible FROM robots_result JOIN k USING (site)""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(c("s_name").alias("site"), "s_suppkey")
    metas = s.select("site", (c("s_suppkey") % 4 != 0).alias("indexable"))
    # Every third site has two candidates; the one with the lower rank stands later in the alphabet for most.
    named = lambda key: F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0")).alias("candidate")
    mine = s.filter("s_suppkey % 3 = 0")
    near = mine.select("site", named(F.floor(c("s_suppkey") / 2) + 1), F.lit(0).alias("rank"))
    far = mine.select("site", named(F.lit(1)), F.lit(3).alias("rank"))
    apis = near.unionByName(far)
    return access.access_summary(robots_result(spark, sf), metas, apis)


# ---------------------------------------------------------------- authority

KG = with_views("kg_entities")


@query("authority_kg", "AUTH-1", f"""{KG} SELECT entity_id, CAST(least(100, 2 * 2 + CASE WHEN entity_id % 3 = 0 THEN 20 ELSE 0 END + 5 * 2 + 2 * 1) AS BIGINT) AS score FROM kg_entities""")
def _(spark, sf):
    return authority.kg_pillar(kg_features(view(spark, sf, "kg_entities"))).select("entity_id", c("score").cast("long").alias("score"))


DOC_PAGES = "SELECT doc_id AS page_id, 'site' || CAST(doc_id % 25 AS STRING) AS site, original AS block FROM jsonld_docs"
FOOT_SQL = f"""{with_views('jsonld_docs')}, b AS ({DOC_PAGES}), t AS (SELECT *, block <> '{{broken' AS ok, page_id % 4 AS k FROM b),
ty AS (SELECT DISTINCT site, unnest(CASE k WHEN 0 THEN ['Product'] WHEN 1 THEN ['Product', 'Article'] WHEN 2 THEN ['Organization', 'WebPage'] ELSE ['Event'] END) AS type FROM t WHERE ok),
foot AS (SELECT site, CAST(count(*) AS BIGINT) AS pages_analyzed, CAST(count(*) FILTER (ok) AS BIGINT) AS pages_with_jsonld, CAST(coalesce(sum(CASE WHEN ok AND k = 2 THEN 2 ELSE 0 END), 0) AS BIGINT) AS same_as_count,
  bool_or(ok AND k = 2) AS has_organization, CAST(printf('%.1f', CAST(count(*) FILTER (ok) / count(*)::DOUBLE * 100 AS DOUBLE)) AS DOUBLE) AS jsonld_percentage FROM t GROUP BY site),
names AS (SELECT site, CAST(count(*) AS BIGINT) AS nb_types, string_agg(type, '|' ORDER BY type) AS schema_types FROM ty GROUP BY site)"""


def footprint(spark, sf):
    view(spark, sf, "jsonld_docs").createOrReplaceTempView("jsonld_docs")
    b = spark.sql(DOC_PAGES)
    good = b.filter(F.try_parse_json("block").isNotNull()).select("page_id", F.lit(0).alias("pos"), "block")
    return structured_footprint(b.select("site", "page_id"), good)


@query("structured_footprint", "LD-6", f"{FOOT_SQL} SELECT site, pages_analyzed, pages_with_jsonld, same_as_count, has_organization, jsonld_percentage, nb_types, schema_types FROM foot JOIN names USING (site)")
def _(spark, sf):
    return footprint(spark, sf).withColumn("schema_types", F.array_join("schema_types", "|"))


SD_SCORE = "least(100, 2 * pages_with_jsonld + 8 * nb_types + CASE WHEN has_organization THEN 40 ELSE 0 END + CASE WHEN same_as_count > 0 THEN 10 ELSE 0 END)"


@query("authority_structured_data", "AUTH-2", f"{FOOT_SQL} SELECT site, CAST({SD_SCORE} AS BIGINT) AS score FROM foot JOIN names USING (site)")
def _(spark, sf):
    return authority.sd_pillar(footprint(spark, sf)).select("site", c("score").cast("long").alias("score"))


CIT = "SELECT s_name AS site, CAST(s_suppkey % 7 AS INT) AS refs, CAST(10 * (s_suppkey % 5) AS INT) AS trust, CAST(s_suppkey % 6 AS INT) AS platforms FROM supplier"


@query("authority_citation", "AUTH-3", f"SELECT site, CAST(least(40, 10 * refs) + least(40, trust) + least(20, 5 * platforms) AS INTEGER) AS score FROM ({CIT})")
def _(spark, sf):
    return text_view(spark, sf, ["supplier"], CIT).select("site", authority.citation_score(c("refs"), c("trust"), c("platforms")).alias("score"))


def sim_sql(s: str) -> str:
    return (f"CASE WHEN {s} <= 0.3::DOUBLE THEN {s} / 0.3::DOUBLE * 40 WHEN {s} <= 0.6::DOUBLE THEN 40 + ({s} - 0.3::DOUBLE) / 0.3::DOUBLE * 30 "
            f"WHEN {s} <= 0.85::DOUBLE THEN 70 + ({s} - 0.6::DOUBLE) / 0.25::DOUBLE * 20 ELSE 90 + ({s} - 0.85::DOUBLE) / 0.15::DOUBLE * 10 END")


@query("similarity_scores", "AUTH-4", f"SELECT vec_id, round({sim_sql('s')}, 6) AS score FROM (SELECT vec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / len(embedding) * 5)) AS s FROM embeddings)")
def _(spark, sf):
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) / F.size("embedding") * 5
    return table(spark, sf, "embeddings").select("vec_id", F.round(authority.similarity_to_score(s), 6).alias("score"))


@query("authority_semantic_vector", "AUTH-5", f"""WITH parts AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x::DOUBLE) AS mx FROM parts GROUP BY label, i),
d AS (SELECT p.vec_id, sum(mx * x::DOUBLE) / (sqrt(sum(mx * mx)) * sqrt(sum(x::DOUBLE * x::DOUBLE))) AS s FROM parts p JOIN m USING (label, i) GROUP BY p.vec_id)
SELECT vec_id, CAST(printf('%.4f', CAST(s AS DOUBLE)) AS DOUBLE) AS similarity, CAST(printf('%.1f', CAST({sim_sql('greatest(0.0::DOUBLE, s)')} AS DOUBLE)) AS DOUBLE) AS score FROM d""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    means = authority.mean_vectors(e, "label", "embedding").withColumnRenamed("embedding", "site_vec")
    return authority.semantic_pillar_vec(e.join(means, "label"), "site_vec", "embedding").select("vec_id", "similarity", "score")


TARGET = "'the of and ' || source || ' mission services la de le ' || lang"


@query("authority_semantic_lexical", "AUTH-6", f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower({TARGET}), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM documents)
SELECT doc_id, CAST(printf('%.4f', CAST(len(list_intersect(a, b))::DOUBLE / len(b) AS DOUBLE)) AS DOUBLE) AS similarity, CAST(printf('%.1f', CAST(len(list_intersect(a, b))::DOUBLE / len(b) * 100 AS DOUBLE)) AS DOUBLE) AS score FROM t""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", authority.lexical_overlap(c("text"), F.expr(TARGET)).alias("o")).select("doc_id", "o.*")


@query("authority_site_text", "AUTH-7", f"""WITH p AS (SELECT page_id, {S.host('url')} AS site, url, html FROM pages QUALIFY row_number() OVER (PARTITION BY {S.host('url')} ORDER BY page_id) <= 3),
t AS (SELECT page_id, url, text FROM ({S.visible_staged('p')})),
j AS (SELECT {S.host('url')} AS site, string_agg(text, ' ' ORDER BY page_id) AS text FROM t WHERE text <> '' GROUP BY 1)
SELECT site, md5(text) AS digest, CAST({S.rcount('text', authority.WORD)} AS BIGINT) AS site_tokens FROM j""")
def _(spark, sf):
    return authority.site_text(table(spark, sf, "pages"), 3).select("site", F.md5("text").alias("digest"), "site_tokens")


FRESH_SQL = f"""{with_views('sitemap_dates')}, d AS (SELECT site, ord, try_strptime(lastmod, '%Y-%m-%d') AS d FROM sitemap_dates),
k AS (SELECT * FROM d WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 50),
fr AS (SELECT site, CAST(count(*) AS BIGINT) AS pages_with_dates, avg(CASE WHEN d < TIMESTAMP '{AS_OF}' THEN date_diff('day', d, TIMESTAMP '{AS_OF}') END) AS a, max(d) AS l FROM k GROUP BY site)"""


@query("authority_freshness", "AUTH-8", f"""{FRESH_SQL} SELECT site, pages_with_dates, CAST(printf('%.1f', CAST(a AS DOUBLE)) AS DOUBLE) AS avg_age_days, strftime(l, '%Y-%m-%d') AS last_publication, CAST(printf('%.1f', CAST(greatest(0, least(100, 100 - a / 10)) AS DOUBLE)) AS DOUBLE) AS score FROM fr""")
def _(spark, sf):
    return authority.freshness_pillar(view(spark, sf, "sitemap_dates"), AS_OF)


PILLAR_ROWS = """SELECT c_name AS entity, c_mktsegment AS grp, CAST(c_custkey * 7 % 101 AS DOUBLE) AS kg, CAST(c_custkey * 13 % 101 AS DOUBLE) AS sd, CAST(c_custkey * 3 % 101 AS DOUBLE) AS ca,
  CAST(c_custkey * 29 % 101 AS DOUBLE) AS sc, CAST(c_custkey * 17 % 101 AS DOUBLE) AS cf, c_custkey AS k FROM customer"""
INDEX_SQL = f"""WITH r AS ({PILLAR_ROWS}), idx AS (SELECT entity, grp, kg, CASE WHEN k % 5 = 0 THEN 0 ELSE sd END AS sd, ca, sc, CASE WHEN k % 3 = 0 THEN 0 ELSE cf END AS cf FROM r),
tot AS (SELECT *, CAST(printf('%.1f', kg * 0.3::DOUBLE + sd * 0.25::DOUBLE + ca * 0.2::DOUBLE + sc * 0.15::DOUBLE + cf * 0.1::DOUBLE) AS DOUBLE)::DOUBLE AS overall_score FROM idx)"""


def index(spark, sf):
    r = text_view(spark, sf, ["customer"], PILLAR_ROWS)
    of = lambda name, where="true": r.filter(where).select("entity", c(name).alias("score"))
    return authority.authority_index(r.select("entity", "grp"), {
        "knowledge_graph": of("kg"), "structured_data": of("sd", "k % 5 <> 0"), "citation_authority": of("ca"),
        "semantic_completeness": of("sc"), "content_freshness": of("cf", "k % 3 <> 0")})


@query("authority_index", "AUTH-9", f"""{INDEX_SQL} SELECT entity, overall_score, CASE WHEN overall_score >= 80 THEN {S.q(authority.BANDS[0][1])} WHEN overall_score >= 60 THEN {S.q(authority.BANDS[1][1])}
  WHEN overall_score >= 40 THEN {S.q(authority.BANDS[2][1])} ELSE {S.q(authority.BANDS[3][1])} END AS interpretation FROM tot""")
def _(spark, sf):
    return index(spark, sf).select("entity", "overall_score", "interpretation")


@query("authority_recommendations", "AUTH-10", f"""{INDEX_SQL}, u AS (SELECT entity, unnest([kg, sd, ca, sc, cf]) AS score, unnest([0, 1, 2, 3, 4]) AS no FROM tot),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY score, no) AS INTEGER) AS rank FROM u)
SELECT entity, rank, score, {S.list_of([n for _, _, n in authority.PILLARS])}[no + 1] AS pillar,
  CASE no WHEN 0 THEN CASE WHEN score = 0 THEN replace({S.q(authority.RECO_TEXTS['kg_create'])}, '{{entity}}', entity) ELSE {S.q(authority.RECO_TEXTS['kg_enrich'])} END
    WHEN 1 THEN CASE WHEN score < 30 THEN {S.q(authority.RECO_TEXTS['sd_create'])} ELSE {S.q(authority.RECO_TEXTS['sd_extend'])} END
    WHEN 2 THEN {S.q(authority.RECO_TEXTS['citation'])} WHEN 3 THEN {S.q(authority.RECO_TEXTS['semantic'])} ELSE {S.q(authority.RECO_TEXTS['freshness'])} END AS advice
FROM w WHERE rank <= 3 AND score < 80""")
def _(spark, sf):
    return authority.authority_recos(index(spark, sf))


@query("authority_ranking", "AUTH-11", f"{INDEX_SQL} SELECT entity, grp, overall_score, CAST(rank() OVER (PARTITION BY grp ORDER BY overall_score DESC) AS BIGINT) AS rank FROM tot")
def _(spark, sf):
    return authority.rank_entities(index(spark, sf), "grp").select("entity", "grp", "overall_score", "rank")




@query("authority_citation_pages", "AUTH-3 HTML-21 HTML-22", f"""{FACTS}, hay AS (SELECT page_id, site, clean, {S.hrefs('clean')} AS h FROM tagged),
x AS (SELECT page_id, lower({S.decode(S.rr('clean', S.TAG))} || chr(1) || array_to_string(h, ' ')) AS t, lower(array_to_string(h, ' ')) AS l FROM hay)
SELECT page_id, CAST(least(100, least(40, 10 * (page_id % 3)) + 10 * ({S.any_in('t', ['mentions', 'legal', 'légal', 'confidentialité', 'privacy', 'terms', 'conditions', 'cgv', 'cgu'])}::INT
  + {S.any_in('t', ['contact', 'about', 'propos'])}::INT + ({S.rm('t', authority.H.EMAIL)})::INT + ({S.rm('t', authority.H.PHONE)})::INT)
  + least(20, 5 * (contains(l, 'linkedin')::INT + contains(l, 'twitter')::INT + contains(l, 'facebook')::INT + contains(l, 'youtube')::INT + contains(l, 'instagram')::INT))) AS BIGINT) AS score FROM x""")
def _(spark, sf):
    homes = rich(spark, sf).select(c("page_id").alias("site"), "html")
    refs = table(spark, sf, "pages").select(c("page_id").alias("site"), (c("page_id") % 3).alias("references"))
    return authority.citation_pillar(homes, refs).select(c("site").alias("page_id"), c("score").cast("long").alias("score"))
