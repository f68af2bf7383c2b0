"""Registry, table access and the derived views both engines build from the same text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SURVEY: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"


def query(name: str, ids: str, sql: str | None = None):
    """Register a query, the survey items it covers and its reference SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name], SURVEY[name] = fn, ids
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEWS: dict[str, tuple[list[str], str]] = {
    "site_pages": (["pages", "events"], """
SELECT p.page_id, p.page_id % 5 AS project_id, p.url,
  CASE p.page_id % 16 WHEN 0 THEN 'guide' WHEN 1 THEN 'article' WHEN 2 THEN 'product' WHEN 3 THEN 'category'
    WHEN 4 THEN 'service' WHEN 5 THEN 'landing' WHEN 6 THEN 'page' WHEN 7 THEN 'faq' WHEN 8 THEN 'blog'
    WHEN 9 THEN 'news' WHEN 10 THEN 'event' WHEN 11 THEN 'job' WHEN 12 THEN 'legal' WHEN 13 THEN 'login'
    WHEN 14 THEN NULL ELSE 'other' END AS content_type,
  p.page_id % 3 <> 0 AS has_jsonld,
  CAST((p.page_id * 37) % 101 AS DOUBLE) / 100 AS jsonld_quality,
  CAST((p.page_id * 53) % 101 AS DOUBLE) / 100 AS content_quality,
  CAST(COALESCE(v.views, 0) AS BIGINT) AS monthly_traffic, CAST(COALESCE(v.clicks, 0) AS BIGINT) AS backlinks,
  CASE WHEN p.page_id % 7 = 0 THEN NULL
    ELSE CAST(DATE '2024-01-31' - CAST((p.page_id * 11) % 500 AS INT) AS STRING) END AS last_modified,
  CASE WHEN p.page_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status
FROM pages p LEFT JOIN (
  SELECT user_id, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views,
         SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks
  FROM events GROUP BY user_id) v ON v.user_id = p.page_id"""),
    "jsonld_docs": (["part"], """
SELECT p_partkey AS doc_id,
  CASE WHEN p_partkey % 10 = 9 THEN '{broken' ELSE
  '{"@context":"https://schema.org"' ||
  CASE p_partkey % 4 WHEN 0 THEN ',"@type":"Product"' WHEN 1 THEN ',"@type":["Product","Article"]'
    WHEN 2 THEN ',"@graph":[{"@type":"Organization","sameAs":["https://x.com/a","https://youtube.com/b"]},{"@type":"WebPage"}]'
    ELSE ',"@type":"Event"' END ||
  ',"name":"' || p_brand || '"' ||
  CASE WHEN p_size % 2 = 0 THEN ',"offers":{"price":' || CAST(p_size AS STRING) || ',"priceCurrency":"EUR"}' ELSE '' END ||
  CASE WHEN p_size % 3 = 0 THEN ',"startDate":"soon"' ELSE '' END || '}' END AS original,
  '{"@context":"https://schema.org","@type":"Product","name":"' || p_brand || '","sku":"' || CAST(p_partkey AS STRING) ||
  '","offers":{"price":' || CAST(p_size AS STRING) || ',"priceCurrency":"USD"}}' AS optimized
FROM part"""),
    "robots": (["supplier"], """
SELECT s_name AS site, CASE s_suppkey % 6
  WHEN 0 THEN '' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /'
  WHEN 2 THEN 'User-agent: GPTBot' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: ClaudeBot' || chr(10) || 'Allow: /'
  WHEN 3 THEN 'User-agent: *' || chr(10) || 'Disallow: /admin/'
  WHEN 4 THEN 'User-agent: ClaudeBot' || chr(10) || 'Allow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /'
  ELSE 'User-agent: A' || chr(10) || 'User-agent: PerplexityBot' || chr(10) || 'Disallow: /' END AS content FROM supplier"""),
    "saves": (["orders", "customer"], """
SELECT CAST(o.o_orderkey AS STRING) AS save_id,
  ' ' || UPPER(c.c_name) || '@X.COM ' AS user_email,
  CASE WHEN o.o_orderkey % 11 = 0 THEN '' ELSE c.c_mktsegment END AS workspace,
  'https://site' || CAST(o.o_custkey % 50 AS STRING) || '.example.com' AS site_url,
  SUBSTRING(CAST(o.o_orderdate AS STRING), 1, 16) AS created_at,
  CASE WHEN o.o_orderkey % 2 = 0 THEN '{}' ELSE ' ' END AS geo_data,
  CASE WHEN o.o_orderkey % 3 = 0 THEN '[]' ELSE NULL END AS jsonld_data,
  CASE WHEN o.o_orderkey % 5 = 0 THEN '{}' ELSE '' END AS master_json
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""),
    "access": (["customer"], """
SELECT LOWER(c_name) || '@x.com' AS user_email, c_mktsegment AS workspace_name FROM customer WHERE c_custkey % 3 = 0"""),
    "mentions": (["documents"], """
SELECT doc_id AS mention_id, 'brand' || CAST(doc_id % 20 AS STRING) AS brand, source AS domain_key,
  SUBSTRING(text, 1, 60) AS title, SUBSTRING(text, 61) AS descr,
  'https://' || source || '.example.com/' || CAST(doc_id AS STRING) AS url FROM documents"""),
    "predictions": (["lineitem"], """
SELECT l_orderkey AS entity_id, l_linenumber AS pos, 'DYN_FIELD_' || CAST(l_linenumber % 4 AS STRING) AS key,
  CASE WHEN l_quantity > 45 THEN '' ELSE CAST(l_partkey AS STRING) END AS value, l_discount * 10 AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'keep' WHEN 'N' THEN 'hesitant' ELSE 'reject' END AS decision FROM lineitem"""),
    "model_responses": (["conversations"], """
SELECT conv_id, turn, said, CASE (conv_id + turn) % 4
  WHEN 0 THEN '```json' || chr(10) || '{"model_name":"' || said || '","schema_type":"Product"}' || chr(10) || '```'
  WHEN 1 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","name":"' || said || '"}</script>'
  WHEN 2 THEN said || ': {"a":"' || said || '"} ' || said ELSE role || said END AS content
FROM (SELECT *, ' ' || TRANSLATE(text, '"{}[]<>`' || chr(92) || chr(10) || chr(13) || chr(9), '') || '.' AS said FROM conversations) c"""),
    "kg_entities": (["nation"], """
SELECT n_nationkey AS entity_id, 'Q' || CAST(n_nationkey AS STRING) AS qid,
  '{"labels":{' || CASE WHEN n_nationkey % 2 = 0 THEN '"fr":{"value":"' || n_name || '"},' ELSE '' END || '"en":{"value":"' || LOWER(n_name) ||
  '"}},"claims":{"P856":[{"mainsnak":{"datatype":"url","datavalue":{"value":"https://' || LOWER(REPLACE(n_name, ' ', '-')) ||
  '.example.fr"}},"references":[{},{}]}],"P1278":[{"mainsnak":{"datatype":"external-id","datavalue":{"value":"LEI' ||
  CAST(n_nationkey AS STRING) || '"}}}]},"sitelinks":{' || CASE WHEN n_nationkey % 3 = 0 THEN '"frwiki":{"title":"' || n_name || '"}' ELSE '' END || '}}' AS doc FROM nation"""),
    "sitemap_dates": (["orders"], """
SELECT 'site' || CAST(o_custkey % 50 AS STRING) AS site, o_orderkey AS ord,
  SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) AS lastmod FROM orders"""),
    "cluster_labels": (["supplier"], """
SELECT s_suppkey AS cluster_id, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' Model ' || CAST(s_suppkey % 30 AS STRING) END AS model_name,
  CASE s_nationkey % 5 WHEN 0 THEN 'JobPosting' WHEN 1 THEN 'Product' WHEN 2 THEN 'Article' WHEN 3 THEN 'FAQPage' ELSE 'WebPage' END AS schema_type FROM supplier"""),
    # Pages given the elements the raw ones lack: metas, headings, lists, forms, links of every kind, JSON-LD.
    "rich_pages": (["pages"], """
SELECT page_id, url,
  REPLACE(html, '<meta charset="utf-8">', '<meta charset="utf-8">' ||
    CASE page_id % 4 WHEN 0 THEN '<meta name="description" content="D&eacute;couvrez ' || REPEAT('mot' || CAST(page_id AS STRING) || ' ', CAST(page_id % 40 AS INT)) || '">'
      WHEN 1 THEN '<meta content="' || REPEAT('guide pour le site ', CAST(page_id % 11 AS INT)) || '" name="description">'
      WHEN 2 THEN '<meta name="description" content="Une page &amp; ses liens">' ELSE '' END ||
    CASE page_id % 5 WHEN 0 THEN '<meta name="robots" content="NOINDEX, follow">' WHEN 1 THEN '<meta content="index,nofollow" name="robots">' ELSE '' END ||
    CASE WHEN page_id % 7 = 0 THEN '<meta name="gptbot" content="noindex">' ELSE '' END ||
    CASE page_id % 6 WHEN 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"Org","sameAs":["https://x.com/o"]}</script><script type="application/ld+json">{"@type":["FAQPage","WebPage"]}</script>'
      WHEN 1 THEN '<script type="application/ld+json">{"@type":"Article","author":{"@type":"Person","sameAs":"https://x.com/p"}}</script><script type="application/ld+json">{broken</script>'
      WHEN 2 THEN '<script async type="application/ld+json"> {"@graph":[{"@type":"Product"},{"@type":"Article"}]} </script>' ELSE '' END ||
    CASE WHEN page_id % 9 = 0 THEN '<script type="module" src="/_nuxt/entry.js"></script><link rel="modulepreload" href="/_nuxt/a.js">' ELSE '' END)
  || '<section>' || REPEAT('<h2>Titre <b>deux</b></h2><ul><li>un</li><li>deux <i>x</i></li></ul>', CAST(page_id % 5 AS INT)) || '</section>'
  || CASE WHEN page_id % 8 = 0 THEN '<table><tr><td>1</td></tr></table><form action="/s"><input type="submit"><button>ok</button></form>' ELSE '' END
  || REPEAT('<strong>fort</strong>', CAST(page_id % 7 AS INT))
  || CASE WHEN page_id % 10 = 0 THEN '<dl><dt>a</dt><dd>b</dd></dl><nav aria-label="Breadcrumb"><a href="/">home</a></nav>' ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN '<p>M. Dupont de Paris a vu 45% de clients le 12/03/2024, puis Acme Corp a Berlin.</p>' WHEN 1 THEN '<p>12 millions de personnes</p>' ELSE '' END
  || '<a href="../rel/./page' || CAST(page_id % 20 AS STRING) || '?a=1#t">rel</a><a class="x" href=''/doc.PDF''>pdf</a><a href="mailto:a@b.fr">mail</a>'
  || '<a href="https://ext' || CAST(page_id % 4 AS STRING) || '.example.com/p">ext</a><a href="//cdn.example.com/y">cdn</a><a href="?q=1">q</a><a href="#top">top</a>'
  || CASE WHEN page_id % 4 = 0 THEN '<a href="https://www.linkedin.com/company/a">in</a><a href="https://youtube.com/b?x=1&amp;y=2">yt</a><a href="/mentions-legales">Mentions</a>' ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN '<a href="/contact">Contact</a><p>Tel : 01 23 45 67 89</p>' ELSE '' END
  || CASE WHEN page_id % 6 = 0 THEN '<div data-href="/spa/' || CAST(page_id AS STRING) || '">x</div><span data-href="#no">n</span><img src="/i.png" alt="une image"><img src="/j.png">' ELSE '' END
  || CASE WHEN page_id % 11 = 0 THEN '<script>fetch("https://api.example.com/v1"); var u="https://cdn.' || REGEXP_EXTRACT(url, '//(?:www[.])?([^/]*)', 1) || '/x";</script>' ELSE '' END
  AS html
FROM pages"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, built by Spark from the view's text."""
    tables, text = VIEWS[name]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def with_views(*names: str) -> str:
    """Opening of a SQL text that needs derived views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
