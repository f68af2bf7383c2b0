"""JSON-LD: extraction, types, validation, diff, organisation data, builders and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.operators import jsonld as J
from corpusaudit.operators.entity import with_master_defaults

from . import sqlfn as S
from .base import AS_OF, query, table, view, with_views
from .pages import FACTS, rich

c = F.col
PIPE = "'|'"
DOCS = with_views("jsonld_docs")
# The documents by hand: what each kind of part yields.
KIND = f"""{DOCS}, k AS (SELECT d.doc_id, d.original, d.optimized, p_partkey % 10 = 9 AS broken, p_partkey % 4 AS kind, p_size % 2 = 0 AS offers, p_size % 3 = 0 AS dated, p_brand, p_size
  FROM jsonld_docs d JOIN part ON p_partkey = d.doc_id)"""


def docs(spark, sf):
    return view(spark, sf, "jsonld_docs")


@query("jsonld_blocks", "LD-1", f"""{FACTS}, b AS (SELECT page_id, unnest({S.rall('html', '''(?is)<script\\b[^>]*\\btype\\s*=\\s*["']?[^"'>]*ld\\+json[^>]*>(.*?)</script''', 1)}) AS block FROM cleaned)
SELECT page_id, trim(block) AS block FROM b WHERE json_valid(block)""")
def _(spark, sf):
    return J.jsonld_blocks(rich(spark, sf)).select("page_id", "block")


@query("jsonld_blocks_distinct", "LD-2", f"""{FACTS} SELECT page_id, CAST(n AS BIGINT) AS blocks FROM (SELECT page_id, len(list_distinct(json_ld)) AS n FROM tagged) WHERE n > 0""")
def _(spark, sf):
    b = J.jsonld_blocks(rich(spark, sf))
    twice = b.unionByName(b.withColumn("pos", c("pos") + 100))
    return J.dedupe_blocks(twice).groupBy("page_id").agg(F.count("*").alias("blocks"))


TYPE_LIST = "CASE kind WHEN 0 THEN ['Product'] WHEN 1 THEN ['Product', 'Article'] WHEN 2 THEN ['Organization', 'WebPage'] ELSE ['Event'] END"


@query("jsonld_types", "LD-3", f"{KIND} SELECT doc_id, unnest({TYPE_LIST}) AS type FROM k WHERE NOT broken")
def _(spark, sf):
    return J.schema_types(docs(spark, sf), "doc_id", "original")


@query("jsonld_same_as", "LD-4", f"{KIND} SELECT doc_id, CAST(CASE WHEN NOT broken AND kind = 2 THEN 2 ELSE 0 END AS INTEGER) AS same_as FROM k")
def _(spark, sf):
    return J.with_same_as(docs(spark, sf), "original").select("doc_id", "same_as")


@query("jsonld_schema_hits", "LD-5", f"""{DOCS} SELECT doc_id, CASE WHEN contains(original, '@type') THEN array_to_string(list_filter({S.list_of(J.KNOWN_TYPES)}, lambda t: contains(original, t)), {PIPE}) ELSE '' END AS hits FROM jsonld_docs""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(J.schema_hits(c("original")), "|").alias("hits"))


VALID_SQL = f"""{KIND}, e AS (SELECT doc_id, CASE WHEN broken THEN ['JSON-LD vide ou invalide'] ELSE list_filter([
  CASE WHEN kind = 2 THEN 'Champ @type manquant' END, CASE WHEN kind IN (0, 1) AND NOT offers THEN 'Champ obligatoire manquant : offers' END,
  CASE WHEN kind = 3 AND NOT dated THEN 'Champ obligatoire manquant : startDate' END, CASE WHEN kind = 3 THEN 'Champ obligatoire manquant : location' END], lambda x: x IS NOT NULL) END AS errors,
  CASE WHEN NOT broken AND dated THEN ['Format de date suspect dans startDate : soon (attendu YYYY-MM-DD)'] ELSE [] END AS warnings, broken FROM k)"""


@query("jsonld_validation", "LD-7", f"""{VALID_SQL} SELECT doc_id, len(errors) = 0 AS valid, array_to_string(errors, {PIPE}) AS errors, array_to_string(warnings, {PIPE}) AS warnings,
  CASE WHEN broken THEN ' JSON-LD invalide' WHEN len(errors) > 0 THEN ' JSON-LD invalide : ' || len(errors) || ' erreur(s)' WHEN len(warnings) > 0 THEN ' JSON-LD valide avec ' || len(warnings) || ' warning(s)'
  ELSE ' JSON-LD valide sans erreur ni warning' END AS message FROM e""")
def _(spark, sf):
    v = J.validate_jsonld(docs(spark, sf), "doc_id", "original")
    return v.select("doc_id", "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "message")


QUALITY_DOC = "CASE doc_id % 5 WHEN 0 THEN original WHEN 1 THEN '[1]' WHEN 2 THEN '{\"a\":1,\"b\":\"\",\"c\":[]}' WHEN 3 THEN '\"texte\"' ELSE '[]' END"


@query("jsonld_quality", "LD-8", f"""{KIND} SELECT doc_id, greatest(CASE WHEN doc_id % 5 = 0 THEN CASE WHEN broken THEN 0.0 ELSE 1.0 END WHEN doc_id % 5 = 1 THEN 0.6 WHEN doc_id % 5 = 2 THEN 0.33 WHEN doc_id % 5 = 3 THEN 0.4 ELSE 0.0 END::DOUBLE,
  CASE WHEN doc_id % 7 = 0 THEN 0.85 ELSE 0.0 END::DOUBLE) AS quality FROM k""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", J.jsonld_quality(F.expr(QUALITY_DOC), c("doc_id") % 7 == 0).alias("quality"))


@query("jsonld_block_labels", "LD-9", f"""{KIND} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN broken THEN 'N/A' WHEN kind = 0 THEN 'Product' WHEN kind = 1 THEN '["Product","Article"]' WHEN kind = 2 THEN 'Unknown' ELSE 'Event' END
  WHEN 1 THEN 'Array[1]' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'N/A' ELSE 'Array[0]' END AS label FROM k""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", J.block_label(F.expr(QUALITY_DOC)).alias("label"))


# One row per field of both documents, from what each kind of part holds.
DIFF_SQL = f"""{KIND}, f AS (SELECT doc_id, '@context' AS path, CASE WHEN broken THEN 'added' ELSE 'same' END AS status FROM k
UNION ALL SELECT doc_id, '@type', CASE WHEN broken OR kind = 2 THEN 'added' WHEN kind = 0 THEN 'same' ELSE 'enriched' END FROM k
UNION ALL SELECT doc_id, 'name', CASE WHEN broken THEN 'added' ELSE 'same' END FROM k
UNION ALL SELECT doc_id, 'sku', 'added' FROM k
UNION ALL SELECT doc_id, '@graph', 'removed' FROM k WHERE NOT broken AND kind = 2
UNION ALL SELECT doc_id, 'startDate', 'removed' FROM k WHERE NOT broken AND dated
UNION ALL SELECT doc_id, 'offers', 'added' FROM k WHERE broken OR NOT offers
UNION ALL SELECT doc_id, 'offers.price', 'same' FROM k WHERE NOT broken AND offers
UNION ALL SELECT doc_id, 'offers.priceCurrency', 'enriched' FROM k WHERE NOT broken AND offers)"""


@query("jsonld_diff", "LD-10", f"""{DIFF_SQL} SELECT f.doc_id, path, status, CASE WHEN status <> 'removed' THEN CASE path WHEN 'sku' THEN '"' || f.doc_id || '"' WHEN 'offers.priceCurrency' THEN '"USD"' WHEN 'offers.price' THEN p_size::VARCHAR
  WHEN 'name' THEN '"' || p_brand || '"' WHEN '@type' THEN '"Product"' WHEN '@context' THEN '"https://schema.org"' ELSE '{{"price":' || p_size || ',"priceCurrency":"USD"}}' END END AS optimized_value FROM f JOIN k USING (doc_id)""")
def _(spark, sf):
    return J.jsonld_diff(docs(spark, sf)).select("doc_id", "path", "status", "optimized_value")


@query("jsonld_delta", "LD-11", f"""{KIND} SELECT doc_id, CASE WHEN broken THEN '{{"@context":"https://schema.org","@type":"Product","name":"' || p_brand || '","offers":{{"price":' || p_size || ',"priceCurrency":"USD"}},"sku":"' || doc_id || '"}}'
  ELSE '{{' || CASE WHEN kind = 0 THEN '' ELSE '"@type":"Product",' END || '"offers":' || CASE WHEN offers THEN '{{"priceCurrency":"USD"}}' ELSE '{{"price":' || p_size || ',"priceCurrency":"USD"}}' END || ',"sku":"' || doc_id || '"}}' END AS delta FROM k""")
def _(spark, sf):
    return J.jsonld_delta(docs(spark, sf))


@query("jsonld_diff_summary", "LD-12", f"""{DIFF_SQL} SELECT doc_id, {', '.join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s}" for s in ('added', 'enriched', 'same', 'removed'))}, CAST(count(*) AS BIGINT) AS total FROM f GROUP BY doc_id""")
def _(spark, sf):
    return J.diff_summary(J.jsonld_diff(docs(spark, sf)))


@query("jsonld_top_level_status", "LD-13", f"""{DIFF_SQL} SELECT doc_id, string_split(path, '.')[1] AS field, CASE WHEN bool_or(status = 'enriched') THEN 'enriched' WHEN bool_or(status = 'added') THEN 'added' WHEN bool_or(status = 'removed') THEN 'removed' ELSE 'same' END AS status
FROM f GROUP BY 1, 2""")
def _(spark, sf):
    return J.top_level_status(J.jsonld_diff(docs(spark, sf)))


@query("jsonld_org_node", "LD-14", f"""{KIND} SELECT doc_id, '{{"@type":"Organization","sameAs":["https://x.com/a","https://youtube.com/b"]}}' AS node FROM k WHERE NOT broken AND kind = 2""")
def _(spark, sf):
    return J.org_node(docs(spark, sf), "doc_id", "original")


@query("jsonld_light", "LD-15", f"""{KIND} SELECT doc_id, CASE kind WHEN 0 THEN 'Product' WHEN 1 THEN '["Product","Article"]' WHEN 2 THEN 'Unknown' ELSE 'Event' END AS type, p_brand AS name FROM k WHERE NOT broken""")
def _(spark, sf):
    light = docs(spark, sf).select("doc_id", F.explode(J.light_jsonld(c("original"))).alias("l"))
    return light.select("doc_id", c("l.@type").alias("type"), "l.name")


ORGS = """SELECT s_suppkey AS doc_id, '{"@graph":[{"@type":"WebSite","publisher":{"@type":["LocalBusiness"],"name":" ' || s_name || ' ","legalName":"SA","url":"https://s.fr","logo":' ||
  CASE WHEN s_suppkey % 2 = 0 THEN '"https://l.png"' ELSE '{"url":"https://o.png"}' END || ',"telephone":"0' || CAST(s_suppkey AS STRING) || '","address":{"streetAddress":"1 rue","postalCode":"75' || CAST(s_suppkey AS STRING) || '","addressCountry":' ||
  CASE WHEN s_suppkey % 3 = 0 THEN '{"name":"France"}' ELSE '"FR"' END || '},"sameAs":["https://www.linkedin.com/company/netflix.com","https://x.com/s","https://twitter.com/t"]}}]}' AS doc FROM supplier"""


def orgs(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(ORGS)


@query("jsonld_org_fields", "LD-16", """SELECT s_suppkey AS doc_id, s_name AS brand_name, 'SA' AS legal_name, 'https://s.fr' AS site_url, CASE WHEN s_suppkey % 2 = 0 THEN 'https://l.png' ELSE 'https://o.png' END AS logo_url, '0' || s_suppkey AS phone,
  '1 rue' AS street, '' AS city, '75' || s_suppkey AS zip_code, CASE WHEN s_suppkey % 3 = 0 THEN 'France' ELSE 'FR' END AS country, 'https://www.linkedin.com/company/netflix.com' AS linkedin_url, 'https://x.com/s' AS twitter_url, '' AS facebook_url FROM supplier""")
def _(spark, sf):
    f = J.org_fields(J.org_node(orgs(spark, sf)))
    return f.select("doc_id", "brand_name", "legal_name", "site_url", "logo_url", "phone", "street", "city", "zip_code", "country", "linkedin_url", "twitter_url", "facebook_url")


MASTERS = """SELECT s_suppkey AS entity_id, s_name AS brand_name, CASE WHEN s_suppkey % 2 = 0 THEN 'https://s' || CAST(s_suppkey AS STRING) || '.fr' ELSE '' END AS site_url,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS STRING) ELSE '' END AS siren, CASE WHEN s_suppkey % 4 = 0 THEN 'Paris' ELSE '' END AS city, CASE WHEN s_suppkey % 5 = 0 THEN 'https://linkedin.com/c' ELSE '' END AS linkedin_url,
  CASE WHEN s_suppkey % 6 = 0 THEN 'Q' || CAST(s_suppkey AS STRING) ELSE '' END AS qid, CASE WHEN s_suppkey % 7 = 0 THEN 'https://l.png' ELSE '' END AS logo_url,
  CASE WHEN s_suppkey % 8 = 0 THEN '12' ELSE '' END AS num_employees FROM supplier"""


def masters(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return with_master_defaults(spark.sql(MASTERS))


def org_json_sql() -> str:
    part = lambda cond, text: f"CASE WHEN {cond} THEN {text} ELSE '' END"
    same = "array_to_string(list_filter([CASE WHEN linkedin_url <> '' THEN '\"' || linkedin_url || '\"' END, CASE WHEN qid <> '' THEN '\"https://www.wikidata.org/wiki/' || qid || '\"' END], lambda x: x IS NOT NULL), ',')"
    return " || ".join([
        "'{\"@context\":\"https://schema.org\",\"@type\":\"Corporation\",\"name\":\"' || brand_name || '\"'",
        part("site_url <> ''", "',\"url\":\"' || site_url || '\"'"),
        part("logo_url <> ''", "',\"logo\":{\"@type\":\"ImageObject\",\"url\":\"' || logo_url || '\",\"width\":\"600\",\"height\":\"200\"}'"),
        part("siren <> ''", "',\"identifier\":[{\"@type\":\"PropertyValue\",\"propertyID\":\"SIREN\",\"value\":\"' || siren || '\"}]'"),
        "',\"address\":{' ||" + part("city <> ''", "'\"addressLocality\":\"' || city || '\",'") + " || '\"addressCountry\":\"FR\",\"@type\":\"PostalAddress\"}'",
        part("linkedin_url <> '' OR qid <> ''", f"',\"sameAs\":[' || {same} || ']'"),
        part("num_employees <> ''", "',\"numberOfEmployees\":{\"@type\":\"QuantitativeValue\",\"value\":\"' || num_employees || '\"}'"),
        "'}'"])


@query("jsonld_build_organization", "LD-17", f"WITH m AS ({MASTERS}) SELECT entity_id, {org_json_sql()} AS jsonld FROM m")
def _(spark, sf):
    return J.build_org_jsonld(masters(spark, sf))


@query("jsonld_build_webpage", "LD-18", f"""WITH m AS ({MASTERS}), p AS (SELECT page_id, url, 1 + page_id % 40 AS entity_id FROM pages)
SELECT page_id, '{{"@context":"https://schema.org","@type":"WebPage","url":"' || url || '","name":"page ' || page_id || '","description":"","dateModified":"{AS_OF}","publisher":{{"@type":"Organization","name":"' || coalesce(brand_name, '') || '","url":"' || coalesce(site_url, '') || '"'
  || CASE WHEN logo_url <> '' THEN ',"logo":{{"@type":"ImageObject","url":"' || logo_url || '"}}' ELSE '' END || '}}}}' AS jsonld FROM p LEFT JOIN m USING (entity_id)""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", (F.lit(1) + c("page_id") % 40).alias("entity_id"),
                                         F.concat(F.lit("page "), c("page_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("description"))
    return J.build_webpage_jsonld(p, masters(spark, sf), AS_OF).select("page_id", "jsonld")


@query("model_answers", "LD-19", f"""{with_views('model_responses')} SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '{{"model_name":"' || said || '","schema_type":"Product"}}'
  WHEN 1 THEN '{{"@context":"https://schema.org","@type":"Article","name":"' || said || '"}}' WHEN 2 THEN '{{"a":"' || said || '"}}' END AS json, (conv_id + turn) % 4 = 1 AS is_document FROM model_responses""")
def _(spark, sf):
    j = view(spark, sf, "model_responses").select("conv_id", "turn", J.parse_model_json(c("content")).alias("json"))
    return j.withColumn("is_document", J.is_jsonld_document(c("json")))


