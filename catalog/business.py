"""Entity master data, mentions, and saved snapshots with their workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.operators import entity as E
from corpusaudit.operators import offpage as O
from corpusaudit.operators import saves as V

from . import sqlfn as S
from .base import query, table, view, with_views
from .structured import MASTERS, masters

c = F.col
PIPE = "'|'"
KG = with_views("kg_entities")

# ---------------------------------------------------------------- entities


@query("entity_kg_features", "ENT-1", f"""{KG} SELECT entity_id, qid, 2 AS nb_properties, 2 AS nb_references, 1 AS nb_external_ids, entity_id % 3 = 0 AS has_wikipedia,
  CASE WHEN entity_id % 2 = 0 THEN n_name ELSE lower(n_name) END AS label FROM kg_entities JOIN nation ON n_nationkey = entity_id""")
def _(spark, sf):
    return E.kg_features(view(spark, sf, "kg_entities")).drop("has_data")


@query("entity_flat", "ENT-2", f"""{KG} SELECT entity_id, qid, coalesce(json_extract_string(doc, '$.labels.fr.value'), '') AS name_fr, coalesce(json_extract_string(doc, '$.labels.en.value'), '') AS name_en, '' AS siren,
  coalesce(json_extract_string(doc, '$.claims.P1278[0].mainsnak.datavalue.value'), '') AS lei, coalesce(json_extract_string(doc, '$.claims.P856[0].mainsnak.datavalue.value'), '') AS website,
  coalesce('https://fr.wikipedia.org/wiki/' || replace(json_extract_string(doc, '$.sitelinks.frwiki.title'), ' ', '_'), '') AS wikipedia_url, '' AS logo_url, '' AS num_employees FROM kg_entities""")
def _(spark, sf):
    return E.flatten_entity(view(spark, sf, "kg_entities")).select(
        "entity_id", "qid", "name_fr", "name_en", "siren", "lei", "website", "wikipedia_url", "logo_url", "num_employees")


REQUESTS = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 = 0 THEN 'Q' || CAST(c_custkey % 30 AS STRING) END AS qid, CASE WHEN c_custkey % 4 = 1 THEN CAST(c_custkey AS STRING) END AS siren,
  CASE WHEN c_custkey % 4 IN (1, 2) THEN n_name WHEN c_custkey % 12 = 3 THEN 'inconnu' END AS query FROM customer JOIN nation ON n_nationkey = c_nationkey"""


@query("entity_enriched", "ENT-3", f"""{KG}, r AS ({REQUESTS}), nm AS (SELECT lower(n_name) AS name, 'Q' || min(n_nationkey) AS q FROM nation GROUP BY 1),
x AS (SELECT r.*, coalesce(r.qid, q) AS resolved FROM r LEFT JOIN nm ON nm.name = lower(r.query)),
j AS (SELECT x.*, k.qid AS found, k.entity_id AS eid, n_name FROM x LEFT JOIN kg_entities k ON k.qid = x.resolved LEFT JOIN nation ON n_nationkey = k.entity_id)
SELECT request_id, coalesce(found, '') AS qid, coalesce(CASE WHEN eid % 2 = 0 THEN n_name ELSE lower(n_name) END, '') AS brand_name, CASE WHEN found IS NOT NULL THEN coalesce(siren, '') ELSE '' END AS siren,
  CASE WHEN found IS NULL THEN 'failed' ELSE 'partial' END AS status,
  array_to_string(list_filter([CASE WHEN qid IS NULL AND siren IS NOT NULL THEN 'SIREN ' || siren || ' non trouvé' END, CASE WHEN qid IS NULL AND query = 'inconnu' THEN 'Aucun résultat pour ''inconnu''' END,
    CASE WHEN resolved IS NULL THEN 'Entité introuvable' WHEN found IS NULL THEN 'Données indisponibles pour ' || resolved END], lambda y: y IS NOT NULL), {PIPE}) AS errors FROM j""")
def _(spark, sf):
    for t in ("customer", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    r = E.enrich_entities(spark.sql(REQUESTS), view(spark, sf, "kg_entities"))
    return r.select("request_id", "qid", "brand_name", "siren", "status", F.array_join("errors", "|").alias("errors"))


REGISTRY = """SELECT s_suppkey AS k, '{"siren":"' || CAST(s_suppkey AS STRING) || '","nom_complet":"' || s_name || '","etat_administratif":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'C' ELSE 'A' END || '","siege":{' ||
  CASE WHEN s_suppkey % 2 = 0 THEN '"adresse":"1 rue","code_postal":"75001","commune":"PARIS"' ELSE '"adresse":"","commune":"LYON"' END || '}}' AS doc FROM supplier"""


@query("entity_registry", "ENT-4", """SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS siren, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '1 rue 75001 PARIS' ELSE 'LYON' END AS address, s_suppkey % 3 <> 0 AS active FROM supplier""")
def _(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return E.registry_rows(spark.sql(REGISTRY))


@query("entity_fill_missing", "ENT-5", f"""WITH m AS ({MASTERS}), u AS (SELECT *, entity_id % 9 <> 0 AS patched FROM m)
SELECT entity_id, brand_name, CASE WHEN patched AND city = '' THEN 'Nice' ELSE city END AS city, CASE WHEN patched AND siren = '' AND entity_id % 2 = 0 THEN '999' ELSE siren END AS siren,
  CASE WHEN patched AND (city = '' OR (siren = '' AND entity_id % 2 = 0)) THEN 'complete' ELSE 'pending' END AS status,
  CASE WHEN patched THEN array_to_string(list_filter([CASE WHEN siren = '' AND entity_id % 2 = 0 THEN 'siren' END, CASE WHEN city = '' THEN 'city' END], lambda x: x IS NOT NULL), {PIPE}) ELSE '' END AS updated FROM u""")
def _(spark, sf):
    m = masters(spark, sf)
    patch = m.filter("entity_id % 9 <> 0").select("entity_id", F.lit("autre").alias("brand_name"), F.lit("Nice").alias("city"), F.when(c("entity_id") % 2 == 0, "999").otherwise("").alias("siren"))
    return E.fill_missing(m, patch).select("entity_id", "brand_name", "city", "siren", "status", F.array_join("updated", "|").alias("updated"))


HINTS = """SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 4 = 0 THEN 'BE' ELSE '' END AS country, CASE WHEN s_suppkey % 3 = 0 THEN '75001' WHEN s_suppkey % 3 = 1 THEN '1000' ELSE NULL END AS zip_code,
  CASE WHEN s_suppkey % 5 = 0 THEN 'https://A.FR/x' WHEN s_suppkey % 5 = 1 THEN 'https://a.fr' WHEN s_suppkey % 5 = 2 THEN NULL ELSE 'https://a.fr.com' END AS site_url FROM supplier"""


@query("entity_country_hint", "ENT-6", f"""SELECT entity_id, CASE WHEN country <> '' THEN country WHEN zip_code = '75001' OR entity_id % 5 IN (0, 1) THEN 'FR' ELSE '' END AS country FROM ({HINTS})""")
def _(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return E.country_hint(spark.sql(HINTS)).select("entity_id", "country")


@query("entity_filled_fields", "ENT-7", f"""WITH m AS ({MASTERS}) SELECT entity_id, CAST(5 + (site_url <> '')::INT + (siren <> '')::INT + (city <> '')::INT + (linkedin_url <> '')::INT + (qid <> '')::INT + (logo_url <> '')::INT + (num_employees <> '')::INT AS INTEGER) AS filled FROM m""")
def _(spark, sf):
    return E.filled_fields(masters(spark, sf)).select("entity_id", "filled")


SECTOR_TEXT = "'Maison ' || source || ' ' || text || CASE doc_id % 7 WHEN 0 THEN ' Vente de PRODUIT et boutique' WHEN 1 THEN ' agence conseil' WHEN 2 THEN ' concert et film' WHEN 4 THEN ' école, cours, formation' ELSE '' END"


def sector_sql() -> str:
    scores = ", ".join("(" + " + ".join(f"contains(t, {S.q(w)})::INT" for w in ws) + ")" for ws in E.SECTORS.values())
    return f"(SELECT doc_id, [{scores}] AS s FROM (SELECT doc_id, lower('acme ' || {SECTOR_TEXT}) AS t FROM documents))"


@query("entity_sectors", "ENT-8", f"SELECT doc_id, CASE WHEN list_max(s) = 0 THEN 'B' ELSE {S.list_of(E.SECTORS)}[list_position(s, list_max(s))] END AS sector FROM {sector_sql()}")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.predict_sector(F.lit("Acme"), F.expr(SECTOR_TEXT)).alias("sector"))


URLS = "url || CASE page_id % 7 WHEN 0 THEN '/Product/1' WHEN 1 THEN '/recette' WHEN 2 THEN '/evenement/produit' WHEN 3 THEN '/event' ELSE '' END"


@query("entity_url_sectors", "ENT-9", f"""SELECT page_id, CASE WHEN page_id % 7 IN (0) THEN 'B' WHEN page_id % 7 = 1 THEN 'C' WHEN page_id % 7 = 2 THEN CASE WHEN contains(lower({URLS}), '/produit') THEN 'B' ELSE 'D' END WHEN page_id % 7 = 3 THEN 'D' ELSE 'A' END AS sector FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", E.url_sector(F.expr(URLS)).alias("sector"))


PRED = with_views("predictions")


@query("prediction_decisions", "ENT-10", f"{PRED} SELECT entity_id, decision, pos, key, value, round(confidence, 6) AS confidence FROM predictions")
def _(spark, sf):
    return E.predictions_by_decision(view(spark, sf, "predictions")).withColumn("confidence", F.round("confidence", 6))


@query("prediction_decision_counts", "ENT-10", f"""{PRED} SELECT entity_id, {', '.join(f"CAST(count(*) FILTER (decision = '{d}') AS BIGINT) AS {d}" for d in E.DECISIONS)} FROM predictions GROUP BY entity_id""")
def _(spark, sf):
    return E.decision_counts(view(spark, sf, "predictions"))


ACCEPTED = f"""{PRED}, a AS (SELECT entity_id, key, value FROM predictions WHERE confidence > 0.7::DOUBLE AND value <> '' QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY pos DESC, value) = 1),
f AS (SELECT entity_id, key, value FROM a UNION ALL SELECT o_orderkey, '@type', 'Thing' FROM orders UNION ALL SELECT o_orderkey, 'DYN_FIELD_1', 'old' FROM orders WHERE o_orderkey NOT IN (SELECT entity_id FROM a WHERE key = 'DYN_FIELD_1'))"""


@query("prediction_documents", "ENT-11", f"""{ACCEPTED} SELECT entity_id, '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key COLLATE "C") || '}}' AS doc FROM f WHERE entity_id IN (SELECT o_orderkey FROM orders) GROUP BY entity_id""".replace(' COLLATE "C"', ""))
def _(spark, sf):
    docs = table(spark, sf, "orders").select(c("o_orderkey").alias("entity_id"), F.lit('{"@type":"Thing","DYN_FIELD_1":"old"}').alias("doc"))
    return E.apply_predictions(docs, view(spark, sf, "predictions"))


SAID = "TRANSLATE(text, '\"{}[]<>`' || chr(92) || chr(10) || chr(13) || chr(9), '') || '.'"
ANSWERS = f"""SELECT conv_id, turn, '```json' || chr(10) || '{{"predictions":[{{"key":"k' || CAST(turn AS STRING) || '","value":"' || {SAID} || '","confidence":0.8,"decision":"keep","reason":"r"}},{{"key":"z"}}' ||
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE ']}}' END || chr(10) || '```' AS content FROM conversations"""


@query("prediction_rows", "ENT-12", f"""SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest(['k' || turn, 'z']) AS key, unnest([trim({SAID}), '']) AS value, unnest([0.8::DOUBLE, 0.0::DOUBLE]) AS confidence, unnest(['keep', 'reject']) AS decision,
  unnest(['r', '']) AS reason FROM conversations WHERE conv_id % 5 <> 0""")
def _(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    return E.parse_predictions(spark.sql(ANSWERS), "conv_id", "turn")


# ---------------------------------------------------------------- mentions

MEN = with_views("mentions")
SITES = "[" + ", ".join(f"'{d}'" for d, _, _ in O.SOURCES) + "]"
NAMED = f"{MEN}, m AS (SELECT mention_id, brand, {SITES}[1 + mention_id % 9] AS domain_key, title, descr, url FROM mentions)"


def mentions(spark, sf):
    sites = F.array(*[F.lit(d) for d, _, _ in O.SOURCES])
    return view(spark, sf, "mentions").withColumn("domain_key", F.element_at(sites, (F.lit(1) + c("mention_id") % 9).cast("int")))


@query("mention_sources", "OFF-1", f"""{NAMED}, s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{d}', {p})" for i, (d, _, p) in enumerate(O.SOURCES))}) t(ord, domain_key, priority)),
f AS (SELECT * FROM s ORDER BY priority, ord LIMIT 6) SELECT domain_key, CAST(count(mention_id) AS BIGINT) AS mentions FROM f LEFT JOIN m USING (domain_key) GROUP BY domain_key""")
def _(spark, sf):
    return O.mention_counts(mentions(spark, sf), O.select_sources(O.source_table(spark), "fast"))


@query("mention_top", "OFF-2", f"""{NAMED} SELECT brand, domain_key, mention_id, CAST(row_number() OVER (PARTITION BY brand, domain_key ORDER BY mention_id) AS INTEGER) AS position FROM m
  QUALIFY row_number() OVER (PARTITION BY brand, domain_key ORDER BY mention_id) <= 3""")
def _(spark, sf):
    return O.top_mentions(mentions(spark, sf)).select("brand", "domain_key", "mention_id", "position")


@query("mention_counts", "OFF-3", f"{NAMED} SELECT s.domain_key, CAST(count(mention_id) AS BIGINT) AS mentions FROM (SELECT unnest({SITES}) AS domain_key) s LEFT JOIN m USING (domain_key) GROUP BY 1")
def _(spark, sf):
    return O.mention_counts(mentions(spark, sf), O.source_table(spark))


@query("mention_kpis", "OFF-3", f"{NAMED} SELECT brand, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT domain_key) AS BIGINT) AS sources FROM m GROUP BY brand")
def _(spark, sf):
    return O.mention_kpis(mentions(spark, sf))


# Concepts of a brand: all long words of some of its own texts, in capitals, their last words, and short or frequent ones.
LONG_WORD, LAST_WORDS = "[A-Za-z]{16,}", "([A-Za-z]+ [A-Za-z]+)[^A-Za-z]*$"
UPPER = "TRANSLATE({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
OWNER = "'brand' || CAST(doc_id * 3 % 20 AS STRING)"
CONCEPTS = f"""SELECT DISTINCT {OWNER} AS brand, {UPPER.format('word')} AS concept FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LONG_WORD}')) AS word FROM documents)
UNION SELECT DISTINCT {OWNER}, regexp_extract(text, '{LAST_WORDS}', 1) FROM documents UNION SELECT 'brand3', 'A' UNION SELECT 'brand3', 'tz' UNION SELECT 'brand4', 'the '"""
MATCH = f"""{NAMED}, co AS (SELECT * FROM ({CONCEPTS}) WHERE concept <> ''), hit AS (SELECT DISTINCT co.brand, concept, mention_id, title, url FROM co JOIN m ON m.brand = co.brand AND (contains(lower(title), lower(concept)) OR contains(lower(descr), lower(concept))))"""


def concepts(spark, sf):
    d = table(spark, sf, "documents").select(F.expr(OWNER).alias("brand"), "text")
    long_words = d.select("brand", F.explode(F.regexp_extract_all("text", F.lit(LONG_WORD), F.lit(0))).alias("word")).select("brand", F.expr(UPPER.format("word")).alias("concept"))
    # LAST_WORDS from the end: tried at the first place only, not at every word of the text.
    last = d.select("brand", F.reverse(F.regexp_extract(F.reverse("text"), "^[^A-Za-z]*([A-Za-z]+ [A-Za-z]+)", 1)).alias("concept"))
    short = spark.sql("SELECT * FROM VALUES ('brand3', 'A'), ('brand3', 'tz'), ('brand4', 'the ') AS t(brand, concept)")
    return long_words.unionByName(last).unionByName(short).distinct()


@query("mention_concepts", "OFF-4", f"""{MATCH} SELECT brand, concept, mention_id, CAST(count(*) OVER (PARTITION BY brand, concept) AS BIGINT) AS matches, string_split(url, '/')[3] AS host FROM hit
  QUALIFY row_number() OVER (PARTITION BY brand, concept ORDER BY mention_id) <= 3""")
def _(spark, sf):
    return O.concept_mentions(concepts(spark, sf), mentions(spark, sf)).select("brand", "concept", "mention_id", "matches", "host")


@query("vocabulary_gap", "OFF-5", """WITH w AS (SELECT doc_id, source, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS concept FROM documents),
g AS (SELECT source, concept, bool_or(doc_id % 2 = 0) AS i, bool_or(doc_id % 2 = 1) AS e FROM w GROUP BY source, concept)
SELECT source, concept, CASE WHEN i AND e THEN 'aligned' WHEN e THEN 'noise' ELSE 'invisible' END AS status FROM g""")
def _(spark, sf):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    d = table(spark, sf, "documents").select("doc_id", "source", words.alias("word")).select("doc_id", "source", F.lower("word").alias("concept"))
    return O.vocabulary_gap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "source")


@query("mention_digest", "OFF-6", f"""{NAMED}, k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY brand ORDER BY mention_id) <= 10)
SELECT brand, string_agg('- ' || title || ': ' || substring(descr, 1, 100), chr(10) ORDER BY mention_id) AS digest FROM k GROUP BY brand""")
def _(spark, sf):
    return O.mention_digest(mentions(spark, sf))


@query("mention_export", "SRC-12", f"""{NAMED}, k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY brand, domain_key ORDER BY mention_id) <= 2)
SELECT brand, CAST(count(*) AS BIGINT) AS total_mentions, 'fast' AS scan_mode, string_agg(CAST(mention_id AS VARCHAR), '|' ORDER BY mention_id) AS ids FROM k GROUP BY brand""")
def _(spark, sf):
    x = O.export_mentions(mentions(spark, sf), "fast").withColumn("v", F.parse_json("json"))
    ids = F.transform(F.try_variant_get("v", "$.mentions", "array<variant>"), lambda m: F.try_variant_get(m, "$.mention_id", "string"))
    return x.select("brand", F.try_variant_get("v", "$.total_mentions", "long").alias("total_mentions"), F.try_variant_get("v", "$.scan_mode", "string").alias("scan_mode"), F.array_join(ids, "|").alias("ids"))


# ---------------------------------------------------------------- saves

SAVES = with_views("saves")
BOTH = with_views("saves", "access")
WS = "CASE WHEN trim(workspace) = '' THEN 'Non classé' ELSE trim(workspace) END"
USER = "customer#000000007@x.com"


def saved(spark, sf):
    return view(spark, sf, "saves")


def access(spark, sf):
    return view(spark, sf, "access")


@query("saves_list", "SAVE-1", f"""{SAVES} SELECT save_id, lower(trim(user_email)) AS user_email, site_url, created_at, {WS} AS workspace, trim(geo_data) <> '' AS has_geo, coalesce(trim(jsonld_data), '') <> '' AS has_jsonld,
  trim(master_json) <> '' AS has_master FROM saves WHERE lower(trim(user_email)) = '{USER}'""")
def _(spark, sf):
    return V.list_saves(saved(spark, sf), " " + USER.upper())


@query("saves_load", "SAVE-2", f"""{SAVES} SELECT save_id, user_email, {WS} AS workspace, site_url FROM saves WHERE CAST(save_id AS BIGINT) % 7 = 0""")
def _(spark, sf):
    s = saved(spark, sf)
    req = s.filter("CAST(save_id AS BIGINT) % 7 = 0").select(F.concat(F.lit(" "), "save_id").alias("save_id"), F.lower("user_email").alias("user_email"))
    wrong = s.filter("CAST(save_id AS BIGINT) % 7 = 1").select("save_id", F.lit("x@y.z").alias("user_email"))
    return V.load_saves(s, req.unionByName(req).unionByName(wrong)).select("save_id", "user_email", "workspace", "site_url")


def overwrites(spark, sf):
    s = saved(spark, sf)
    rows = s.filter("CAST(save_id AS BIGINT) % 10 = 0").withColumn("workspace", F.lit(" neuf ")).withColumn(
        "save_id", F.when(F.col("save_id").cast("long") % 20 == 0, F.concat(F.lit("z"), "save_id")).otherwise(c("save_id")))
    return V.overwrite_saves(s, rows)


@query("saves_overwritten", "SAVE-3", f"""{SAVES} SELECT save_id, user_email, CASE WHEN CAST(save_id AS BIGINT) % 20 = 10 THEN 'neuf' ELSE workspace END AS workspace FROM saves""")
def _(spark, sf):
    return overwrites(spark, sf)[0].select("save_id", "user_email", "workspace")


@query("saves_rejected", "SAVE-3", f"{SAVES} SELECT 'z' || save_id AS save_id, user_email FROM saves WHERE CAST(save_id AS BIGINT) % 20 = 0")
def _(spark, sf):
    return overwrites(spark, sf)[1].select("save_id", "user_email")


NEW_MASTERS = """SELECT 'm' || CAST(c_custkey AS STRING) AS save_id, LOWER(c_name) || '@x.com' AS user_email, c_mktsegment AS workspace, 'https://site' || CAST(c_custkey % 50 AS STRING) || '.example.com' AS site_url,
  ' {"m":1} ' AS master_json FROM customer WHERE c_custkey % 4 = 0"""


@query("saves_with_masters", "SAVE-4", f"""{SAVES}, m AS ({NEW_MASTERS}), s AS (SELECT *, lower(trim(user_email)) AS u, {WS} AS w FROM saves),
n AS (SELECT save_id FROM s JOIN m ON m.user_email = s.u AND m.workspace = s.w AND m.site_url = s.site_url QUALIFY row_number() OVER (PARTITION BY u, w, s.site_url ORDER BY s.created_at DESC, s.save_id DESC) = 1)
SELECT save_id, user_email, workspace, site_url, created_at, CASE WHEN save_id IN (SELECT save_id FROM n) THEN '{{"m":1}}' ELSE master_json END AS master_json FROM s
UNION ALL SELECT save_id, user_email, workspace, site_url, '2024-01-31 10:00', '{{"m":1}}' FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE m.user_email = s.u AND m.workspace = s.w AND m.site_url = s.site_url)""".replace(
    "SELECT save_id FROM s JOIN m", "SELECT s.save_id FROM s JOIN m"))
def _(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    out = V.attach_masters(saved(spark, sf), spark.sql(NEW_MASTERS), "2024-01-31 10:00")
    return out.select("save_id", "user_email", "workspace", "site_url", "created_at", "master_json")


@query("saves_visible", "SAVE-5", f"""{BOTH} SELECT save_id, workspace FROM saves s WHERE lower(trim(user_email)) NOT IN (SELECT user_email FROM access WHERE user_email NOT LIKE '%9@x.com')
  OR EXISTS (SELECT 1 FROM access a WHERE a.user_email = lower(trim(s.user_email)) AND a.workspace_name = s.workspace)""")
def _(spark, sf):
    a = access(spark, sf)
    return V.visible_saves(saved(spark, sf), a, a.filter("user_email LIKE '%9@x.com'")).select("save_id", "workspace")


@query("workspaces", "SAVE-6", f"""{BOTH} SELECT {WS} AS workspace FROM saves UNION SELECT workspace_name FROM access""")
def _(spark, sf):
    return V.all_workspaces(saved(spark, sf), access(spark, sf))


def registered(spark, sf):
    names = table(spark, sf, "nation").select(c("n_name").alias("name")).unionByName(
        table(spark, sf, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("name")).distinct()).unionByName(
        table(spark, sf, "region").select(F.substring("r_name", 1, 0).alias("name")))
    return V.register_workspaces(saved(spark, sf), access(spark, sf), names)


@query("workspace_registry", "SAVE-7", f"""{BOTH} SELECT user_email, workspace_name FROM access UNION ALL SELECT '__workspace_registry__', n_name FROM nation""")
def _(spark, sf):
    return registered(spark, sf)[0]


@query("workspace_rejects", "SAVE-7", "SELECT DISTINCT c_mktsegment AS workspace FROM customer UNION ALL SELECT '' FROM region")
def _(spark, sf):
    return registered(spark, sf)[1]


RENAMED = "CASE {x} WHEN 'BUILDING' THEN 'Batiment' WHEN 'MACHINERY' THEN 'Non classé' ELSE {x} END"


def mapping(spark, sf):
    old = table(spark, sf, "customer").select(c("c_mktsegment").alias("old")).distinct().filter("old IN ('BUILDING', 'MACHINERY')")
    return old.withColumn("new", F.when(c("old") == "BUILDING", " Batiment ").otherwise(" "))


@query("workspace_renames", "SAVE-8", f"""{BOTH} SELECT 'saves' AS tab, CASE workspace WHEN 'BUILDING' THEN 'Batiment' ELSE workspace END AS workspace, CAST(count(*) AS BIGINT) AS n FROM saves GROUP BY 2
UNION ALL SELECT 'access', CASE workspace_name WHEN 'BUILDING' THEN 'Batiment' ELSE workspace_name END, count(*) FROM access GROUP BY 2""")
def _(spark, sf):
    t = V.remap_workspaces({"saves": (saved(spark, sf), "workspace"), "access": (access(spark, sf), "workspace_name")}, mapping(spark, sf))
    n = lambda name, col: t[name].groupBy(c(col).alias("workspace")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "workspace", "n")
    return n("saves", "workspace").unionByName(n("access", "workspace_name"))


@query("workspace_retirement", "SAVE-9", f"""{BOTH} SELECT 'saves' AS tab, {RENAMED.format(x='workspace')} AS workspace, CAST(count(*) AS BIGINT) AS n FROM saves GROUP BY 2
UNION ALL SELECT 'access', workspace_name, count(*) FROM access WHERE workspace_name NOT IN ('BUILDING', 'MACHINERY') GROUP BY 2
UNION ALL SELECT 'moved', workspace, count(*) FROM saves WHERE workspace IN ('BUILDING', 'MACHINERY') GROUP BY 2""")
def _(spark, sf):
    moved, rest, counts = V.retire_workspaces(saved(spark, sf), access(spark, sf), mapping(spark, sf))
    n = lambda df, name, col: df.groupBy(c(col).alias("workspace")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "workspace", "n")
    done = counts.select(F.lit("moved").alias("tab"), "workspace", c("saves_moved").alias("n"))
    return n(moved, "saves", "workspace").unionByName(n(rest, "access", "workspace_name")).unionByName(done)


@query("saves_moved_deleted", "SAVE-10", f"""{SAVES} SELECT save_id, CASE WHEN CAST(save_id AS BIGINT) % 3 = 0 THEN 'Non classé' ELSE workspace END AS workspace FROM saves WHERE CAST(save_id AS BIGINT) % 4 <> 0""")
def _(spark, sf):
    s = saved(spark, sf)
    moved = V.move_saves(s, s.filter("CAST(save_id AS BIGINT) % 3 = 0").select("save_id"), " ")
    return V.delete_saves(moved, s.filter("CAST(save_id AS BIGINT) % 4 = 0")).select("save_id", "workspace")


@query("model_sites", "SAVE-11", f"{SAVES} SELECT site_url, CASE WHEN workspace = '' THEN 'Non classé' ELSE workspace END AS workspace, max(created_at) AS created_at FROM saves GROUP BY 1, 2")
def _(spark, sf):
    return V.model_sites(saved(spark, sf))


AUDITS = """SELECT save_id AS audit_id, LOWER(TRIM(user_email)) AS user_email, workspace, created_at AS date, site_url, CASE WHEN CAST(save_id AS BIGINT) % 3 = 0 THEN NULL ELSE 5 END AS nb_pages,
  CAST(NULL AS STRING) AS nom_site, jsonld_data AS master_json FROM saves"""


@query("user_audits", "SAVE-12", f"""{SAVES}, a AS ({AUDITS}) SELECT audit_id, {WS} AS workspace, coalesce(nb_pages, 0) AS nb_pages, 'Site Inconnu' AS nom_site, coalesce(master_json, '') AS master_json FROM a WHERE user_email = '{USER}'""")
def _(spark, sf):
    saved(spark, sf).createOrReplaceTempView("saves")
    return V.user_audits(spark.sql(AUDITS), " " + USER.upper()).select("audit_id", "workspace", "nb_pages", "nom_site", "master_json")


@query("user_models", "SAVE-12", f"""{SAVES} SELECT save_id, site_url, CASE WHEN CAST(save_id AS BIGINT) % 2 = 0 THEN 3 ELSE 0 END AS page_count FROM saves WHERE lower(trim(user_email)) = '{USER}'""")
def _(spark, sf):
    m = saved(spark, sf).withColumn("user_email", V.email(c("user_email"))).withColumn("page_count", F.when(c("save_id").cast("long") % 2 == 0, "3").otherwise("x"))
    return V.load_models(m, USER).select("save_id", "site_url", "page_count")


@query("admin_saves", "SAVE-13", f"{SAVES} SELECT save_id, user_email, site_url, created_at, workspace FROM saves WHERE workspace = 'BUILDING' AND CAST(save_id AS BIGINT) % 10 <> 0")
def _(spark, sf):
    s = saved(spark, sf).withColumn("save_id", F.when(c("save_id").cast("long") % 10 == 0, F.concat(F.lit(V.PLACEHOLDER), "save_id")).otherwise(c("save_id")))
    return V.admin_saves(s, " BUILDING ")


@query("saves_counters", "SRC-11 SAVE-1", f"""{SAVES} SELECT {WS} AS workspace, CAST(count(*) AS BIGINT) AS saves, CAST(count(DISTINCT site_url) AS BIGINT) AS sites, CAST(count(*) FILTER (trim(geo_data) <> '') AS BIGINT) AS has_geo,
  CAST(count(*) FILTER (trim(jsonld_data) <> '') AS BIGINT) AS has_jsonld, CAST(count(*) FILTER (trim(master_json) <> '') AS BIGINT) AS has_master FROM saves GROUP BY 1""")
def _(spark, sf):
    return V.save_counters(saved(spark, sf))


@query("access_replaced", "SAVE-15", f"""{BOTH} SELECT user_email, workspace_name FROM access WHERE user_email NOT LIKE '%3@x.com' UNION ALL SELECT user_email, 'nouveau' FROM access WHERE user_email LIKE '%3@x.com' AND workspace_name = 'BUILDING'""")
def _(spark, sf):
    a = access(spark, sf).filter("user_email LIKE '%3@x.com'")
    name = F.when(c("workspace_name") == "BUILDING", " nouveau ").otherwise(" ")
    return V.replace_access(access(spark, sf), a.select(F.concat(F.lit(" "), F.upper("user_email")).alias("user_email"), name.alias("workspace_name")))
