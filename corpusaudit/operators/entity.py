"""Entity master data: knowledge-graph records, enrichment, sectors and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import falsy, strip
from ..plans.shapes import in_turn, latest
from .jsonld import parse_model_json

# Master-data columns in order and their defaults.
MASTER_FIELDS = [
    "brand_name", "legal_name", "description", "slogan", "org_type", "qid", "siren", "siret", "lei", "ticker_symbol",
    "stock_exchange", "site_url", "wikipedia_url", "linkedin_url", "twitter_url", "facebook_url", "instagram_url",
    "youtube_url", "tiktok_url", "logo_url", "logo_width", "logo_height", "phone", "email", "fax", "street", "city",
    "region", "zip_code", "country", "latitude", "longitude", "founding_date", "founder_name", "num_employees",
    "annual_revenue", "parent_org", "status", "last_updated",
]
MASTER_DEFAULTS = {"org_type": "Corporation", "logo_width": "600", "logo_height": "200", "country": "FR", "status": "pending"}
UNCOUNTED = ["status", "last_updated"]

# Knowledge-graph properties read as text, and what stands before the value.
CLAIM_TEXTS = {
    "siren": ("P1616", ""),
    "lei": ("P1278", ""),
    "website": ("P856", ""),
    "linkedin_url": ("P4264", "https://www.linkedin.com/company/"),
    "twitter_url": ("P2002", "https://twitter.com/"),
    "facebook_url": ("P2013", "https://www.facebook.com/"),
    "instagram_url": ("P2003", "https://www.instagram.com/"),
    "youtube_url": ("P2397", "https://www.youtube.com/channel/"),
}
LOGO_BASE = "https://commons.wikimedia.org/wiki/Special:FilePath/"

# Sectors and their keywords, in declaration order.
SECTORS = {
    "B": ["produit", "vente", "commerce", "boutique", "e-commerce", "shop"],
    "H": ["service", "conseil", "consulting", "agence", "bureau"],
    "I": ["software", "application", "app", "saas", "logiciel"],
    "A": ["blog", "article", "média", "presse", "journal"],
    "C": ["recette", "cuisine", "restaurant", "chef"],
    "D": ["événement", "concert", "festival", "spectacle"],
    "E": ["formation", "cours", "école", "université", "training"],
    "F": ["emploi", "recrutement", "job", "carrière"],
    "G": ["local", "magasin", "point de vente", "retail"],
    "J": ["livre", "édition", "publisher", "book"],
    "K": ["film", "cinéma", "movie", "production"],
    "L": ["musique", "album", "artist", "label"],
    "M": ["médical", "santé", "health", "clinic", "hospital"],
    "N": ["véhicule", "auto", "car", "vehicle"],
    "O": ["podcast", "audio", "émission"],
    "P": ["jeu", "game", "gaming", "esport"],
    "Q": ["data", "dataset", "research", "recherche"],
}

# Url marks and the sector of each, in test order.
URL_SECTORS = [("/product", "B"), ("/produit", "B"), ("/recipe", "C"), ("/recette", "C"), ("/event", "D"), ("/evenement", "D")]

DECISIONS = ["keep", "hesitant", "reject"]


def _label(part: str, lang: str) -> Column:
    return F.coalesce(F.try_variant_get("_doc", f"$.{part}.{lang}.value", "string"), F.lit(""))


def kg_features(entities: DataFrame) -> DataFrame:
    """Counts of properties, references and external identifiers, whether an encyclopedia links here, and the label."""
    d = entities.withColumn("_doc", V.parse(F.col("doc")))
    claims = V.as_object(V.field(F.col("_doc"), "claims"))
    flat = F.flatten(F.transform(F.map_values(claims), lambda p: F.coalesce(V.as_list(p), V.nothing())))
    refs = F.transform(flat, lambda c: F.coalesce(F.size(V.as_list(V.field(c, "references"))), F.lit(0)))
    external = F.filter(flat, lambda c: F.try_variant_get(c, "$.mainsnak.datatype", "string") == "external-id")
    links = F.map_keys(V.as_object(V.field(F.col("_doc"), "sitelinks")))
    return d.select(
        "entity_id", "qid", F.col("_doc").isNotNull().alias("has_data"),
        F.coalesce(F.size(claims), F.lit(0)).alias("nb_properties"),
        F.coalesce(F.aggregate(refs, F.lit(0), lambda a, x: a + x), F.lit(0)).alias("nb_references"),
        F.coalesce(F.exists(links, lambda k: k.endswith("wiki")), F.lit(False)).alias("has_wikipedia"),
        F.coalesce(F.size(external), F.lit(0)).alias("nb_external_ids"),
        F.when(_label("labels", "fr") != "", _label("labels", "fr")).otherwise(_label("labels", "en")).alias("label"))


def flatten_entity(entities: DataFrame) -> DataFrame:
    """One flat row per knowledge-graph record; absent values are empty."""
    d = entities.withColumn("_doc", V.parse(F.col("doc")))
    value = lambda prop, tail="": F.try_variant_get("_doc", f"$.claims.{prop}[0].mainsnak.datavalue.value{tail}", "string")
    empty = F.lit("")
    texts = [F.coalesce(F.concat(F.lit(prefix), value(prop)), empty).alias(name) for name, (prop, prefix) in CLAIM_TEXTS.items()]
    wiki = lambda lang: F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"),
                                 F.replace(F.try_variant_get("_doc", f"$.sitelinks.{lang}wiki.title", "string"), F.lit(" "), F.lit("_")))
    logo = F.concat(F.lit(LOGO_BASE), F.replace(value("P154"), F.lit(" "), F.lit("_")))
    return d.select(
        "entity_id", "qid",
        _label("labels", "fr").alias("name_fr"), _label("labels", "en").alias("name_en"),
        _label("descriptions", "fr").alias("desc_fr"), _label("descriptions", "en").alias("desc_en"),
        *texts,
        F.coalesce(F.substring(value("P571", ".time"), 2, 10), empty).alias("founding_date"),
        F.coalesce(logo, empty).alias("logo_url"),
        F.coalesce(F.regexp_replace(value("P1128", ".amount"), r"^\++", ""), empty).alias("num_employees"),
        F.coalesce(wiki("fr"), wiki("en"), empty).alias("wikipedia_url"))


def enrich_entities(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Resolve requests (request_id, qid, siren, query) by id, else company number, else name.

    Each lookup is an equi-join on one key of the flat records. A number held by several records
    goes to the one with the smallest id, as does a name.
    """
    # The error texts below.
    flat = flatten_entity(entities)
    name = lambda c: F.lower(F.trim(c))
    by_number = flat.filter("siren <> ''").groupBy(F.col("siren").alias("_siren")).agg(F.min_by("qid", "entity_id").alias("_q_siren"))
    labels = flat.select("entity_id", "qid", F.explode(F.array_distinct(F.array(name(F.col("name_fr")), name(F.col("name_en"))))).alias("_name"))
    by_name = labels.filter("_name <> ''").groupBy("_name").agg(F.min_by("qid", "entity_id").alias("_q_name"))
    given = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    r = requests.select("request_id", given("qid").alias("_qid"), given("siren").alias("_siren"), given("query").alias("_query"))
    r = r.withColumn("_name", name(F.col("_query"))).join(by_number, "_siren", "left").join(by_name, "_name", "left")
    use_siren = F.col("_qid").isNull() & F.col("_siren").isNotNull()
    after_siren = F.coalesce("_qid", F.when(use_siren, F.col("_q_siren")))
    use_name = after_siren.isNull() & F.col("_query").isNotNull()
    r = r.withColumn("resolved", F.coalesce(after_siren, F.when(use_name, F.col("_q_name"))))
    no_siren = F.when(use_siren & F.col("_q_siren").isNull(), F.concat(F.lit("SIREN "), F.col("_siren"), F.lit(" non trouvé")))
    no_name = F.when(use_name & F.col("_q_name").isNull(), F.concat(F.lit("Aucun résultat pour '"), F.col("_query"), F.lit("'")))
    j = r.withColumn("_e1", no_siren).withColumn("_e2", no_name).join(flat, F.col("resolved") == F.col("qid"), "left")
    found = F.col("entity_id").isNotNull()
    unknown = F.when(F.col("resolved").isNull(), F.lit("Entité introuvable")) \
        .when(~found, F.concat(F.lit("Données indisponibles pour "), F.col("resolved")))
    pick = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(F.coalesce(b, F.lit("")))
    plain = ["lei", "founding_date", "logo_url", "linkedin_url", "twitter_url", "facebook_url", "instagram_url", "youtube_url",
             "wikipedia_url", "num_employees"]
    return j.select(
        "request_id", F.coalesce("qid", F.lit("")).alias("qid"),
        F.coalesce(pick("name_fr", F.col("name_en")), F.lit("")).alias("brand_name"),
        F.coalesce(pick("desc_fr", F.col("desc_en")), F.lit("")).alias("description"),
        F.when(found, pick("siren", F.col("_siren"))).otherwise("").alias("siren"),
        F.coalesce("website", F.lit("")).alias("site_url"), *[F.coalesce(c, F.lit("")).alias(c) for c in plain],
        F.when(found, "partial").otherwise("failed").alias("status"), F.array_compact(F.array("_e1", "_e2", unknown)).alias("errors"))


def with_master_defaults(masters: DataFrame) -> DataFrame:
    """All master-data columns, missing ones with their default."""
    have = set(masters.columns)
    extra = [c for c in masters.columns if c not in MASTER_FIELDS]
    return masters.select(*extra, *[(F.coalesce(F.col(c), F.lit("")) if c in have else F.lit(MASTER_DEFAULTS.get(c, ""))).alias(c)
                                    for c in MASTER_FIELDS])


def registry_rows(raw: DataFrame) -> DataFrame:
    """Company-registry records (JSON text) as number, name, one-line address and active flag."""
    v = V.parse(F.col("doc"))
    get = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    parts = [F.nullif(get(f"$.siege.{p}"), F.lit("")) for p in ("adresse", "code_postal", "commune")]
    keys = [c for c in raw.columns if c != "doc"]
    return raw.select(*keys, get("$.siren").alias("siren"), get("$.nom_complet").alias("name"),
                      F.trim(F.concat_ws(" ", *parts)).alias("address"), (get("$.etat_administratif") == "A").alias("active"))


def fill_missing(masters: DataFrame, patch: DataFrame, key: str = "entity_id", order: str | None = None) -> DataFrame:
    """Fill only empty fields from a patch, list the fields updated, and mark the row complete if there are any.

    Of several patches of a key, the first with a value fills a field; it is not empty for the later ones.
    """
    cols = [c for c in masters.columns if c in patch.columns and c not in (key, order)]
    p = in_turn(patch, [key], cols, order, first=True, skip=falsy).select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = masters.join(p, key, "left")
    takes = lambda c: falsy(F.col(c)) & ~falsy(F.col(f"_new_{c}"))
    updated = F.array_compact(F.array(*[F.when(takes(c), F.lit(c)) for c in cols]))
    kept = [F.when(takes(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in masters.columns if c != "status"]
    status = F.col("status") if "status" in masters.columns else F.lit("")
    return j.select(*kept, F.when(F.size(updated) > 0, "complete").otherwise(status).alias("status"), updated.alias("updated"))


def country_hint(masters: DataFrame) -> DataFrame:
    """Set an empty country to FR for a five-digit postcode, or else a French site address."""
    site = F.lower(F.coalesce("site_url", F.lit("")))
    french = F.col("zip_code").rlike(r"^\p{Nd}{5}$") | site.endswith(".fr") | site.contains(".fr/")
    return masters.withColumn("country", F.when(falsy(F.col("country")) & F.coalesce(french, site.endswith(".fr") | site.contains(".fr/")), "FR")
                              .otherwise(F.col("country")))


def filled_fields(masters: DataFrame) -> DataFrame:
    """Add ``filled``: number of filled master-data fields, bookkeeping fields left out."""
    counted = [c for c in MASTER_FIELDS if c in masters.columns and c not in UNCOUNTED]
    return masters.withColumn("filled", sum((F.when(falsy(F.col(c)), 0).otherwise(1) for c in counted), F.lit(0)))


def predict_sector(name: Column, description: Column) -> Column:
    """Sector with most keywords in name and description; the first declared wins ties, B without any."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))

    def hits(words: list[str]) -> Column:
        return sum((F.when(text.contains(w), 1).otherwise(0) for w in words[1:]), F.when(text.contains(words[0]), 1).otherwise(0))

    ranked = F.array(*[F.struct(hits(ws).alias("n"), F.lit(-i).alias("r"), F.lit(s).alias("s")) for i, (s, ws) in enumerate(SECTORS.items())])
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["s"]).otherwise("B")


def url_sector(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(*[F.when(low.contains(p), F.lit(s)) for p, s in URL_SECTORS], F.lit("A"))


def predictions_by_decision(predictions: DataFrame, key: str = "entity_id") -> DataFrame:
    """Predicted fields with a known decision, one row each; the decision is the group."""
    return predictions.filter(F.col("decision").isin(DECISIONS)).select(key, "decision", "pos", "key", "value", "confidence")


def decision_counts(predictions: DataFrame, key: str = "entity_id") -> DataFrame:
    """Fields per entity and decision."""
    known = predictions.filter(F.col("decision").isin(DECISIONS))
    return known.groupBy(key).agg(*[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS])


def accepted_predictions(predictions: DataFrame, key: str = "entity_id") -> DataFrame:
    """Fields predicted with confidence above 0.7 and a value; the last prediction of a field wins."""
    good = predictions.filter((F.col("confidence") > 0.7) & ~falsy(F.col("value")))
    return latest(good, [key, "key"], [F.desc("pos"), F.col("value")]).select(key, "key", "value")


def apply_predictions(docs: DataFrame, predictions: DataFrame, key: str = "entity_id") -> DataFrame:
    """Write accepted predictions into the entity's JSON document, replacing fields of the same name."""
    new = accepted_predictions(predictions, key).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.parse_json(F.regexp_replace(F.to_json(F.array("value")), r"^\[|\]$", "")).alias("value")))).alias("_new"))
    old = V.as_object(V.parse(F.col("doc")))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key("_new", k))
    merged = F.when(F.col("_new").isNull(), old).otherwise(F.map_concat(kept, F.col("_new")))
    return docs.join(new, key, "left").select(key, F.to_json(F.to_variant_object(merged)).alias("doc"))


def parse_predictions(responses: DataFrame, *keys: str) -> DataFrame:
    """Rows of the ``predictions`` list of model answers, with defaults."""
    v = V.parse(parse_model_json(F.col("content")))
    items = V.as_list(V.field(v, "predictions"))
    rows = responses.select(*keys, F.posexplode(items).alias("pos", "p"))
    get = lambda n: F.coalesce(F.try_variant_get("p", f"$.{n}", "string"), F.lit(""))
    return rows.select(*keys, "pos", get("key").alias("key"), get("value").alias("value"),
                       F.coalesce(F.try_variant_get("p", "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
                       F.coalesce(F.try_variant_get("p", "$.decision", "string"), F.lit("reject")).alias("decision"),
                       get("reason").alias("reason"))
