"""Entity authority index: five pillars, weighted total, bands, recommendations and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions.numbers import round_to
from ..functions.urls import host
from ..plans.shapes import pick_rows, top_k

# Pillars in report order, the weight and shown name of each.
PILLARS = [
    ("knowledge_graph", 0.30, "Ancrage Knowledge Graph"),
    ("structured_data", 0.25, "Interopérabilité des Données"),
    ("citation_authority", 0.20, "Autorité de Citation"),
    ("semantic_completeness", 0.15, "Densité Vectorielle"),
    ("content_freshness", 0.10, "Fraîcheur de Contenu"),
]

# Lowest score of each band and its text.
BANDS = [
    (80, "Autorite Forte - Tres probablement cite par les LLMs"),
    (60, "Autorite Moyenne - Citation occasionnelle par les LLMs"),
    (40, "Autorite Faible - Rarement cite par les LLMs"),
    (0, "Autorite Tres Faible - Invisible pour les LLMs"),
]

# Recommendation texts; {entity} stands for the entity name.
RECO_TEXTS = {
    "kg_create": "Creer une fiche Wikidata pour '{entity}' avec les proprietes essentielles "
                 "(site web officiel, identifiants externes, description factuelle). "
                 "C'est un point d'ancrage central pour les LLMs et les systemes RAG.",
    "kg_enrich": "Enrichir la fiche Wikidata : ajouter des references, identifiants externes "
                 "(ISNI, SIREN, etc.) et des liens vers Wikipedia pour renforcer l'ancrage Knowledge Graph "
                 "dans les jeux de donnees d'entrainement.",
    "sd_create": "Implementer un JSON-LD propre et complet (Organization, WebSite, WebPage) sur les pages strategiques. "
                 "Les donnees structurees sont le langage d'interoperabilite natif des LLMs.",
    "sd_extend": "Renforcer l'interoperabilite : utiliser la propriete sameAs pour lier le site aux profils officiels "
                 "(Wikidata, Wikipedia, reseaux sociaux) et diversifier les types Schema.org (FAQPage, HowTo, Product) "
                 "sur les pages idoines.",
    "citation": "Renforcer l'autorite de citation : creer/enrichir la page Wikipedia, "
                "multiplier les citations dans des sources de reference (medias, organismes officiels) "
                "et maintenir une presence active sur les reseaux sociaux relies au site officiel.",
    "semantic": "Augmenter la densite vectorielle : clarifier la proposition de valeur, "
                "structurer les pages autour de blocs d'information factuels (qui, quoi, ou, preuves, donnees chiffrées) "
                "et injecter des exemples concrets pour faciliter l'encodage en embeddings utiles au RAG.",
    "freshness": "Publier du contenu frais regulierement, mettre a jour les pages existantes et exposer les dates "
                 "de mise a jour via sitemap.xml (lastmod). Des contenus recents sont sur-representees dans les "
                 "datasets recents et les index RAG.",
}


# Letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"


def kg_pillar(features: DataFrame) -> DataFrame:
    """Add ``score`` to knowledge-graph features: 0 without an identifier, 5 without data."""
    points = (F.col("nb_properties") * 2 + F.when(F.col("has_wikipedia"), 20).otherwise(0) + F.col("nb_references") * 5
              + F.col("nb_external_ids") * 2)
    score = F.when(F.col("qid").isNull() | (F.col("qid") == ""), 0).when(~F.col("has_data"), 5).otherwise(F.least(F.lit(100), points))
    return features.withColumn("score", score)


def sd_pillar(footprint: DataFrame) -> DataFrame:
    """Add ``score`` to a site's structured-data footprint."""
    points = (F.col("pages_with_jsonld") * 2 + F.col("nb_types") * 8 + F.when(F.col("has_organization"), 40).otherwise(0)
              + F.when(F.col("same_as_count") > 0, 10).otherwise(0))
    return footprint.withColumn("score", F.least(F.lit(100), points))


def citation_score(references: Column, trust: Column, platforms: Column) -> Column:
    return F.least(F.lit(100), F.least(F.lit(40), references * 10) + F.least(F.lit(40), trust) + F.least(F.lit(20), platforms * 5))


def citation_pillar(homes: DataFrame, references: DataFrame) -> DataFrame:
    """(site, trust_signals, platforms, references, score) of home pages (site, html) and counts (site, references)."""
    social = H.social_presence(F.col("html"))
    h = homes.select("site", H.trust_signals(F.col("html")).alias("trust_signals"), social.alias("_s"))
    platforms = sum((F.when(F.col(f"_s.{p}"), 1).otherwise(0) for p in H.SOCIAL_PLATFORMS[1:]),
                    F.when(F.col(f"_s.{H.SOCIAL_PLATFORMS[0]}"), 1).otherwise(0))
    j = h.join(references, "site", "left").select("site", "trust_signals", platforms.alias("platforms"),
                                                  F.coalesce("references", F.lit(0)).alias("references"))
    return j.withColumn("score", citation_score(F.col("references"), F.col("trust_signals"), F.col("platforms")))


def similarity_to_score(similarity: Column) -> Column:
    """Four straight pieces from similarity 0..1 to score 0..100."""
    s = F.greatest(F.lit(0.0), F.least(similarity, F.lit(1.0)))
    return (F.when(s <= 0.3, s / F.lit(0.3) * 40.0).when(s <= 0.6, F.lit(40.0) + (s - 0.3) / F.lit(0.3) * 30.0)
            .when(s <= 0.85, F.lit(70.0) + (s - 0.6) / F.lit(0.25) * 20.0).otherwise(F.lit(90.0) + (s - 0.85) / F.lit(0.15) * 10.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def mean_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Mean vector per key. Components are averaged as rows, so partial sums combine before the shuffle."""
    parts = vectors.select(key, F.posexplode(column).alias("_i", "_x"))
    means = parts.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    # One row per vector component: bounded by the dimension.
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(column))


def semantic_pillar_vec(pairs: DataFrame, site_vec: str, target_vec: str) -> DataFrame:
    """Add cosine ``similarity`` (4 places) and ``score`` of a site vector and its target vector."""
    a, b = F.col(site_vec), F.col(target_vec)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    sim = F.when(norms > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))
    return (pairs.withColumn("_sim", sim).withColumn("score", round_to(similarity_to_score(F.col("_sim")), 1))
            .withColumn("similarity", round_to("_sim", 4)).drop("_sim"))


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def lexical_overlap(text: Column, target: Column) -> Column:
    """Share of the target's words that occur in the text, and the score of that share."""
    t, s = words(target), words(text)
    sim = F.when((F.size(t) == 0) | (F.size(s) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(s, t)) / F.size(t))
    return F.struct(round_to(sim, 4).alias("similarity"), round_to(sim * 100, 1).alias("score"))


def site_text(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Text of the first pages of every site and its number of words.

    The pages are chosen on (site, page_id) alone; only chosen ones are read for their text, and html is not shuffled.
    """
    ids = pages.select("page_id", host(F.col("url")).alias("site"))
    chosen = top_k(ids, ["site"], [F.col("page_id")], limit)
    texts = pick_rows(chosen, pages.select("page_id", "html"), "page_id", {"t": H.visible_text(F.col("html"))})
    # At most ``limit`` texts per site.
    joined = texts.filter("t <> ''").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", "t"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["t"]), " ")
    return joined.select("site", text.alias("text")).withColumn("site_tokens", F.regexp_count("text", F.lit(WORD)).cast("long"))


def freshness_pillar(dates: DataFrame, as_of, limit: int | None = 50) -> DataFrame:
    """Per site: dated pages, mean age, last publication and score, from (site, ord, lastmod).

    The first ``limit`` readable dates count, as in a sitemap read; ``None`` takes all.
    """
    now = D.as_moment(as_of)
    d = dates.select("site", "ord", D.lastmod_date(F.col("lastmod")).alias("d")).filter("d IS NOT NULL")
    if limit is not None:
        d = top_k(d, ["site"], [F.col("ord")], limit)
    age = F.when(F.col("d") < now, D.days_between(F.col("d"), now))
    a = d.groupBy("site").agg(F.count("*").alias("pages_with_dates"), F.avg(age).alias("_avg"), F.max("d").alias("_last"))
    known = F.col("_avg").isNotNull()
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.col("_avg") / 10))
    return a.select("site", "pages_with_dates", round_to("_avg", 1).alias("avg_age_days"),
                    F.when(known, F.date_format("_last", "yyyy-MM-dd")).alias("last_publication"),
                    F.when(known, round_to(score, 1)).otherwise(F.lit(0.0)).alias("score"))


def authority_index(entities: DataFrame, pillars: dict[str, DataFrame], key: str = "entity") -> DataFrame:
    """Join the pillar scores (key, score) of every entity; a missing pillar counts 0."""
    out = entities
    for name, _, _ in PILLARS:
        if name in pillars:
            out = out.join(pillars[name].select(key, F.col("score").cast("double").alias(name)), key, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("double"))
    out = out.fillna(0.0, [n for n, _, _ in PILLARS])
    first, *rest = [F.col(n) * F.lit(w) for n, w, _ in PILLARS]
    out = out.withColumn("overall_score", round_to(sum(rest, first), 1))
    return out.withColumn("interpretation", interpretation(F.col("overall_score")))


def interpretation(score: Column) -> Column:
    out = F.lit("")
    for low, text in reversed(BANDS):
        out = F.when(score >= low, text).otherwise(out)
    return out


def authority_recos(index: DataFrame, key: str = "entity") -> DataFrame:
    """Advice for the three weakest pillars, those already at 80 left out: (entity, rank, pillar, score, advice)."""
    slots = F.array(*[F.struct(F.col(n).alias("score"), F.lit(i).alias("no"), F.lit(n).alias("pillar"), F.lit(label).alias("name"))
                      for i, (n, _, label) in enumerate(PILLARS)])
    weakest = index.select(key, F.posexplode(F.slice(F.array_sort(slots), 1, 3)).alias("rank", "p")).filter("p.score < 80")
    t = RECO_TEXTS
    score, pillar = F.col("p.score"), F.col("p.pillar")
    before, after = t["kg_create"].split("{entity}")
    create = F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after))
    advice = (F.when(pillar == "knowledge_graph", F.when(score == 0, create).otherwise(F.lit(t["kg_enrich"])))
              .when(pillar == "structured_data", F.when(score < 30, t["sd_create"]).otherwise(t["sd_extend"]))
              .when(pillar == "citation_authority", t["citation"]).when(pillar == "semantic_completeness", t["semantic"])
              .otherwise(t["freshness"]))
    return weakest.select(key, (F.col("rank") + 1).alias("rank"), F.col("p.name").alias("pillar"), score.alias("score"), advice.alias("advice"))


def rank_entities(index: DataFrame, group: str) -> DataFrame:
    """Rank within a group of competitors, equal scores sharing a rank.

    Scores have one decimal between 0 and 100, so a group is ranked from its at most 1,001 distinct
    scores and never gathered whole.
    """
    per_score = index.groupBy(group, "overall_score").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(group).orderBy(F.desc("overall_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_score.withColumn("rank", F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).drop("_n")
    return index.join(ranks, [group, "overall_score"])
