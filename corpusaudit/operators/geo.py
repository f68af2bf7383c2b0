"""Readability score of a page for answer engines: eight criteria, total, grade and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions.numbers import round_to
from ..functions.text import contains_any, falsy, let, word_count
from .jsonld import EXACT_BLOCK, schema_hits

# Words that call to action in a description.
ACTION_WORDS = ["découvrez", "apprenez", "comprenez", "guide", "comment", "pourquoi"]

# Patterns of persons, organisations, places, dates and numbers.
ENTITY_PATTERNS = [
    r"\b(?:M\.|Mme|Dr|Professor|CEO)\s+[A-Z][a-z]+",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:SA|SARL|Ltd|Inc|Corp|GmbH)\b",
    r"\b(?:Paris|Lyon|Marseille|Londres|New York|Tokyo|Berlin)\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre"
    r"|novembre|décembre)\s+\d{4}\b",
    r"(?i)\b\d+%|\b\d+\s+(?:millions?|milliards?|personnes?|utilisateurs?|clients?)\b",
]

# Grades and the lowest total of each.
GRADES = [("A+", 90), ("A", 80), ("B", 70), ("C", 60), ("D", 50)]

CRITERIA = ["meta_description", "h1_quality", "response_time", "structured_data", "semantic_structure", "content_depth",
            "entity_richness", "freshness"]


def _reco(priority: str, category: str, issue, action: str) -> Column:
    issue = issue if isinstance(issue, Column) else F.lit(issue)
    return F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), issue.alias("issue"),
                    F.lit(action).alias("action"))


def _result(points: Column, *recos: Column) -> Column:
    return F.struct(points.cast("int").alias("points"), F.array_compact(F.array(*recos)).alias("recos"))


def _steps(value: Column, *steps) -> Column:
    """Points of the first threshold reached, from the highest down; 0 below all."""
    out = F.lit(0)
    for low, points in reversed(steps):
        out = F.when(value >= low, points).otherwise(out)
    return out


# The categories, issues and actions that the criteria below recommend, and the bounds of their points.


def score_meta_description(description: Column) -> Column:
    d = F.coalesce(description, F.lit(""))
    n = F.length(d)
    best, near = n.between(120, 160), n.between(100, 119) | n.between(161, 200)
    words = F.array_remove(F.split(F.lower(F.trim(d)), r"[\s\x{A0}]+"), "")
    varied = F.coalesce(F.size(F.array_distinct(words)) / F.nullif(F.size(words), F.lit(0)) > 0.7, F.lit(False))
    points = F.when(best, 10).when(near, 7).otherwise(3) + F.when(contains_any(F.lower(d), ACTION_WORDS), 3).otherwise(0) \
        + F.when(varied, 2).otherwise(0)
    size = F.concat(F.lit("("), n.cast("string"), F.lit(" caractères)"))
    some = n > 0
    return _result(
        F.when(some, points).otherwise(0),
        F.when(~some, _reco("HIGH", "Meta Description", "Aucune meta description",
                            "Ajouter une description de 120-160 caractères résumant le contenu")),
        F.when(some & near, _reco("MEDIUM", "Meta Description", F.concat(F.lit("Longueur sous-optimale "), size),
                                  "Viser 120-160 caractères pour un affichage optimal")),
        F.when(some & ~best & ~near, _reco("HIGH", "Meta Description", F.concat(F.lit("Longueur inappropriée "), size),
                                           "Réécrire entre 120-160 caractères")),
        F.when(some & ~varied, _reco("LOW", "Meta Description", "Trop de répétitions de mots",
                                     "Varier le vocabulaire pour paraître plus naturel")))


def score_h1(h1: Column) -> Column:
    t = F.coalesce(h1, F.lit(""))
    n = F.length(t)
    points = F.lit(5) + F.when(n.between(40, 70), 3).when(n < 40, 1).otherwise(2) + F.when(t.contains("?"), 2).otherwise(0)
    return _result(
        F.when(n > 0, points).otherwise(0),
        F.when(n == 0, _reco("HIGH", "Structure HTML", "Pas de balise H1",
                             "Ajouter un H1 clair et descriptif (40-70 caractères)")),
        F.when((n > 0) & (n < 40), _reco("MEDIUM", "H1", "H1 trop court",
                                         "Allonger le H1 à 40-70 caractères pour plus de contexte")),
        F.when(n > 70, _reco("LOW", "H1", "H1 trop long", "Raccourcir le H1 pour plus d'impact")))


def score_response_time(seconds: Column, unknown: int = 10) -> Column:
    """``unknown`` points where the time was not measured; the crawler counts that as 0 seconds."""
    points = F.when(seconds.isNull(), unknown).when(seconds < 0.5, 10).when(seconds < 1, 7).when(seconds < 2, 4).otherwise(1)
    shown = lambda label: F.concat(F.lit(label + " ("), F.format_string("%.2f", round_to(seconds, 2)), F.lit("s)"))
    return _result(
        points,
        F.when((seconds >= 1) & (seconds < 2), _reco("MEDIUM", "Performance", shown("Temps de réponse lent"),
                                                     "Optimiser les images, activer la compression, utiliser un CDN")),
        F.when(seconds >= 2, _reco("HIGH", "Performance", shown("Temps de réponse très lent"),
                                   "Audit technique urgent : serveur, cache, optimisation assets")))


def score_structured_data(html: Column) -> Column:
    h = F.coalesce(html, F.lit(""))
    blocks = F.regexp_extract_all(h, F.lit(EXACT_BLOCK), F.lit(1))
    hits = lambda bs: F.struct(F.size(bs).alias("blocks"), F.flatten(F.transform(bs, schema_hits)).alias("types"))

    def facts(x: Column) -> Column:
        rich = F.array_contains(x["types"], "FAQPage") | F.array_contains(x["types"], "HowTo")
        return F.struct((x["blocks"] > 0).alias("found"), rich.alias("rich"), (F.size(x["types"]) >= 2).alias("several"))

    def rate(x: Column) -> Column:
        points = F.lit(8) + F.when(x["rich"], 5).when(x["several"], 3).otherwise(2)
        return _result(
            F.when(x["found"], points).otherwise(0),
            F.when(h == "", _reco("INFO", "Données Structurées", "HTML non disponible pour analyse",
                                  "Activer la capture HTML dans le scraper pour analyse complète")),
            F.when((h != "") & ~x["found"], _reco("HIGH", "Données Structurées", "Aucune donnée structurée JSON-LD",
                                                  "Ajouter au minimum Organization, Article ou WebPage schema")),
            F.when(x["found"] & ~x["rich"] & ~x["several"], _reco("MEDIUM", "Données Structurées", "Schema basique seulement",
                                                                  "Ajouter FAQPage ou HowTo pour maximiser les citations LLM")))

    return let(let(let(blocks, hits), facts), rate)


def score_semantic_structure(html: Column, clean: Column, tags: Column, h1: Column) -> Column:
    some = F.coalesce(html, F.lit("")) != ""
    n = lambda *names: H.count_tags(tags, *names)
    found = F.struct(n("h2").alias("h2"), n("ul", "ol").alias("lists"), n("table").alias("tables"), n("strong", "b").alias("strong"),
                     n("dt", "dd", "blockquote").alias("definitions"), clean.rlike(H.BREADCRUMB).alias("breadcrumb"))
    cat = "Structure Sémantique"

    def rate(x: Column) -> Column:
        points = (_steps(x["h2"], (3, 5), (1, 3)) + _steps(x["lists"], (3, 5), (1, 3)) + _steps(x["tables"], (1, 3))
                  + _steps(x["strong"], (5, 2)) + _steps(x["definitions"], (1, 2)) + F.when(x["breadcrumb"], 3).otherwise(0))
        return _result(
            F.when(some, points).when(~falsy(h1), 5).otherwise(0),
            F.when(~some, _reco("INFO", cat, "HTML non disponible pour analyse détaillée",
                                "Activer la capture HTML dans le scraper pour scoring complet")),
            F.when(some & x["h2"].between(1, 2), _reco("MEDIUM", cat, "Peu de sous-titres H2",
                                                       "Ajouter plus de H2 pour structurer le contenu (min 3)")),
            F.when(some & (x["h2"] == 0), _reco("HIGH", cat, "Aucun sous-titre H2", "Structurer le contenu avec des H2 clairs")),
            F.when(some & x["lists"].between(1, 2), _reco("MEDIUM", cat, "Peu de listes",
                                                          "Convertir des paragraphes en listes pour faciliter l'extraction")),
            F.when(some & (x["lists"] == 0), _reco("HIGH", cat, "Aucune liste",
                                                   "Ajouter des listes à puces ou numérotées (très important pour GEO)")))

    return let(found, rate)


def score_content_depth(html: Column, words: Column, paragraphs: Column, links: Column) -> Column:
    some = F.coalesce(html, F.lit("")) != ""
    points = _steps(words, (1500, 8), (800, 6), (300, 3)) + _steps(paragraphs, (5, 4), (3, 2)) + _steps(links, (3, 3), (1, 1))
    return _result(
        F.when(some, points).otherwise(0),
        F.when(some & words.between(800, 1499), _reco("LOW", "Contenu", "Contenu moyen",
                                                      "Enrichir le contenu à 1500+ mots pour plus d'autorité")),
        F.when(some & words.between(300, 799), _reco("MEDIUM", "Contenu", "Contenu léger",
                                                     "Développer le contenu à 800+ mots minimum")),
        F.when(some & (words < 300), _reco("HIGH", "Contenu", "Contenu insuffisant",
                                           "Créer un contenu substantiel (minimum 500 mots)")),
        F.when(some & (links == 0), _reco("MEDIUM", "Contenu", "Pas de liens externes",
                                          "Citer des sources autoritaires (études, stats, références)")))


# A run of capitalised words with a company form in capitals after it. Possessive repeats make the match a loop.
NAME_RUN = r"(?U)\b[A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)*+(?:\s++(?:SA|SARL|GmbH)\b)?+"
COMPANY_FORM = r"(?U)\s(?:SA|SARL|Ltd|Inc|Corp|GmbH)\b"


def entity_count(text: Column) -> Column:
    """Matches of the five entity patterns; word boundaries follow Unicode letters.

    Organisations are counted by runs of capitalised words: a greedy match of the second pattern ends at the last
    company form of its run, so a run holds one match or none.
    """
    found = [F.regexp_count(text, F.lit("(?U)" + p)) for k, p in enumerate(ENTITY_PATTERNS) if k != 1]
    companies = F.size(F.filter(F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(0)), lambda run: run.rlike(COMPANY_FORM)))
    return sum(found, companies)


def score_entity_richness(text: Column) -> Column:
    return let(entity_count(text), lambda n: _result(
        _steps(n, (10, 10), (5, 7), (2, 4)),
        F.when(n.between(2, 4), _reco("MEDIUM", "Entités", "Peu d'entités détectées",
                                      "Ajouter des noms propres, chiffres clés, dates, lieux pour plus de contexte")),
        F.when(n < 2, _reco("HIGH", "Entités", "Manque d'entités",
                            "Enrichir avec des données factuelles : stats, noms, dates, lieux"))))


def score_freshness(last_modified: Column, as_of) -> Column:
    return let(D.days_between(D.page_date(last_modified), D.as_moment(as_of)), lambda age: _result(
        F.when(age <= 90, 5).when(age <= 180, 3).when(age <= 365, 2).otherwise(0),
        F.when(falsy(last_modified), _reco("LOW", "Fraîcheur", "Date de modification inconnue",
                                           'Ajouter balise <meta property="article:modified_time">')),
        F.when(age.between(181, 365), _reco("LOW", "Fraîcheur", "Contenu de plus de 6 mois",
                                            "Mettre à jour le contenu avec des informations récentes")),
        F.when(age > 365, _reco("MEDIUM", "Fraîcheur", F.concat(F.lit("Contenu ancien ("), age.cast("string"), F.lit(" jours)")),
                                "Révision complète nécessaire pour rester pertinent"))))


def grade(total: Column) -> Column:
    out = F.lit("F")
    for name, low in reversed(GRADES):
        out = F.when(total >= low, name).otherwise(out)
    return out


def severity(score: Column) -> Column:
    return F.when(score >= 95, "OPTIMISE").when(score >= 50, "NON OPTIMISE").otherwise("CRITIQUE")


def grade_color(g: Column) -> Column:
    return F.when(g.isin("A+", "A"), "#10b981").when(g.isin("B", "C"), "#FFA500").otherwise("#FF4B4B")


def geo_score(pages: DataFrame, as_of, unknown_time: int = 10) -> DataFrame:
    """Score every page: (page_id, url, total_score, breakdown, grade, recommendations).

    ``pages`` has page_id, url, html, response_time and last_modified. Title, h1 and description are read from the same
    cleaned HTML where ``pages`` doesn't have them. It is one chain of projections without a shuffle. Cleaned HTML, chrome-free HTML and tag lists
    are columns of their own, so each is computed once per page, not once per criterion.
    """
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    cleaned = pages.withColumn("_clean", H.drop_elements(c("html")))
    for name, value in H.heads(c("_clean"), c("url")).items():
        cleaned = cleaned.withColumn(name, F.coalesce(c(name), value) if name in pages.columns else value)
    staged = (cleaned
              .withColumn("_tags", H.tag_names(c("_clean")))
              .withColumn("_body", H.drop_elements(c("html"), H.CHROME_TAGS))
              .withColumn("_words", word_count(H.decode_entities(F.regexp_replace("_body", H.TAG, " "))))
              .withColumn("_paragraphs", H.count_tags(H.tag_names(c("_body")), "p"))
              .withColumn("_links", H.external_links(c("_body"), c("url")))
              .withColumn("_text", F.concat_ws(" ", text("title"), text("description"), text("html"))))
    scored = staged.select(
        "page_id", "url",
        score_meta_description(c("description")).alias("meta_description"),
        score_h1(c("h1")).alias("h1_quality"),
        score_response_time(c("response_time"), unknown_time).alias("response_time"),
        score_structured_data(c("html")).alias("structured_data"),
        score_semantic_structure(c("html"), c("_clean"), c("_tags"), c("h1")).alias("semantic_structure"),
        score_content_depth(c("html"), c("_words"), c("_paragraphs"), c("_links")).alias("content_depth"),
        score_entity_richness(c("_text")).alias("entity_richness"),
        score_freshness(c("last_modified"), as_of).alias("freshness"))
    total = sum((c(f"{k}.points") for k in CRITERIA[1:]), c(f"{CRITERIA[0]}.points"))
    totalled = scored.select(
        "page_id", "url", total.alias("total_score"),
        F.struct(*[c(f"{k}.points").alias(k) for k in CRITERIA]).alias("breakdown"),
        F.concat(*[c(f"{k}.recos") for k in CRITERIA]).alias("recommendations"))
    return totalled.withColumn("grade", grade(c("total_score")))


def site_scores(scores: DataFrame) -> DataFrame:
    """Per site: pages, mean score and pages per grade."""
    from ..functions.urls import host
    s = scores.select(host(F.col("url")).alias("site"), "total_score", "grade")
    return s.groupBy("site").agg(F.count("*").alias("pages"), F.round(F.avg("total_score"), 2).alias("avg_score"),
                                 *[F.count_if(F.col("grade") == g).alias("grade_" + g.lower().replace("+", "_plus"))
                                   for g in [*(n for n, _ in GRADES), "F"]])
