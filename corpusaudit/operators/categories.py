"""Page categories from url and headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import contains_any, let, text_or, title_case
from ..plans.shapes import top_k, with_group_size
from .links import path_title

# Categories and the substrings that select them, in test order.
CATEGORIES = {
    "Offres d'emploi": ["metier", "emploi", "offre", "recrutement", "carriere", "poste", "job", "candidat", "postuler"],
    "Temoignages": ["temoignage", "portrait", "parcours", "interview", "histoire", "vecu", "retour-experience"],
    "Actualites": ["actualite", "actu", "news", "blog", "article", "presse", "communique", "evenement"],
    "Formation": ["formation", "ecole", "cursus", "diplome", "stage", "apprentissage", "etude"],
    "Presentation": ["decouvrir", "qui-sommes", "a-propos", "about", "presentation", "mission", "valeur"],
    "FAQ / Aide": ["faq", "aide", "question", "contact", "support", "assistance"],
    "Legal": ["mention", "legal", "cgu", "cgv", "confidentialite", "cookie", "politique", "condition", "rgpd"],
    "Medias": ["media", "video", "photo", "galerie", "image", "reportage", "documentaire"],
    "Espace candidat": ["espace", "compte", "profil", "inscription", "connexion", "login", "dashboard"],
}


def categorize(facts: DataFrame) -> DataFrame:
    """Add ``category``: the first keyword list that matches, else the first path segment, else static pages."""
    c = F.col
    path = F.lower(U.path(c("url")))
    text = F.concat_ws(" ", path, F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("h1", F.lit(""))))
    segs = F.filter(U.path_segments(path), lambda s: ~s.isin([*U.LANGUAGES, "www"]))
    first = title_case(F.translate(F.get(segs, F.lit(0)), "-_", "  "))
    listed = let(text, lambda t: F.coalesce(*[F.when(contains_any(t, words), F.lit(name)) for name, words in CATEGORIES.items()]))
    return facts.withColumn("category", F.coalesce(listed, first, F.lit("Pages statiques")))


def pattern_groups(facts: DataFrame, samples: int = 50) -> DataFrame:
    """Pages per url group with their first urls: (site, group, count, samples)."""
    g = facts.select("site", "page_id", "url", U.pattern_group(F.col("url")).alias("group"))
    counts = g.groupBy("site", "group").agg(F.count("*").alias("count"))
    first = top_k(g, ["site", "group"], [F.col("page_id")], samples)
    listed = first.groupBy("site", "group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda s: s["url"]).alias("samples"))
    return counts.join(listed, ["site", "group"])


def crawl_journal(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages of every site by category, its largest category first, with grade, shown title and path."""
    named = categorize(facts).withColumn("shown_title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), path_title(F.col("url"))))
    sized = with_group_size(named, ["site", "category"], "category_size")
    return (sized.join(scores.select("page_id", "grade"), "page_id", "left")
            .select("site", "category", "category_size", "page_id", "grade", "shown_title", text_or(U.path(F.col("url")), "/").alias("path"))
            .orderBy("site", F.desc("category_size"), "category", "page_id"))
