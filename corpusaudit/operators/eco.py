"""Token weight of pages and what an extract of their core content saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.numbers import round_to
from ..functions.text import let, squeeze

# Energy per thousand tokens (kWh) and carbon intensity (gCO2 per kWh).
KWH_PER_1K_TOKENS = 0.0004
GCO2_PER_KWH = 475

# Days elapsed at the end of each month of a common year.
DAYS_CUMULATED = [31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365]

# Letters in runs, digits in groups of up to three, other signs in runs: where a byte-pair
# tokenizer would first split. Counts compare pages with each other.
PRE_TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PRE_TOKEN)).cast("long")


def dirty_text(html: Column) -> Column:
    """All visible text of a page, menus and footers included."""
    return H.visible_text(html, H.ECO_TAGS)


def clean_text(html: Column) -> Column:
    """Title, h1 and main content, then a stand-in for structured data: the first tenth, at least 100 characters.

    Scripts are gone before JSON-LD would be looked up, so the stand-in is always used.
    """
    clean = H.drop_elements(html, H.ECO_TAGS)
    head = H.text_of(H.element(clean, "title"))
    h1 = squeeze(H.decode_entities(F.regexp_replace(H.element(clean, "h1"), H.TAG, " ")))
    blank = lambda c: F.nullif(c, F.lit(""))
    parts = F.concat_ws(" ", blank(head), blank(h1), blank(H.main_content(html)))
    tenth = lambda p: F.substring(p, F.lit(1), F.greatest(F.lit(100), F.floor(F.length(p) / 10).cast("int")))
    return squeeze(let(parts, lambda p: F.when(p == "", p).otherwise(F.concat(p, F.lit(" "), tenth(p)))))


def page_tokens(pages: DataFrame) -> DataFrame:
    """Add ``tokens_dirty`` and ``tokens_clean``."""
    return (pages.withColumn("tokens_dirty", token_count(dirty_text(F.col("html"))))
            .withColumn("tokens_clean", token_count(clean_text(F.col("html")))))


def savings(tokens: DataFrame) -> DataFrame:
    """Add saved tokens, energy and carbon per page view; exact values next to rounded ones."""
    saved = F.greatest(F.lit(0), F.col("tokens_dirty") - F.col("tokens_clean"))
    df = tokens.withColumn("tokens_saved", saved)
    df = df.withColumn("kwh_exact", F.col("tokens_saved") / F.lit(1000.0) * F.lit(KWH_PER_1K_TOKENS))
    df = df.withColumn("co2_exact", F.col("kwh_exact") * F.lit(GCO2_PER_KWH))
    return df.withColumn("kwh_saved", round_to("kwh_exact", 6)).withColumn("co2_saved", round_to("co2_exact", 2))


def annualize(saved: DataFrame, total_pages: int = 1000, daily_views: int = 100) -> DataFrame:
    """Yearly totals of every page's savings, extrapolated to a site of ``total_pages``."""
    year = total_pages * daily_views * 365
    return (saved.withColumn("annual_tokens_saved", F.col("tokens_saved") * year)
            .withColumn("annual_kwh_saved", round_to(F.col("kwh_exact") * year, 2))
            .withColumn("annual_co2_grammes", round_to(F.col("co2_exact") * year, 2)))


def corpus_savings(saved: DataFrame, daily_views: int = 100, site: str | None = None) -> DataFrame:
    """Yearly totals summed over the pages there are, for the corpus or per site."""
    year = daily_views * 365
    keys = [site] if site else []
    tokens = F.sum("tokens_saved")
    return saved.groupBy(*keys).agg(
        F.count("*").alias("pages"), tokens.alias("tokens_saved"), (tokens * year).alias("annual_tokens_saved"),
        round_to(tokens / F.lit(1000.0) * KWH_PER_1K_TOKENS * year, 2).alias("annual_kwh_saved"),
        round_to(tokens / F.lit(1000.0) * KWH_PER_1K_TOKENS * GCO2_PER_KWH * year, 2).alias("annual_co2_grammes"))


def monthly_projection(saved: DataFrame, total_pages: int = 1000, daily_views: int = 100) -> DataFrame:
    """Cumulated savings at the end of each month, and yearly tonnes, MWh and flights from the rounded values."""
    day = F.lit(total_pages * daily_views)
    months = F.array(*[F.struct(F.lit(i + 1).alias("month"), F.lit(d).alias("days")) for i, d in enumerate(DAYS_CUMULATED)])
    tonnes = F.col("co2_saved") * day * 365 / F.lit(1000000.0)
    rows = (saved.withColumn("annual_co2_tonnes", round_to(tonnes, 2)).withColumn("flights", round_to(tonnes, 1))
            .withColumn("annual_mwh", round_to(F.col("kwh_saved") * day * 365 / F.lit(1000.0), 2))
            .withColumn("_m", F.explode(months)))
    by_day = lambda c: F.col(c) * day * F.col("_m.days")
    return (rows.withColumn("month", F.col("_m.month")).withColumn("cumul_tokens", by_day("tokens_saved"))
            .withColumn("cumul_kwh", round_to(by_day("kwh_saved"), 2)).withColumn("cumul_gco2", round_to(by_day("co2_saved"), 2))
            .drop("_m"))
