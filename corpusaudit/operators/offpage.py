"""Mentions of a brand outside its site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shapes import checkpoint, top_k

# Sources in declaration order with label and priority.
SOURCES = [
    ("reddit.com", "REDDIT", 1),
    ("quora.com", "QUORA", 2),
    ("wikipedia.org", "WIKIPEDIA", 1),
    ("linkedin.com", "LINKEDIN", 2),
    ("medium.com", "MEDIUM", 3),
    ("trustpilot.com", "TRUSTPILOT", 1),
    ("youtube.com", "YOUTUBE", 1),
    ("twitter.com", "X (TWITTER)", 2),
    ("github.com", "GITHUB", 3),
    ("stackoverflow.com", "STACKOVERFLOW", 3),
]

# Sources scanned and mentions kept per source, by mode.
MODES = {"fast": (6, 2), "balanced": (8, 3), "safe": (10, 3)}

# Letters of a gram, and of the ends of words beside a space, that concepts are filed under; concepts of a brand without a space that are tested on every text; texts of a brand in a piece.
GRAM, EDGE, FEW, PIECE = 8, 16, 16, 1000
MOST_PARTS = 16


def source_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "ord int, domain_key string, label string, priority int")


def select_sources(sources: DataFrame, mode: str = "balanced") -> DataFrame:
    """Sources scanned in a mode, by priority, in declaration order on ties."""
    n = MODES.get(mode, MODES["balanced"])[0]
    return sources.orderBy("priority", "ord").limit(n)


def top_mentions(mentions: DataFrame, mode: str = "balanced") -> DataFrame:
    """First mentions of every brand and source."""
    k = MODES.get(mode, MODES["balanced"])[1]
    return top_k(mentions, ["brand", "domain_key"], [F.col("mention_id")], k, "position")


def mention_counts(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Mentions per source, sources without any included."""
    n = mentions.groupBy("domain_key").agg(F.count("*").alias("n"))
    return sources.join(n, "domain_key", "left").select("domain_key", F.coalesce("n", F.lit(0)).alias("mentions"))


def mention_kpis(mentions: DataFrame) -> DataFrame:
    """Per brand: mentions and distinct sources, from one row per brand and source."""
    per = mentions.groupBy("brand", "domain_key").agg(F.count("*").alias("n"))
    return per.groupBy("brand").agg(F.sum("n").alias("mentions"), F.count("*").alias("sources"))


def third_part(url: Column) -> Column:
    """Host of an address: the third part between slashes, the whole if there is none."""
    return F.coalesce(F.get(F.split(url, "/"), F.lit(2)), url)


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters without a space, overlapping; none of a shorter text. One scan of the text: its characters have no index."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=([^ ]{{{n}}}))."), F.lit(1))


def _filed(concepts: DataFrame) -> DataFrame:
    """(cid, brand, concept, _needle, _rest, _key, _next, _long): every concept under one key, of several the one that fewest concepts of its brand share.

    A concept with a space is filed under the ends of the words beside one of its spaces, up to ``EDGE`` letters each; where they are all of it, ``_rest`` is null. One without a space lies
    inside a word of a text; ``_long`` is its length, ``_next`` is null and its key a gram of up to ``GRAM`` letters, or empty where its brand has few with so short a gram.
    """
    c = concepts.select("brand", "concept", F.lower("concept").alias("_needle")).filter("_needle <> ''").distinct().withColumn("cid", F.monotonically_increasing_id())
    c = checkpoint(c.withColumn("_words", F.split("_needle", " ")))
    spaced, place = c.filter(F.size("_words") > 1), F.col("_place")
    spaced = spaced.withColumn("_place", F.explode(F.sequence(F.lit(0), F.size("_words") - 2))).select(
        "cid", "brand", "concept", "_needle", F.right(F.get("_words", place), F.lit(EDGE)).alias("_key"), F.left(F.get("_words", place + 1), F.lit(EDGE)).alias("_next"), F.lit(None).cast("int").alias("_long"))
    single = c.filter(F.size("_words") == 1).withColumn("_long", F.length("_needle")).withColumn("_size", F.least("_long", F.lit(GRAM)))
    several = single.groupBy("brand", "_size").agg((F.count("*") > FEW).alias("_several"))
    grams = F.when(F.col("_several"), F.array_distinct(F.when(F.col("_long") <= GRAM, F.array("_needle")).otherwise(_grams(F.col("_needle"), GRAM)))).otherwise(F.array(F.lit("")))
    single = single.join(several, ["brand", "_size"]).select("cid", "brand", "concept", "_needle", F.explode(grams).alias("_key"), F.lit(None).cast("string").alias("_next"), "_long")
    keyed = spaced.unionByName(single)
    shared = keyed.groupBy("brand", "_key", "_next").agg(F.countDistinct("cid").alias("_shared"))
    met = keyed.join(shared, keyed["brand"].eqNullSafe(shared["brand"]) & (keyed["_key"] == shared["_key"]) & keyed["_next"].eqNullSafe(shared["_next"])).select(keyed["*"], "_shared")
    one = met.groupBy("cid", "brand", "concept", "_needle", "_long").agg(F.min_by(F.struct("_key", "_next"), F.struct("_shared", "_key", "_next")).alias("_at")).select(
        "cid", "brand", "concept", "_needle", "_at._key", "_at._next", "_long")
    whole = F.concat_ws(" ", "_key", "_next") == F.col("_needle")
    return checkpoint(one.withColumn("_rest", F.when(F.col("_next").isNull() | ~whole, F.col("_needle"))))


def _texts(filed: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """(brand, _piece, mention_id, _times, _t, _d, _words): texts of brands with concepts, dealt in pieces of a brand of about ``PIECE`` texts, so that matches are counted where they are found."""
    m = mentions.select("brand", "mention_id", F.lower(F.coalesce("title", F.lit(""))).alias("_t"), F.lower(F.coalesce("descr", F.lit(""))).alias("_d"))
    owners = checkpoint(filed.select("brand").distinct())
    m = m.join(F.broadcast(owners) if owners.count() <= most else owners, "brand", "left_semi")
    pieces = (m.groupBy("brand").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) // PIECE + 1
    # An id that several mentions have counts once for each pair of them.
    again = checkpoint(mentions.groupBy("mention_id").agg(F.count("*").cast("int").alias("_times")).filter("_times > 1"))
    m = m.filter("mention_id IS NOT NULL").join(F.broadcast(again) if again.count() <= most else again, "mention_id", "left")
    m = m.withColumn("_times", F.coalesce("_times", F.lit(1))).withColumn("_piece", F.hash("brand", F.pmod(F.xxhash64("mention_id", "_t"), F.lit(pieces))))
    return m.repartition("_piece")


def _met(rows: DataFrame, few: DataFrame, on: list[str], side) -> DataFrame:
    """``rows`` beside the rows of ``few`` with equal ``on``: joined by one hash, a number, several times as fast as by strings; the strings are compared after it, as no key of the join."""
    other = few.select(F.xxhash64(*on).alias("_hash"), *[F.col(k).alias(f"_{k}_met") for k in on], *[c for c in few.columns if c not in on])
    same = reduce(Column.__and__, [F.coalesce(F.col(k) == F.col(f"_{k}_met"), F.lit(False)) for k in on])
    return rows.withColumn("_hash", F.xxhash64(*on)).join(side(other), "_hash").filter(same).drop("_hash", *[f"_{k}_met" for k in on])


def _candidates(filed: DataFrame, texts: DataFrame, sizes: list[int], side) -> list[DataFrame]:
    """Texts beside the concepts that share a key with them, of concepts with a space and of those without. ``side`` gives a join's small side its hint."""
    words = F.concat(F.split("_t", " "), F.array(F.lit(None).cast("string")), F.split("_d", " "))
    split = texts.withColumn("_words", words)
    spaced = filed.filter("_next IS NOT NULL")
    firsts = spaced.groupBy("brand", "_key").agg(F.collect_set(F.length("_next")).alias("_ahead"))
    beside = split.select(*texts.columns, "_words", F.posexplode("_words").alias("_at", "_word")).withColumn("_after", F.get("_words", F.col("_at") + 1)).drop("_words", "_at")
    ends = beside.filter("_word IS NOT NULL AND _after IS NOT NULL").withColumn("_end", F.explode(F.sequence(F.lit(0), F.least(F.length("_word"), F.lit(EDGE)))))
    ends = _met(ends.withColumn("_key", F.right("_word", F.col("_end"))).drop("_word", "_end"), firsts, ["brand", "_key"], side)
    ends = ends.withColumn("_ahead", F.explode("_ahead")).filter(F.col("_ahead") <= F.length("_after")).withColumn("_next", F.left("_after", F.col("_ahead"))).drop("_after", "_ahead")
    ends = _met(ends, spaced.select("brand", "_key", "_next", "cid", "_rest"), ["brand", "_key", "_next"], side)
    single = filed.filter("_next IS NULL")
    # The shortest concept that is filed under grams of a size: shorter words hold none.
    least = single.groupBy("brand").agg(*[F.min(F.when(F.length("_key") == n, F.col("_long"))).alias(f"_least{n}") for n in sizes], F.lit("").alias("_none"))
    grams = [F.when(F.col(f"_least{n}").isNotNull(), _grams(F.array_join(F.filter("_words", lambda w: F.length(w) >= F.col(f"_least{n}")), " "), n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    inside = split.join(side(least), "brand").withColumn("_key", F.explode(F.array_distinct(F.concat(F.array("_none"), *grams)))).select(*texts.columns, "_key")
    return [ends, _met(inside, single.select("brand", "_key", "cid", "_rest"), ["brand", "_key"], side)]


def _found(filed: DataFrame, mentions: DataFrame, most: int) -> list[DataFrame]:
    """(_piece, cid, mention_id, _times), a row for every concept and text that holds it, without a shuffle of matches; together the tables hold every concept once."""
    # At most GRAM numbers: the lengths of grams in use.
    sizes = [r[0] for r in filed.filter("_next IS NULL AND _key <> ''").select(F.length("_key")).distinct().collect()]
    texts = _texts(filed, mentions, most)
    parts = -(-filed.count() // max(most, 1))
    hit = F.col("_rest").isNull() | F.col("_t").contains(F.col("_rest")) | F.col("_d").contains(F.col("_rest"))
    row = ["_piece", "_row", "mention_id", "_times"]
    if parts > min(most, MOST_PARTS):
        # Candidates are joined without their texts, which meet them again for the test.
        texts = texts.withColumn("_row", F.xxhash64("_t", "_d"))
        near = [x.select("mention_id", "_row", "cid", "_rest").distinct() for x in _candidates(filed.withColumn("_rest", F.col("_needle")), texts, sizes, lambda x: x)]
        return [texts.join(x, ["mention_id", "_row"]).filter(hit).select("_piece", "cid", "mention_id", "_times") for x in near]
    # A row's number is needed in the task that reads it only, to count a concept once in it.
    texts = texts.withColumn("_row", F.monotonically_increasing_id())
    part = lambda i: filed if parts <= 1 else filed.filter(F.pmod(F.xxhash64("cid"), F.lit(parts)) == i)
    near = [x for i in range(max(parts, 1)) for x in _candidates(part(i), texts, sizes, F.broadcast)]
    return [x.filter(hit).select(*row, "cid").distinct().select("_piece", "cid", "mention_id", "_times") for x in near]


def matches(concepts: DataFrame, mentions: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(brand, concept, mention_id): concepts found, whatever the case, in title or description.

    Texts are cut at spaces. A concept with a space stands across the space between two words: the first ends with what the concept has before it, the second begins with what comes after.
    Ends of words are looked up first, then beginnings of the next word, of lengths that some concept has there; what both are met by is found, without a look at the text. A concept
    without a space lies inside a word at least as long, and only grams of those are looked up. Concepts are broadcast up to ``most`` rows, in a pass for every
    ``most`` concepts up to ``MOST_PARTS``, and joined beyond.
    """
    filed = _filed(concepts)
    out = reduce(DataFrame.unionByName, _found(filed, mentions, most)).withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return out.select("cid", "mention_id").join(filed.select("cid", "brand", "concept"), "cid").select("brand", "concept", "mention_id")


def concept_mentions(concepts: DataFrame, mentions: DataFrame, shown: int = 3, most: int = 1_000_000) -> DataFrame:
    """Per concept: number of matching mentions and the first of them with the host. The search runs once.

    Matches are counted and cut to the first ones of a piece of a brand in the task that finds them: only those are shuffled or written.
    """
    filed = _filed(concepts)
    piece = Window.partitionBy("cid", "_piece")
    cut = [x.withColumn("position", F.row_number().over(piece.orderBy("mention_id"))).withColumn("_matches", F.sum("_times").over(piece)).filter(F.col("position") <= shown)
           for x in _found(filed, mentions, most)]
    found = checkpoint(reduce(DataFrame.unionByName, cut).select("cid", "mention_id", "_times", "position", "_matches"))
    sizes = found.filter("position = 1").groupBy("cid").agg(F.sum("_matches").alias("matches"))
    rows = found.select("cid", "mention_id", F.explode(F.sequence(F.lit(1), F.least("_times", F.lit(shown)))).alias("_n")).drop("_n")
    first = top_k(rows, ["cid"], [F.col("mention_id")], shown, "position").join(sizes, "cid").join(filed.select("cid", "brand", "concept"), "cid")
    detail = mentions.select("mention_id", "title", third_part(F.col("url")).alias("host"))
    return first.select("mention_id", "brand", "concept", "position", "matches").join(detail, "mention_id")


def vocabulary_gap(internal: DataFrame, external: DataFrame, *keys: str) -> DataFrame:
    """Each concept as aligned (both sides), noise (outside only) or invisible (site only)."""
    on = [*keys, "concept"]
    i = internal.select(*on, F.lit(True).alias("_in")).distinct()
    e = external.select(*on, F.lit(True).alias("_ex")).distinct()
    status = F.when(F.col("_in").isNull(), "noise").when(F.col("_ex").isNull(), "invisible").otherwise("aligned")
    return i.join(e, on, "full").select(*on, status.alias("status"))


def mention_digest(mentions: DataFrame, shown: int = 10) -> DataFrame:
    """The first mentions of every brand as one text of lines."""
    first = top_k(mentions, ["brand"], [F.col("mention_id")], shown)
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.substring("descr", 1, 100))
    listed = first.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("mention_id", line.alias("line")))).alias("_l"))
    return listed.select("brand", F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("digest"))


def export_mentions(mentions: DataFrame, mode: str = "balanced") -> DataFrame:
    """One JSON bundle per brand with its kept mentions, at most 30."""
    kept = top_mentions(mentions, mode)
    item = F.struct("mention_id", F.col("domain_key").alias("source"), "title", F.col("descr").alias("desc"), "url")
    per = kept.groupBy("brand").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(item)).alias("items"))
    bundle = F.struct("brand", F.lit(mode).alias("scan_mode"), F.col("total").alias("total_mentions"), F.col("items").alias("mentions"))
    return per.select("brand", F.col("total").alias("total_mentions"), F.to_json(bundle).alias("json"))
