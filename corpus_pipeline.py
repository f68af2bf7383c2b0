"""A corpus pipeline of five stages over ``documents``: each takes (spark, docs, sf_dir) and works on all that came before."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm import bpe, decontaminate, neardup, quality, repeats
from corpusaudit.plans.shapes import checkpoint


def packed(docs: DataFrame) -> DataFrame:
    """Key, text and one struct of all other columns, whose names then meet none of an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias("_others"))


def unpacked(done: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, with those that a stage changes."""
    kept = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_others")[c]
    return done.select(*[changed.get(c, kept(c)).alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (a score of 0.3 or more). Labels of held-out rows are not used. Null keys and texts are scored like any."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out())
    model = quality.train(docs, labels)
    return unpacked(quality.score(packed(docs), model, to="_score").filter("_score >= 0.3"), docs)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest key. Shingles of five words, a similarity of 0.8 or more.

    Every row is judged by its own text, so of rows that share a key only those go whose text another document stands for. Rows with null keys stay.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"), by_key=False)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_key"), "text_md5").distinct()
    own = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return docs.join(gone, (docs["doc_id"] == gone["_key"]) & (own == gone["text_md5"]), "left_anti")


def repeated_passage_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a smaller document has in a string of 50; characters cut in part go too. A null key counts as the largest; a null text becomes empty."""
    text = repeats.readable(F.col("kept"))
    return unpacked(repeats.remove_repeats(packed(docs)), docs, text=text, n_chars=F.char_length(text).cast("long"))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: a twentieth of their words or more in benchmark windows. Null texts have no words and stay."""
    found = decontaminate.find_benchmark(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(found.filter(~F.col("contaminated")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of the ids and of what they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "ids", *bpe.digest_columns())


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicate_filter),
    ("suffix-array dedup", repeated_passage_filter),
    ("benchmark decontamination", benchmark_filter),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Classifier and byte-level cuts are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is fixed in the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
