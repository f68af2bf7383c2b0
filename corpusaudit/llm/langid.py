"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.plans.shapes import checkpoint

from .arrays import lower_ascii, raw, slices

#: Buckets of hashed byte trigrams, languages at most, weight of a smoothing prior in pages.
BUCKETS, MOST, WEIGHT = 1 << 15, 256, 4.0
#: Trigrams overlap; the text's log likelihood is divided by this. Pages with fewer trigrams don't enter the counts.
TEMPER, ENOUGH = 4.0, 24
SLICE = 1 << 20
TAGS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
DECLARED = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})(?![a-z])"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every byte trigram inside a text, A-Z in lower case."""
    body, offsets = raw(texts)
    body = lower_ascii(body).astype(np.uint32)
    if len(body) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = body[:-2] << np.uint32(16) | body[1:-1] << np.uint32(8) | body[2:]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    with np.errstate(over="ignore"):
        bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket[inside].astype(np.int64), owner[:-2][inside]


def language_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigram buckets per language, from all labelled documents.

    Every task adds up one table of fixed size, and the tables are added by language. Rows without a language don't count.
    """
    known = docs.filter(F.col(lang).isNotNull())
    names = sorted(r[0] for r in known.select(lang).distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in slices(batches, "text", SLICE):
            bucket, owner = trigrams(part.column(1))
            of = np.array([number[x] for x in part.column(0).to_pylist()])[owner]
            for k in set(of.tolist()):
                total[k] = total.get(k, 0) + np.bincount(bucket[of == k], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.astype(np.int64).tobytes() for t in total.values()], pa.binary())], ["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table["counts"])
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((len(names), BUCKETS))
    tables = known.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang int, counts binary")
    for r in tables.groupBy("lang").applyInArrow(add, "lang int, counts binary").collect():
        counts[r.lang] = np.frombuffer(r.counts, np.int64)
    return names, np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))


def _likelihoods(logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = logs.T.astype(np.float64)
        for part in slices(batches, "text", SLICE):
            bucket, owner = trigrams(part.column(part.num_columns - 1))
            n = np.bincount(owner, minlength=part.num_rows)
            out = np.zeros((part.num_rows, logs.shape[0]))
            some = np.flatnonzero(n)
            if len(some):
                out[some] = np.add.reduceat(table[bucket], (np.cumsum(n) - n)[some], axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * logs.shape[0]), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(n, pa.int64())], [*part.schema.names[:-1], "ll", "n"])
    return run


def _argmax(values: Column) -> Column:
    """First place of the largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _counts(n: int) -> Column:
    return F.array(*[F.sum(F.when(F.col("top") == i, F.lit(1.0)).otherwise(0.0)) for i in range(n)])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, lang, confidence, text_lang, declared, host): the language with the largest posterior.

    Evidence: the visible text's trigrams under models of ``docs``; the ``lang`` attribute of ``html``; the address's
    suffix; and the host, whose prior is smoothed by its domain's and that by the corpus's. How far each speaks for a language is counted
    over all pages, by the language of their text. A null or empty page, or one without address, is judged by
    the evidence left; without any it gets the most common language. Null and repeated keys keep their rows.
    Without labelled documents ``lang`` is null. Other columns play no part.
    """
    names, logs = language_model(docs)
    n = len(names)
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col(key).alias("id"), host.alias("host"), F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), DECLARED, 1)).alias("declared"),
        F.regexp_replace(F.coalesce(F.col(html), F.lit("")), TAGS, " ").alias("text"))
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    kind = rows.schema["id"].dataType.simpleString()
    seen = rows.mapInArrow(_likelihoods(logs), f"id {kind}, host string, declared string, ll array<double>, n long")
    seen = checkpoint(seen.select("*", F.when(F.col("n") >= ENOUGH, _argmax(F.col("ll"))).alias("top"),
                                  F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1).alias("domain"), F.regexp_extract("host", r"\.([^.]*)$", 1).alias("suffix")))

    by_host = seen.groupBy("host", "domain", "suffix").agg(_counts(n).alias("at_host"))
    zip_add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    corpus = by_host.agg(zip_add("at_host").alias("c")).first().c or [0.0] * n
    corpus = [x or 0.0 for x in corpus]
    common = F.array(*[F.lit((x + 1) / (sum(corpus) + n)) for x in corpus])
    smooth = lambda counts, prior: F.zip_with(counts, prior, lambda x, p: (x + WEIGHT * p) / (_total(counts) + WEIGHT))
    domains = by_host.groupBy("domain").agg(zip_add("at_host").alias("d")).select("domain", smooth(F.col("d"), common).alias("at_domain"))
    suffixes = by_host.groupBy("suffix").agg(zip_add("at_host").alias("by_suffix"))
    hosts = by_host.join(domains, "domain").join(suffixes, "suffix").select("host", smooth(F.col("at_host"), F.col("at_domain")).alias("prior"), "by_suffix")
    declared = seen.groupBy("declared").agg(_counts(n).alias("by_declared"))
    kinds = declared.count(), suffixes.count()
    chance = lambda counts, size: F.transform(counts, lambda x, i: (x + 1) / (F.element_at(F.array(*[F.lit(c) for c in corpus]), i + 1) + size))

    # Codes of two or three letters: 18,252 rows at most.
    both = seen.join(hosts, "host").join(F.broadcast(declared), "declared")
    silent = F.transform(F.col("ll"), lambda x: F.lit(1.0))
    said = F.when(F.col("declared") == "", silent).otherwise(chance(F.col("by_declared"), kinds[0]))
    ends = F.when(F.col("suffix") == "", silent).otherwise(chance(F.col("by_suffix"), kinds[1]))
    logp = F.zip_with(F.zip_with(F.transform("ll", lambda x: x / TEMPER), F.zip_with(said, ends, lambda a, b: F.log(a) + F.log(b)), lambda a, b: a + b),
                      F.col("prior"), lambda a, p: a + F.log(p))
    out = both.select("*", logp.alias("logp"))
    label = lambda at: F.element_at(F.array(*[F.lit(x) for x in names]), at + 1)
    confidence = 1 / _total(F.transform("logp", lambda x: F.exp(x - F.array_max("logp"))))
    return out.select(F.col("id").alias(key), label(_argmax(F.col("logp"))).alias("lang"), F.round(confidence, 6).alias("confidence"),
                      F.when(F.col("n") > 0, label(_argmax(F.col("ll")))).alias("text_lang"), "declared", "host")
