"""Order MinHash fingerprints: least occurrence-numbered k-mers, kept in text order, hashed as tuples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.plans.shapes import checkpoint

from .arrays import mix, released, slices

#: Code points of a k-mer, tuples of a fingerprint, k-mers of a tuple.
K, TUPLES, CHOSEN = 6, 32, 2
#: Bytes of text in a partition of the sort, about; bytes of text handled at once.
RANGE, SLICE = 256 << 20, 4 << 20
#: Candidates expected below the threshold that stands in for a full selection.
EXPECTED = 24
_SEEDS = mix(np.arange(2 * TUPLES, dtype=np.uint64), 0x0DDB1A5E5BAD5EED)
XOR, ODD = (_SEEDS[:TUPLES] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (_SEEDS[TUPLES:] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def fingerprint(text: str) -> np.ndarray:
    """One 32-bit number per tuple. Texts shorter than a k-mer are one k-mer; the empty text has a number of its own."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(len(points) - K + 1, min(len(points), 1))
    if n == 0:
        return np.zeros(TUPLES, np.uint32)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(min(K, len(points))):
            h = h * np.uint64(0x9FB21C651E98DF25) + points[i:i + n] + np.uint64(1)
        h = mix(h)
        bits = np.uint64(int(n).bit_length())
        packed = np.sort(h >> bits << bits | np.arange(n, dtype=np.uint64))
        top = packed >> bits
        at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        head = np.ones(n, bool)
        head[1:] = top[1:] != top[:-1]
        place = np.arange(n)
        seen = np.empty(n, np.uint64)
        seen[at] = place - np.maximum.accumulate(np.where(head, place, 0))
        x = (mix(h + seen * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        values = (x[None, :] ^ XOR[:, None]) * ODD[:, None]
        keep = min(CHOSEN, n)
        if n > 4 * EXPECTED:
            row, col = np.nonzero(values < np.uint32((1 << 32) * EXPECTED // n))
            if len(row) == 0 or np.bincount(row, minlength=TUPLES).min() < keep:
                row, col = np.nonzero(np.ones_like(values, bool))
        else:
            row, col = np.nonzero(np.ones_like(values, bool))
        order = np.lexsort((col, values[row, col], row))
        first = np.searchsorted(row[order], np.arange(TUPLES))
        chosen = np.sort(col[order][first[:, None] + np.arange(keep)], axis=1)
        out = np.full(TUPLES, keep, np.uint64)
        for i in range(keep):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[chosen[:, i]], i + 1)
        return np.maximum((out >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples."""
    return float((a == b).mean())


def packed(a: np.ndarray) -> bytes:
    """A fingerprint's numbers, high byte first."""
    return a.astype(">u4").tobytes()


def hexed(a: np.ndarray) -> str:
    return packed(a).hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of the following one, as long if it has so much."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _pair(own: str, own_print: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    """What one document and the one that follows it give: length, digest of the edited text, both fingerprints as bytes, and likenesses."""
    changed = edited(own, following)
    other = fingerprint(changed)
    return (len(own), hashlib.sha256(changed.encode()).digest(), packed(own_print), packed(other), likeness(own_print, other), likeness(own_print, next_print))


#: Columns of a pair's result, and of a partition's ends.
PAIR = {"n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
ENDS = {"part": pa.int32(), "head": pa.string(), "tail": pa.string()}
PAIR_DDL = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents in order, each with the one after it. Its last row holds the key of the partition's last document, and the partition's first and last texts."""
    names = ["own", *PAIR, *ENDS]
    nothing, head, last, last_print, last_key = [None] * len(PAIR), None, None, None, None
    for batch in batches:
        for part in slices(iter([batch]), "text", SLICE):
            texts, keys, rows = part.column(1).to_pylist(), part.column(0), []
            for text in texts:
                text = text or ""
                now = fingerprint(text)
                if last is None:
                    head = text
                else:
                    rows.append(_pair(last, last_print, text, now))
                last, last_print = text, now
            owns = keys.slice(0, len(keys) - 1) if last_key is None else pa.concat_arrays([last_key, keys.slice(0, len(keys) - 1)])
            last_key = keys.slice(len(keys) - 1)
            yield pa.RecordBatch.from_arrays([owns, *_columns(rows, PAIR), *_columns([(None,) * len(ENDS)] * len(rows), ENDS)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([last_key, *_columns([nothing], PAIR), *_columns([(TaskContext.get().partitionId(), head, last)], ENDS)], names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of every partition with the first one of the next."""
    for batch in batches:
        rows = [_pair(tail, fingerprint(tail), head, fingerprint(head)) for tail, head in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, PAIR)], ["own", *PAIR])


def order_min_hash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document has the next smaller key, of whatever type that can be ordered; after the smallest comes the largest. A null text is empty. A
    null key counts as smaller than all; rows of one key are ordered by a hash of their text, and equal rows follow each other. A single document follows itself.
    Other columns play no part.

    Texts are sorted by range, one shuffle of them, and every partition is read once from its first document to its last. Rows of one key
    are dealt by their hash and equal rows by their place in the input, so they may span any number of partitions. One row per partition
    tells its first and last text; these rows are joined, so that the last document of each partition meets the first of the next that has any.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("own"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    order = [F.desc("own"), F.desc("tie"), F.desc("place")]
    own = f"own {docs.schema[key].dataType.simpleString()}"
    # The layout of the range sort holds for one evaluation only, so what is made of it is fixed, without the texts.
    fixed = checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("own", "text").mapInArrow(
        released(_sorted), f"{own}, {PAIR_DDL}, part int, head string, tail string"))
    ends = fixed.filter("part IS NOT NULL").select("own", "part", "head", "tail")
    # One row per partition that has documents, without texts.
    follow = ends.select("part").withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    heads = ends.select(F.col("part").alias("after"), F.col("head").alias("following"))
    met = ends.join(follow, "part").join(heads, "after").select("own", "tail", "following").mapInArrow(_ends, f"{own}, {PAIR_DDL}")
    out = fixed.filter("part IS NULL").select(*met.columns).unionByName(met)
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(F.col("own").alias(key), "n_chars", digits("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")
