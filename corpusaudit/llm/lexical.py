"""Ranked lexical search: an Aho-Corasick automaton of all item terms runs over every text; nothing is indexed by document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import expand, raw, slices

#: Bytes of text scanned at once, scores (documents by items) held at once, and bounds of what is broadcast at once: bytes of item text, and items.
SLICE, CELLS, BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 1 << 21, 4 << 20, 4096
#: Term bytes: digits, letters (A-Z become a-z) and all bytes of non-ASCII characters. All others become the guard, a space.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x30:0x3A], FOLD[0x61:0x7B], FOLD[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def folded(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one string of bytes with guards around each text, where every text ends in it, and the terms of every text."""
    body, offsets = raw(texts)
    n = len(texts)
    out = np.full(len(body) + n + 1, 0x20, np.uint8)
    out[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = FOLD[body]
    inside = out != 0x20
    begins = np.concatenate([[0], np.cumsum(inside[1:] & ~inside[:-1])])
    ends = offsets[1:] + np.arange(n) + 1
    return out.tobytes().decode("latin-1"), ends, np.diff(np.concatenate([[0], begins[ends]]))


def terms_of(text: str | None) -> list[str]:
    """Terms of one text, with repeats, as strings of bytes."""
    return folded(pa.array([text], pa.string()))[0].split(" ") if text else []


class Block:
    """The automaton of a block of items, and for every term the items that hold it, how often."""

    def __init__(self, items: list, texts: list[list[str]]):
        counts = [Counter(t for text in held for t in terms_of(text) if t) for held in texts]
        self.items = items
        self.terms = sorted({t for c in counts for t in c})
        number = {t: k for k, t in enumerate(self.terms)}
        rows = sorted((number[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        self.item, self.times = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.bounds = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(self.terms) + 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in number.items():
            self.automaton.add_word(f" {t} ", k)
        if self.terms:
            self.automaton.make_automaton()

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and frequency of all terms of the block that stand in the texts, and the number of terms of every text."""
        line, ends, n_terms = folded(texts)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64).reshape(-1, 2) if self.terms else np.zeros((0, 2), np.int64)
        # A match ends on the guard behind its term.
        text = np.searchsorted(ends, found[:, 0])
        both, tf = np.unique(text * max(len(self.terms), 1) + found[:, 1], return_counts=True)
        return both // max(len(self.terms), 1), both % max(len(self.terms), 1), tf.astype(np.int64), n_terms


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each term; as term -1, the documents with terms and all their terms."""
        block = shared.value
        df, docs, length = np.zeros(len(block.terms), np.int64), 0, 0
        for part in slices(batches, "text", SLICE):
            _, term, _, n = block.count(part.column(1))
            df += np.bincount(term, minlength=len(df))
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], docs)), pa.array(np.append(np.zeros(len(seen), np.int64), length))], ["term", "docs", "length"])
    return run


def _best(shared, weights, docs: int, length: int, k: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of every item among those of the task."""
        block, weight = shared.value, weights.value
        items = len(block.items)
        item, score, key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        least = np.ones(items, np.int64)
        for big in slices(batches, "text", SLICE):
            step = max(1, CELLS // max(items, 1))
            for part in (big.slice(at, step) for at in range(0, big.num_rows, step)):
                text, term, tf, n = block.count(part.column(1))
                m = 75 + 25 * n * docs // max(length, 1)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[text]))
                one, place = expand(block.bounds[term + 1] - block.bounds[term])
                at = block.bounds[term[one]] + place
                sums = np.zeros((part.num_rows, items), np.int64)
                np.add.at(sums, (text[one], block.item[at]), gain[one] * block.times[at])
                row, col = np.nonzero(sums >= least)
                if not len(row):
                    continue
                item, score = np.append(item, col), np.append(score, sums[row, col])
                fresh = part.column(0).take(pa.array(row))
                key = fresh if key is None else pa.concat_arrays([key, fresh])
                turn = pc.rank(key, "ascending", null_placement="at_end", tiebreaker="first").to_numpy(zero_copy_only=False)
                order = np.lexsort((turn, -score, item))
                _, first, size = np.unique(item[order], return_index=True, return_counts=True)
                kept = order[(np.arange(len(order)) - np.repeat(first, size)) < k]
                item, score, key = item[kept], score[kept], key.take(pa.array(kept))
                held, first, size = np.unique(item, return_index=True, return_counts=True)
                full = size == k
                least[held[full]] = score[first[full] + k - 1]
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(block.items, item_type).take(pa.array(item)), key, pa.array(score)], ["item", "id", "score"])
    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents for every item: (item, rank, key, score), rank 1 the best; documents with score 0 are left out.

    Terms are runs of digits, letters and non-ASCII characters with A-Z in lower case. With N documents that have
    terms, L terms in all, n terms in a document, a term in df of them and tf times in this one: weight w = floor(1000 ln((2N + 2) / (2df + 1))),
    m = 75 + 25nN div L, score = sum of w * (10^9 tf div (1000 tf + 12m)) over the item's terms, repeats included.

    The texts are scanned twice, without a shuffle of theirs: once for N, L and df, once for the scores. A task keeps the k best of its documents
    for every item, so k rows per item and task are shuffled. The items are a stated query set; their automata are broadcast in blocks of about ``BLOCK_BYTES``
    bytes of text and ``BLOCK_ITEMS`` items (a longer item is a block by itself), one pair of scans for each.

    Equal scores are ranked by ascending key, null keys last; rows that share a key are documents of their own. Rows that share an item id
    are one item with the terms of all; a null item id is an item too. Null or empty texts have no terms: such a document is never found, such an item finds
    nothing. Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    asked = queries.select(F.col(item).alias("item"), F.col(item_text).alias("text")).filter("text <> ''")
    many, total = asked.agg(F.count_distinct(F.coalesce(F.col("item").cast("string"), F.lit("null"))), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-many // BLOCK_ITEMS), -(-total // BLOCK_BYTES))
    kinds = {"item": asked.schema["item"].dataType, "id": rows.schema["id"].dataType}
    out = None
    for b in range(blocks):
        held: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():
            held.setdefault(r.item, []).append(r.text)
        block = Block(list(held), list(held.values()))
        shared = spark.sparkContext.broadcast(block)
        seen = {r.term: r for r in rows.mapInArrow(_frequencies(shared), "term long, docs long, length long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).collect()}
        n, length = (seen[-1].docs, seen[-1].length) if -1 in seen else (0, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * (seen[t].docs if t in seen else 0) + 1))) for t in range(len(block.terms))], np.int64)
        best = rows.mapInArrow(_best(shared, spark.sparkContext.broadcast(weight), n, length, k, to_arrow_type(kinds["item"])),
                               f"item {kinds['item'].simpleString()}, id {kinds['id'].simpleString()}, score long")
        out = best if out is None else out.unionByName(best)
    turn = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")
