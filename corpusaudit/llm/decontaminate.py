"""Benchmark decontamination: every training shard gets an FM-index, in which all benchmark windows are searched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .arrays import expand, lower_ascii, merge_spans, raw, slices, word_hashes, words
from .fmindex import FmIndex

#: Bytes of text per shard, and benchmark words searched at once; more go in further blocks.
SHARD, BLOCK_WORDS = 4 << 20, 1 << 20
#: Word bytes: digits, letters in lower case, and all of non-ASCII characters.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, begin and end (bytes in the text) of every word, and the number of words per text."""
    body, offsets = raw(texts)
    body = lower_ascii(body)
    b, e, owner = words(body, offsets, INSIDE[body])
    return word_hashes(body, b, e), owner, b - offsets[owner], e - offsets[owner], np.bincount(owner, minlength=len(texts))


class Windows:
    """The distinct windows of a block of benchmark items, over symbols of their own."""

    def __init__(self, items: list[str], hashes: list[np.ndarray], width: int):
        self.items = items
        flat = np.sort(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.alphabet = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
        rows, lens, owner = [], [], []
        for k, h in enumerate(hashes):
            s = self.symbols(h)
            n = len(s) - width + 1 if len(s) >= width else min(len(s), 1)
            for i in range(n):
                w = s[i:i + width]
                rows.append(np.concatenate([np.zeros(width - len(w), np.int64), w]))
                lens.append(len(w))
                owner.append(k)
        table = np.array(rows, np.int64).reshape(-1, width)
        order = np.lexsort(table.T) if len(table) else np.zeros(0, np.int64)
        ranked = table[order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)]) if len(table) else np.zeros(0, bool)
        self.phrases, self.lens = ranked[new], np.array(lens, np.int64)[order][new]
        self.of = np.cumsum(new) - 1
        self.owners = np.array(owner, np.int64)[order]
        self.bounds = np.append(np.flatnonzero(new), len(order))
        self.shortest = int(self.lens.min()) if len(self.lens) else 1

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for words of the block, 0 for all others."""
        if not len(self.alphabet):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.alphabet, hashes).clip(max=len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, 0)

    def find(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, window) of every occurrence in a shard's texts.

        Words that no window has end a run, and so does a text's end; runs shorter than the shortest window hold no
        occurrence. The index is built over the other runs, whole.
        """
        none = np.zeros(0, np.int64)
        symbol = self.symbols(hashes)
        on = symbol > 0
        head = on.copy()
        head[1:] &= ~on[:-1] | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(head)
        tail = on.copy()
        tail[:-1] &= ~on[1:] | (owner[1:] != owner[:-1])
        size = np.flatnonzero(tail) + 1 - begin
        long_ = size >= self.shortest
        begin, size = begin[long_], size[long_]
        if not len(begin) or not len(self.lens):
            return none, none, none
        run, place = expand(size + 1)
        inside = place < size[run]
        source = np.where(inside, begin[run] + place, -1)
        index = FmIndex(np.where(inside, symbol[source], 0))
        low, high = index.search(self.phrases, self.lens)
        window, place = expand(np.maximum(high - low, 0))
        at = index.locate(low[window] + place)
        return source[at], self.lens[window], window


def _search(found: Windows, add: bool, row_type: pa.DataType):
    piece = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD):
            n = part.num_rows
            h, owner, b, e, n_words = text_words(part.column(1))
            first, size, window = found.find(h, owner)
            begin, end, text = merge_spans(first, first + size, owner[first])
            base = np.cumsum(n_words) - n_words
            counts = found.bounds[window + 1] - found.bounds[window]
            k, place = expand(counts)
            item = found.owners[found.bounds[window][k] + place]
            doc_item = np.sort(owner[first][k] * max(len(found.items), 1) + item)
            doc_item = doc_item[np.concatenate([[True], doc_item[1:] != doc_item[:-1]])] if len(doc_item) else doc_item
            doc, item = doc_item // max(len(found.items), 1), doc_item % max(len(found.items), 1)
            names = [[] for _ in range(n)]
            for d, i in zip(doc.tolist(), item.tolist()):
                names[d].append(found.items[i])
            if add:
                old = part.column(3)
                lists = old.offsets.to_numpy()
                ob, oe = (old.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("begin", "end"))
                ot = np.repeat(np.arange(n), np.diff(lists))
                ob, oe = ob[lists[0]:lists[-1]], oe[lists[0]:lists[-1]]
                begin, end, text = merge_spans(np.concatenate([begin, ob + base[ot]]), np.concatenate([end, oe + base[ot]]), np.concatenate([text, ot]))
                names = [sorted({*a, *c}) for a, c in zip(names, part.column(4).to_pylist())]
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
            as_list = lambda x, y: pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], fields=list(piece)))
            yield pa.RecordBatch.from_arrays([
                part.column(0).cast(row_type), part.column(1), pa.array(n_words, pa.int64()), as_list(begin - base[text], end - base[text]), pa.array(names, pa.list_(pa.string())),
                as_list(b[begin], e[end - 1])], ["row", "text", "n_words", "spans", "items", "byte_spans"])
    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Mark the words of every document that lie in a benchmark window of ``width`` words, or in a whole shorter item.

    Adds ``n_words``, ``n_hit``, ``spans`` (maximal runs of hit words), ``byte_spans`` (the same in the text's
    bytes), ``items`` (ids of items with a window in the document, as strings, sorted) and ``contaminated`` (at least one word and a twentieth
    of all are hit). Columns of ``docs`` with these names give way. A null or empty text has no words; an item without words
    has no window; a null item id is the string ``null``; rows of one id are one item.

    There is no shuffle: a task indexes its shard and searches all windows in it. The benchmark is
    a stated query set; it goes out in blocks of at most ``BLOCK_WORDS`` words, one pass over the shards for each.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD):
            h, _, _, _, n = text_words(part.column(1))
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["item", "n", "words"])

    query = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")).mapInArrow(
        hashed, "item string, n long, words array<long>").filter("n > 0")
    total = query.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    done = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    kind = done.schema["row"].dataType.simpleString()
    row_type = to_arrow_type(StructType.fromDDL(f"row {kind}")["row"].dataType)
    span = "array<struct<begin: int, end: int>>"
    for k in range(blocks):
        rows = query.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).collect()
        found = Windows([r.item for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows], width)
        done = done.mapInArrow(_search(found, k > 0, row_type), f"row {kind}, text string, n_words long, spans {span}, items array<string>, byte_spans {span}")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    mine = {"n_words": F.col("n_words"), "n_hit": hit, "spans": F.col("spans"), "byte_spans": F.col("byte_spans"), "items": F.array_sort(F.array_distinct("items")),
            "contaminated": (hit > 0) & (hit * 20 >= F.col("n_words"))}
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in mine], *[v.alias(k) for k, v in mine.items()])


def digests(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", width: int = 13) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return find_benchmark(docs, benchmark, width).select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
