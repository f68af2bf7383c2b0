"""Byte-level BPE: recursive DuckDB queries inside each task contract words; ordered aggregation decodes ids."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import raw, slices

#: A vocabulary beyond this many bytes of tokens is refused: every task keeps one.
MAX_VOCABULARY = 64 << 20
#: Bytes of words and ids that a worker remembers between slices, what an entry takes beside them, and bytes of text that a slice has at most.
REMEMBERED, ENTRY, SLICE = 96 << 20, 180, 2 << 20
#: Ids that one query decodes.
DECODED = 1 << 20
#: Words per recursive query, sum of their squared lengths (the rounds keep so many ids), and the length in
#: bytes beyond which a single word is contracted by a heap instead.
PER_QUERY, SQUARES, LONG = 40_000, 20_000_000, 4096
#: A space before white space or at the end: the text then doesn't fall into words at every space.
HARD = regex.compile(r" (?:[\s\x1c-\x1f]|$)").search
#: The first letter beyond the Latin blocks whose letters all libraries agree on.
LATIN = "\u0250"
SIGNS = ".,;:!?"

CONTRACT = """
WITH RECURSIVE step(round, word, toks) AS (
  SELECT 0, word, toks FROM start
  UNION ALL
  SELECT s.round + 1, s.word, list_concat(list_concat(list_slice(s.toks, 1, b.spot - 1), [b.id]), list_slice(s.toks, b.spot + 2, len(s.toks)))
  FROM step s JOIN (
    SELECT word, CAST(min(first) // 65536 AS INTEGER) AS id, min(first) % 65536 AS spot FROM (
      SELECT word, CAST(m.id AS BIGINT) * 65536 + spot AS first FROM (
        SELECT word, unnest(list_slice(toks, 1, len(toks) - 1)) AS l, unnest(list_slice(toks, 2, len(toks))) AS r, unnest(range(1, len(toks))) AS spot
        FROM step) p JOIN merges m ON m.pair = CAST(p.l AS BIGINT) * 4294967296 + p.r)
    GROUP BY word) b ON b.word = s.word)
SELECT s.word, s.toks FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) last ON last.word = s.word AND last.round = s.round"""

DECODE = "SELECT text, list(body ORDER BY pos) AS parts FROM coded JOIN vocabulary USING (id) GROUP BY text"


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order (base64, then the rank)."""
    with open(path, "rb") as lines:
        ranks = dict(line.split() for line in lines if line.strip())
    by_rank = sorted((int(r), base64.b64decode(t)) for t, r in ranks.items())
    if [r for r, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have gaps")
    tokens = [t for _, t in by_rank]
    if sum(map(len, tokens)) > MAX_VOCABULARY or len(tokens) > 0xF0000:
        raise ValueError("the vocabulary is too large to be kept by every task")
    return tokens


class Codec:
    """A vocabulary with its merge table in a task's own DuckDB, and a bounded memory of words seen."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.pieces = regex.compile(pattern).findall
        # The short cuts below rest on the rules of this one pattern; texts are matched whole against any other.
        self.known = pattern == public_tokenizers.PATTERN
        self.size = 0
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.joined: dict[str, bytes] = {}

    @cached_property
    def db(self) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "192MB"})
        pairs = [(a << 32 | b, i) for i, t in enumerate(self.tokens) for k in range(1, len(t))
                 if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "id": pa.array([i for _, i in pairs], pa.int32())})
        vocabulary = pa.table({"id": pa.array(range(len(self.tokens)), pa.int32()), "body": pa.array(self.tokens, pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            con.register("rows", rows)
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            con.unregister("rows")
        return con

    def rows(self, view: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(view, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(view)

    def contract(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Every word with its ids as int32 bytes: the leftmost pair of least rank is joined until none is left."""
        byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        short = []
        for w in words:
            if w in self.rank:
                yield w, np.int32(self.rank[w]).tobytes()
            elif len(w) > LONG:
                yield w, self.by_heap(w)
            else:
                short.append(w)
        weight = np.cumsum([0, *(len(w) ** 2 for w in short)])
        begin = 0
        while begin < len(short):
            end = min(begin + PER_QUERY, max(begin + 1, int(np.searchsorted(weight, weight[begin] + SQUARES, side="right")) - 1))
            part, begin = short[begin:end], end
            ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(byte[np.frombuffer(b"".join(part), np.uint8)]))
            out = self.rows("start", pa.table({"word": pa.array(range(len(part)), pa.int32()), "toks": toks}), CONTRACT)
            for at, ids in zip(out["word"].to_pylist(), bodies(out["toks"])):
                yield part[at], ids

    def by_heap(self, word: bytes) -> bytes:
        """The same contraction of one very long word, in n log n steps."""
        part, nxt, prv = [word[i:i + 1] for i in range(len(word))], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(len(word) - 1) if (r := self.rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if not part[i] or j >= len(word) or part[i] + part[j] != both:
                continue
            part[i], part[j], nxt[i] = both, b"", nxt[j]
            if nxt[j] < len(word):
                prv[nxt[j]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < len(word) and (r := self.rank.get(part[k] + part[nxt[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k] + part[nxt[k]]))
        return np.array([self.rank[p] for p in part if p], np.int32).tobytes()

    def learn(self, new: list[tuple[dict[str, bytes], set[str], str]]) -> None:
        """Encode new words of each memory, all in one query. A word's pieces are those of the pattern; Latin letters with signs after them need no match."""
        joined, pieces, split, plain = self.joined, set(), [], []
        for memory, found, lead in new:
            for w in found:
                stem = w.rstrip(SIGNS)
                if stem.isalpha() and (stem.isascii() or max(stem) < LATIN):
                    plain.append((memory, w, stem, lead + stem))
                    if stem not in memory:
                        pieces.add(lead + stem)
                    if len(w) > len(stem):
                        pieces.add(w[len(stem):])
                else:
                    ps = self.pieces(lead + w)
                    split.append((memory, w, ps))
                    pieces.update(ps)
        fresh = [p for p in pieces if p not in joined]
        spelled = dict(zip(map(str.encode, fresh), fresh))
        got = {spelled[piece]: ids for piece, ids in self.contract(list(spelled))}
        ids_of = lambda p: joined[p] if p in joined else got[p]
        for memory, w, stem, piece in plain:
            ids = memory.get(stem)
            if ids is None:
                ids = ids_of(piece)
                self.keep(memory, stem, ids)
            if len(w) > len(stem):
                sign = w[len(stem):]
                if sign not in joined:
                    self.keep(joined, sign, got[sign])
                self.keep(memory, w, ids + joined[sign])
        for memory, w, ps in split:
            for p in ps:
                if p not in joined:
                    self.keep(joined, p, got[p])
            self.keep(memory, w, b"".join([joined[p] for p in ps]))

    def keep(self, memory: dict[str, bytes], name: str, ids: bytes) -> None:
        memory[name] = ids
        self.size += len(name) + len(ids) + ENTRY

    def forget(self) -> None:
        """Drop the older halves of all memories while together they are beyond their bound."""
        while self.size > REMEMBERED:
            self.size = 0
            for memory in (self.first, self.later, self.joined):
                for k in list(islice(memory, (len(memory) + 1) // 2)):
                    del memory[k]
                self.size += sum(len(k) + len(v) + ENTRY for k, v in memory.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as int32 bytes.

        Where a space stands before a character that is no white space, the pattern always begins a piece, so
        a text falls into words there; a word that begins with white space is joined to the one before.
        """
        self.forget()
        if not self.known:
            cut = list(map(self.pieces, texts))
            for piece, ids in self.contract([p.encode() for p in {p for ps in cut for p in ps}.difference(self.joined)]):
                self.keep(self.joined, piece.decode(), ids)
            return [b"".join([self.joined[p] for p in ps]) for ps in cut]
        first, later = self.first, self.later
        cut, heads, words = [], set(), set()
        for t in texts:
            ws = t.split(" ")
            if HARD(t):
                joined = [ws[0]]
                for w in ws[1:]:
                    if not w or w[0].isspace():
                        joined[-1] += " " + w
                    else:
                        joined.append(w)
                ws = joined
            ids = list(map(later.get, ws))
            ids[0] = first.get(ws[0])
            gaps = [k for k, i in enumerate(ids) if i is None] if None in ids else []
            if gaps:
                words.update([ws[k] for k in gaps if k])
                if not gaps[0]:
                    heads.add(ws[0])
            # Only the words that are looked up again are held until all are known.
            cut.append((ids, gaps, [ws[k] for k in gaps]))
        self.learn([(first, heads, ""), (later, words, " ")])
        for ids, gaps, ws in cut:
            for k, w in zip(gaps, ws):
                ids[k] = later[w] if k else first[w]
        return [b"".join(ids) for ids, _, _ in cut]

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """Bytes of every list of ids: token-position rows meet the vocabulary, and each text's bytes are gathered in order. Long lists are decoded piece by piece."""
        out = [b""] * len(texts)
        ends = np.cumsum([0, *map(len, texts)])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
        line = np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int32)
        for begin in range(0, len(line), DECODED):
            part = slice(begin, begin + DECODED)
            rows = pa.table({"text": pa.array(owner[part]), "pos": pa.array(np.arange(len(line[part]), dtype=np.int32)), "id": pa.array(line[part])})
            got = self.rows("coded", rows, DECODE)
            for k, body in zip(got["text"].to_pylist(), spans(got["parts"])):
                out[k] += body
        return out


def bodies(lists: pa.ChunkedArray) -> list[bytes]:
    """int32 bytes of every list."""
    out = []
    for chunk in lists.chunks:
        ends = chunk.offsets.to_numpy()
        body = chunk.values.cast(pa.int32()).to_numpy(zero_copy_only=False).tobytes()
        out += [body[b:e] for b, e in zip((ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist())]
    return out


def spans(lists: pa.ChunkedArray) -> list[bytes]:
    """The joined members of every list of binaries: they lie side by side."""
    out = []
    for chunk in lists.chunks:
        body, offsets = raw(chunk.values)
        at, data = offsets[chunk.offsets.to_numpy()].tolist(), body.tobytes()
        out += [data[b:e] for b, e in zip(at[:-1], at[1:])]
    return out


_CODECS: dict[tuple, Codec] = {}
arrays.KEPT.append(_CODECS.clear)


def codec(key: tuple, tokens: list[bytes], pattern: str) -> Codec:
    """A worker keeps one codec, so that later tasks of the same process find its words."""
    if key not in _CODECS:
        # What earlier stages of a reused worker have kept goes first.
        _CODECS.clear()
        arrays._POWERS.clear()
        arrays.give_back()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def _id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Encode whole texts: (key, ids array<int>), as the public library encodes ordinary text; with ``decoded``, also the bytes that the ids spell.

    A null or empty text has no ids. Null and repeated keys keep their rows; equal texts get equal ids. Special tokens
    are ordinary text. Other columns play no part. There is no shuffle: a task encodes each distinct word
    once, by a recursive query over word and merge tables, and decodes in the same process, so that a core holds one vocabulary and one memory.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec((ranks_path, pattern), tokens.value, pattern)
        for part in slices(batches, "text", SLICE):
            # The queries of a slice leave more free memory behind than a worker's words take.
            arrays.trim()
            ids = coder.encode(part.column(1).fill_null("").to_pylist())
            more = [pa.array(coder.decode([np.frombuffer(i, np.int32) for i in ids]), pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(ids), *more], ["key", "ids", "decoded"][:2 + decoded])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def decode(coded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` spell. A null list spells nothing; an id outside the vocabulary is an error."""
    tokens = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec((ranks_path, pattern), tokens.value, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                column = part.column(part.schema.get_field_index(ids)).fill_null(pa.scalar([], pa.list_(pa.int32())))
                ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                if len(flat) and (flat[ends[0]:ends[-1]].min(initial=0) < 0 or flat[ends[0]:ends[-1]].max(initial=0) >= len(coder.tokens)):
                    raise ValueError("an id is outside the vocabulary")
                bytes_ = coder.decode([flat[b:e] for b, e in zip(ends[:-1].tolist(), ends[1:].tolist())])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bytes_, pa.binary())], [*part.schema.names, to])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{kinds}, {to} binary")


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 from ids and decoded bytes."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, and decoded again from the ids."""
    return encode(docs, ranks_path, pattern, key, text, decoded=True).select(key, *digest_columns())
