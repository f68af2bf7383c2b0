"""Encoding against the public library, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from corpusaudit.llm import bpe
from corpusaudit.llm.arrays import slices
from corpusaudit.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hexed(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def expected(public, key, text):
    ids = public.encode_ordinary(text or "")
    return key, len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((text or "").encode())


def test_whole_table(spark, sf_dir, public):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op10_byte_bpe"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(expected(public, *r) for r in docs)


def test_codec_on_hard_texts(public):
    rnd = random.Random(5)
    alphabet = "ab 12'st \n\t\x1c\x1f\x85\xa0　​é\xe9中!?\r\v\fⅧ\xb2٣😀A="
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["=" * 9000, " " * 700, "ab" * 3000, "\n" * 50 + " x", "".join(rnd.choice("abcdefgh") for _ in range(6000)),
              "".join(rnd.choice("etaoin") for _ in range(900)), "<|endoftext|> it's we'LL", ""]
    coder = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    ids = [bpe.np.frombuffer(b, bpe.np.int32) for b in coder.encode(texts)]
    wrong = [t for t, i in zip(texts, ids) if i.tolist() != public.encode_ordinary(t)]
    assert wrong == []
    assert coder.decode(ids) == [t.encode() for t in texts]


@pytest.mark.parametrize("pattern", [P.PATTERN, r"\S+|\s+", r"\p{L}{1,3}|[^\p{L}]"])
def test_small_memories_pieces_and_other_patterns(pattern, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3000)
    monkeypatch.setattr(bpe, "DECODED", 7)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    coder = bpe.Codec(bpe.read_ranks(PATH), pattern)
    for _ in range(12):
        texts = [" ".join("".join(rnd.choice("abcdé ,.\n") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(20))) for _ in range(20)]
        ids = [bpe.np.frombuffer(b, bpe.np.int32) for b in coder.encode(texts)]
        assert [i.tolist() for i in ids] == [own.encode_ordinary(t) for t in texts]
        assert coder.decode(ids) == [t.encode() for t in texts]
    coder.forget()
    assert coder.size <= bpe.REMEMBERED and coder.size == sum(len(k) + len(v) + bpe.ENTRY for m in (coder.first, coder.later, coder.joined) for k, v in m.items())


def test_nulls_repeats_clashes_and_empty_tables(spark, public):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "a b", "z"), (2, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(docs, PATH, P.PATTERN).collect()), key=repr)
    assert got == sorted((expected(public, k, t) for k, t, _ in rows), key=repr)
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_tasks_of_other_operators_drop_the_codec():
    bpe.codec(("a",), bpe.read_ranks(PATH), P.PATTERN)
    assert bpe._CODECS
    assert list(bpe.arrays.released(lambda batches: iter(batches))(iter([1, 2]))) == [1, 2] and not bpe._CODECS


def test_unknown_ids_fail(spark):
    bad = spark.createDataFrame([([1, 60000],)], "ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(bad, PATH, P.PATTERN).collect()


def test_one_query_for_the_new_words_of_a_slice(public, monkeypatch):
    coder = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    calls, looked = [], []
    contract = coder.contract
    monkeypatch.setattr(coder, "contract", lambda words: calls.append(sorted(words)) or contract(words))

    class Memory(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    coder.later = Memory()
    texts = ["qzxa qzxb qzxb, x-qzxa qzxb.", "qzxa-qzxb qzxa", "", "qzxa"]
    ids = [bpe.np.frombuffer(b, bpe.np.int32).tolist() for b in coder.encode(texts)]
    assert ids == [public.encode_ordinary(t) for t in texts]
    assert len(calls) == 1 and len(calls[0]) == len(set(calls[0]))
    coder.encode(texts)
    assert calls[1:] in ([], [[]])


def test_memory_goes_back_after_every_slice(spark, monkeypatch):
    given = []
    monkeypatch.setattr(bpe.arrays, "trim", lambda: given.append(1))
    monkeypatch.setattr(bpe, "SLICE", 4)
    tokens = bpe.read_ranks(PATH)
    table = bpe.pa.record_batch({"key": [1, 2, 3], "text": ["abc", "def", None]})
    kept = {}

    class Rows:
        sparkSession = spark
        schema = spark.createDataFrame([(1, "a")], "doc_id long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            kept["run"] = run
            return self

        def withColumnRenamed(self, a, b):
            return self

    bpe.encode(Rows(), PATH, P.PATTERN)
    bpe.codec((PATH, P.PATTERN), tokens, P.PATTERN)
    given.clear()
    assert sum(b.num_rows for b in kept["run"](iter([table]))) == 3 and len(given) == 2


def test_texts_of_two_megabytes_share_a_query(public):
    """Words that come again within 2 MB of text are new once, and cost one recursive query."""
    coder, asked = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN), []
    real = coder.rows
    coder.rows = lambda view, table, sql: asked.append(view) or real(view, table, sql)
    line = " ".join(f"zq{i}xv" for i in range(500))
    text = line * ((19 << 16) // len(line))
    batch = pa.RecordBatch.from_arrays([pa.array([text, text[: len(text) // 2]])], ["text"])
    got = [i for part in slices(iter([batch]), "text", bpe.SLICE) for i in coder.encode(part.column(0).to_pylist())]
    assert asked == ["start"]
    assert [np.frombuffer(i, np.int32).tolist() for i in got] == [public.encode_ordinary(t) for t in (text, text[: len(text) // 2])]
