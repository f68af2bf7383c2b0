"""Training order: the permutation, and shards read back against a plain concatenation."""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from corpusaudit.llm import bpe
from corpusaudit.llm import training_order as T
from corpusaudit.llm.queries import QUERIES


def stream(spark, path):
    """Texts in file order as one stream."""
    texts = [r.text for r in spark.read.parquet(path).select("text").coalesce(1).collect()]
    return b"".join((t or "").encode() + bytes([T.END]) for t in texts)


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000, 4097):
        a, b = T.feistel(np.arange(n), n, 1), T.feistel(np.arange(n), n, 2)
        assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
        assert n < 64 or (a.tolist() != b.tolist() and a.tolist() != list(range(n)))


def test_shards_hold_the_stream(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = "file://" + tempfile.mkdtemp(prefix="order-")
    got = {r.slot: r for r in T.materialise(docs, 99, folder=folder).collect()}
    body = stream(spark, f"{sf_dir}/documents.parquet")
    n = -(-len(body) // T.LENGTH)
    assert sorted(got) == list(range(n))
    records = list(T.read_slots(f"{folder}/shards", 0, n))
    slots = T.feistel(np.arange(n), n, 99)
    for seq, slot in enumerate(slots.tolist()):
        want = body[seq * T.LENGTH:(seq + 1) * T.LENGTH].ljust(T.LENGTH, bytes([T.END]))
        assert records[slot] == want and got[slot].seq == seq and got[slot].crc32 == zlib.crc32(want)
    assert list(T.read_slots(f"{folder}/shards", 5, 9)) == records[5:9]


def test_every_task_writes_one_range_of_neighbouring_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = "file://" + tempfile.mkdtemp(prefix="order-")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        rows = T.materialise(docs, 7, folder=folder, per_shard=4).select("slot", "seq", "shard", "offset", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    body = stream(spark, f"{sf_dir}/documents.parquet")
    n = -(-len(body) // T.LENGTH)
    shards = -(-n // 4)
    assert shards > 6 and sorted(r.slot for r in rows) == list(range(n))
    of = {}
    for r in rows:
        assert r.shard == r.slot // 4 and r.offset == r.slot % 4 * T.LENGTH
        of.setdefault(r.task, set()).add(r.shard)
    each = shards // 3 if shards // 3 < T.PER_TASK else T.PER_TASK
    assert of == {k: set(range(k * each, min((k + 1) * each, shards))) for k in range(-(-shards // each))}
    records = list(T.read_slots(f"{folder}/shards", 0, n, per_shard=4))
    slots = T.feistel(np.arange(n), n, 7).tolist()
    assert b"".join(records[s] for s in slots) == body.ljust(n * T.LENGTH, bytes([T.END]))


def test_uris_of_object_stores():
    seen = []
    real, T.pafs = T.pafs, type("fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(seen.append)})})
    try:
        for uri in ("s3a://b/x", "s3n://b/x", "hdfs://h/x", "file:///x/s3a://"):
            T.filesystem(uri)
    finally:
        T.pafs = real
    assert seen == ["s3://b/x", "s3://b/x", "hdfs://h/x", "file:///x/s3a://"]


def test_query_is_whole_and_repeats(spark, sf_dir):
    a, b = (sorted(map(tuple, QUERIES["op2_training_order"](spark, sf_dir).collect())) for _ in range(2))
    assert a == b and sum(r[4] for r in a) == len(stream(spark, f"{sf_dir}/documents.parquet"))


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "f"), (2, "é", "g"), (3, "", "h")], "doc_id long, text string, file string")
    rows = T.materialise(df, 5).collect()
    assert [(r.slot, r.seq, r.n_ids) for r in rows] == [(0, 0, 5)]
    assert T.materialise(df.limit(0), 5).count() == 0
    assert T.materialise(df.filter("doc_id > 1").groupBy("text").count(), 5).count() == 1


def test_shards_hold_token_ids(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    texts = [None, "", "One word, é 😀", *(f"the {i} token stream of a longer document " * 40 for i in range(30)), "x" * 5000]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    folder = "file://" + tempfile.mkdtemp(prefix="order-")
    got = {r.slot: r for r in T.materialise(df, 3, folder=folder, ranks_path=path, pattern=P.PATTERN).collect()}
    coder = bpe.Codec(tokens, P.PATTERN)
    want = sorted(coder.encode([t or "" for t in texts]))
    total = sum(len(w) // 4 + 1 for w in want)
    n = -(-total // T.LENGTH)
    assert n > 1 and sorted(got) == list(range(n)) and sum(r.n_ids for r in got.values()) == total
    records = list(T.read_slots(f"{folder}/shards", 0, n, 2))
    assert list(T.read_slots(f"{folder}/shards", 1, n, 2)) == records[1:]
    slots = T.feistel(np.arange(n), n, 3).tolist()
    assert all(got[s].seq == q and got[s].crc32 == zlib.crc32(records[s]) and len(records[s]) == 2 * T.LENGTH for q, s in enumerate(slots))
    ids = np.frombuffer(b"".join(records[s] for s in slots), "<u2")
    assert (ids[total:] == len(tokens)).all()
    docs = np.split(ids[:total].astype(np.int32), np.flatnonzero(ids[:total] == len(tokens)) + 1)
    assert not len(docs.pop()) and sorted(d[:-1].tobytes() for d in docs) == want


def test_token_query_is_whole(spark, sf_dir):
    rows = QUERIES["op2_training_order_tokens"](spark, sf_dir).collect()
    ids = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).selectExpr("sum(size(ids) + 1) AS n").first().n
    assert sum(r.n_ids for r in rows) == ids and len({r.slot for r in rows}) == len(rows)
