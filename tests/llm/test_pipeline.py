"""Every stage against a brute-force version on its own input."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_edges import brute_groups


def cut_texts(rows, length=50):
    first = {}
    for key, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i:i + length]] = min(first.get(b[i:i + length], key), key)
    out = {}
    for key, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key:
                gone[i:i + length] = True
        out[key] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def contaminated(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit = set()
    for n, known in windows.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in known:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    windows: dict[int, set] = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r.text))
        for i in range(max(len(w) - 12, 1)):
            windows.setdefault(min(len(w), 13), set()).add(tuple(w[i:i + 13]))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after_df = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in after_df.collect()}
        assert after.keys() <= before.keys() and after_df.count() == len(after)
        if k < 4:
            assert after_df.columns == docs.columns
        if k == 0:
            wrong = [d for d in labels if d in before and (d in after) != (labels[d] == 1)]
            assert len(wrong) <= 0.03 * len(labels)
            assert all(after[d] == before[d] for d in after)
        elif k == 1:
            groups = brute_groups([(d, r.text) for d, r in before.items()], 5, 4, 5)
            assert set(after) == {d for d, (_, top) in groups.items() if d == top}
        elif k == 2:
            want = cut_texts([(d, r.text) for d, r in before.items()])
            assert {d: r.text for d, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif k == 3:
            assert set(after) == {d for d, r in before.items() if not contaminated(r.text, windows)}
        else:
            for d, r in before.items():
                ids = public.encode_ordinary(r.text)
                assert after[d].ids == ids and after[d].n_tokens == len(ids)
                assert after[d].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        docs = after_df


def test_run_returns_what_the_stages_return(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    want = sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_stages_keep_odd_rows_and_clashing_names(spark, sf_dir):
    extra = {"kept": "k", "spans": 1, "n_bytes": 2, "items": "i", "n_words": 3, "_score": 4.0, "text_md5": "m", "id": 5, "n_chars": 6}
    texts = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (5, "alpha beta gamma delta epsilon zeta eta theta"), (5, "one unlike text of its own with words enough to stand"),
             (None, "a row without any key at all, with some words in it"), (7, None), (8, ""), (9, "same row"), (9, "same row"), (10, "long " * 30000)]
    docs = spark.createDataFrame([(k, t, *extra.values()) for k, t in texts], "doc_id long, text string, kept string, spans int, n_bytes int, items string, n_words int, _score double, text_md5 string, id int, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf_dir)
        rows = got.collect()
        if k < 4:
            assert got.columns == docs.columns
            assert all(r[c] == v for r in rows for c, v in extra.items() if c != "n_chars"), name
        if k == 1:
            assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((i, t) for n, (i, t) in enumerate(texts) if n != 1), key=repr)
        if k >= 2:
            assert len(rows) == len(texts)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
