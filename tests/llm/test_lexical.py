"""Ranked lexical search against a plain loop over the definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from corpusaudit.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counted = [(key, Counter(terms(t))) for key, t in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n, length = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = set()
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    for i, wanted in asked.items():
        scores = []
        for key, c, size in counted:
            m = 100 - 25 + 25 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, key is None, key))
        out |= {(i, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scores)[:k])}
    return out


def made(seed, n):
    rnd = random.Random(seed)
    words = [*"abcdefgh", "ab", "abc", "été", "ÉTÉ", "x1", "naïve", "the", "then", "he"]
    text = lambda m: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "-", "\n", "\x7f", "@", "_"]) for _ in range(m))
    docs = [(k, text(rnd.choice([0, 1, 5, 40, 300])) if rnd.random() > 0.05 else None) for k in range(n)]
    items = [(i, text(rnd.randrange(12))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("bounds", [{}, {"CELLS": 60, "SLICE": 500}, {"BLOCK_ITEMS": 7, "SLICE": 300}, {"BLOCK_BYTES": 90}])
def test_matches_a_plain_loop(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = made(len(bounds), 400)
    # Copies: ties far beyond the twenty, in many tasks.
    docs += [(1000 + k, "The THEN été") for k in range(200)]
    random.Random(1).shuffle(docs)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == brute(docs, items) and len(rows) > 100


def test_nulls_empty_long_repeats_and_clashing_names(spark):
    docs = [(1, None), (2, ""), (3, " .\t"), (4, "One"), (4, "one two"), (None, "one"), (5, "word " * 60000 + "zwei"), (6, "é 😀 é"), (7, "one"), (8, "\x00one\x00")]
    items = [(1, "one ONE two"), (1, "é"), (2, None), (3, ""), (None, "word 😀"), (4, "zwei " * 30000), (5, "absent"), (6, "on ne wor")]
    df = spark.createDataFrame([(*r, "x", 3, 4, 5) for r in docs], "doc_id long, text string, item string, rank int, score int, id int")
    ask = spark.createDataFrame([(*r, "y", 1) for r in items], "item_id long, text string, doc_id string, score int")
    assert {tuple(r) for r in lexical.search(df, ask).collect()} == brute(docs, items)
    assert lexical.search(df.limit(0), ask).count() == 0 and lexical.search(df, ask.limit(0)).count() == 0
    assert lexical.search(df.filter("doc_id < 3"), ask).count() == 0


def test_text_keys(spark):
    docs = [(f"k{k % 23}", "one two" if k % 2 else "one") for k in range(60)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id string, text string").repartition(4), spark.createDataFrame([("q", "two")], "item_id string, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted((r.rank, r.doc_id) for r in got.collect())
    assert [r[1] for r in rows] == sorted(k for k, t in docs if "two" in t)[:20]
