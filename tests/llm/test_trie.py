"""Prefix tries against a plain walk over the rebuilt conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from corpusaudit.llm import trie


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))] for c, ts in turns.items()}
    nodes, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = sum(saved[q] for q in below) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, cs in nodes.items())


def result(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * convs), convs):
        kind = rnd.random()
        for t in range(longest if kind < 0.05 else rnd.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same" if kind < 0.4 else f"é{rnd.randrange(3)}"))
    return rows


@pytest.mark.parametrize("local", [1 << 17, 300, 20, 1])
def test_matches_a_plain_walk(spark, monkeypatch, local):
    monkeypatch.setattr(trie, "LOCAL", local)
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = made(local, 60 if local == 1 else 150, 40)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert result(trie.prefix_trie(df)) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(4, t, "user", f"t{t % 7}") for t in range(30000)] + [(9, t, "user", f"t{t % 7}") for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(trie.prefix_trie(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    by = {(r[0], r[1]): r for r in got}
    h = zlib.crc32(b"4") % 9
    # Neither 0 nor 5 is there: both lose their first turns.
    assert len(by) == len(got) and max(r[1] for r in got) == 30000 - h
    assert by[4, 0][3:6] == (2, 2, 2) or by[4, 0][3:6] == (2, 1, 2)
    assert all(by[4, d][2] == 4 for d in range(1, 30000 - h))


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    rows = [(0, None, "user", "a"), (0, 1, None, None), (0, 1, None, None), (0, 2, "", "x" * 300000), (1, 0, "user", "a"), (2, 5, "user", "b"), (2, 5, "user", "a"),
            (None, 0, "user", "lost"), (7, 0, "u", "serv"), (7, 1, "us", "erv"), (3, -1, "user", "é"), *[(k, t, "user", "a") for k in (10, 11, 12) for t in range(12)]]
    df = spark.createDataFrame([(*r, 1, "p", b"n", 2) for r in rows], "conv_id long, turn long, role string, text string, d int, parent string, node binary, weight int")
    assert result(trie.prefix_trie(df)) == brute(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    # Conversations whose every turn falls away end at the root.
    alone = [(k, 0, "user", "gone") for k in range(1, 5)]
    got = result(trie.prefix_trie(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")))
    assert got == brute(alone) and got[0][:2] == (1, 0)
