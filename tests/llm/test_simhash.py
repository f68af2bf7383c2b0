"""SimHash groups against a plain loop over the definition."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from corpusaudit.llm import simhash
from corpusaudit.llm.queries import QUERIES


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values):
    """Component of every distinct value, by comparing it with all others."""
    values = np.array(sorted(values), np.uint64)
    group, left = {}, set(range(len(values)))
    while left:
        todo = [min(left)]
        lead = todo[0]
        left.discard(lead)
        while todo:
            k = todo.pop()
            group[int(values[k])] = lead
            near = [int(j) for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3) if int(j) in left]
            left.difference_update(near)
            todo.extend(near)
    return group


def brute(rows):
    prints = [(key, plain_fingerprint(t)) for key, t in rows]
    group = plain_groups({f for _, f in prints})
    up = {g: g for g in group.values()}

    def top(g):
        while up[g] != g:
            g = up[g]
        return g
    first = {}
    for key, f in prints:
        if key is not None:
            a, b = sorted((top(group[f]), top(first.setdefault(key, group[f]))))
            up[b] = a
    least = {}
    for key, f in prints:
        if key is not None:
            least[top(group[f])] = min(key, least.get(top(group[f]), key))
    return sorted(((key, f"{f:016x}", least.get(top(group[f]))) for key, f in prints), key=repr)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_simhash_variants"](spark, sf_dir).collect()), key=repr) == brute(rows)


def test_nulls_empty_long_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 1000)
    rows = [(8, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "One"), (4, "one"), (None, "one"), (5, "Word " * 60000 + "é"), (6, "é\xa0😀"), (7, "A b C d"), (9, "a  b\nc D"),
            (10, "x y"), (10, "z w v u t"), (None, "lonely text"), (11, "z W v u t"), (12, "x Y")]
    df = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], "doc_id long, text string, fp int, id string, component_id int, key int").repartition(3)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    words = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(words).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


@pytest.mark.parametrize("crowd,pairs", [(1024, 1 << 20), (1024, 50), (2, 100), (6, 1000), (40, 30)])
def test_links_of_clouds_and_chains(spark, monkeypatch, crowd, pairs):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rnd = random.Random(crowd * pairs)
    values = set()
    for _ in range(8):
        at = rnd.getrandbits(64)
        # A cloud around one value, and a chain that moves away step by step.
        for _ in range(60):
            values.add(at ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))))
        for _ in range(25):
            at ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 3, 4])))
            values.add(at)
    # Many that share all of one segment.
    high = rnd.getrandbits(32) << 32
    values |= {high | (0x5A5A0000 + (rnd.getrandbits(16))) for _ in range(300)}
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in sorted(values)], "fp long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    ranked = sorted(values)
    number = {v: k for k, v in enumerate(ranked)}
    low = simhash.groups_of(np.array([number[a] for a, _ in pairs], np.int64), np.array([number[b] for _, b in pairs], np.int64), len(ranked))
    want = plain_groups(values)
    assert [int(x) for x in low] == [want[v] for v in ranked] and len(set(want.values())) > 8
