"""Properties on generated input, against plain brute force."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusaudit.functions import urls as U
from corpusaudit.functions.text import contains_any
from corpusaudit.operators import cluster, jsonld, offpage, sitemap
from corpusaudit.plans.graph import components
from corpusaudit.plans.shapes import number_in_groups, pick_rows, top_k, with_row_number

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@QUICK
@given(st.lists(st.text(alphabet="aA/?#.&=:é-", max_size=15), min_size=1, max_size=20))
def test_normalize_is_idempotent(spark, tails):
    # No path parameters: dropping a trailing slash can turn a segment into one.
    df = spark.createDataFrame([("HTTPS://Host.example/" + t,) for t in tails], "u string")
    once = U.normalize_url(F.col("u"))
    assert df.filter(U.normalize_url(once) != once).count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.text("ab", max_size=2),
                    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["k", "l", "@type", "sameAs"]), x, max_size=3), max_leaves=8)


def brute_diff(o, n, prefix=""):
    out = []
    if isinstance(n, dict):
        od = o if isinstance(o, dict) else {}
        pairs = [((f"{prefix}.{k}" if prefix else k), k in od, od.get(k), k in n, n.get(k)) for k in {**n, **od}]
    else:
        ol = o if isinstance(o, list) else []
        pairs = [(f"{prefix}[{i}]", i < len(ol), ol[i] if i < len(ol) else None, i < len(n), n[i] if i < len(n) else None) for i in range(max(len(n), len(ol)))]
    for path, in_o, a, in_n, b in pairs:
        if not in_n:
            out.append((path, "removed"))
        elif not in_o:
            out.append((path, "added"))
        elif json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True):
            out.append((path, "same"))
        elif isinstance(b, (dict, list)):
            out.extend(brute_diff(a, b, path))
        else:
            out.append((path, "enriched"))
    return out


@QUICK
@given(st.lists(st.tuples(st.dictionaries(st.sampled_from(["a", "b", "c"]), JSON, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "c"]), JSON, max_size=3)), min_size=1, max_size=12))
def test_diff_matches_brute_force(spark, pairs):
    df = spark.createDataFrame([(i, json.dumps(o), json.dumps(n)) for i, (o, n) in enumerate(pairs)], "doc_id int, original string, optimized string")
    got = sorted((r.doc_id, r.path, r.status) for r in jsonld.jsonld_diff(df).collect())
    assert got == sorted((i, p, s) for i, (o, n) in enumerate(pairs) if n for p, s in brute_diff(o, n))


def brute_same_as(v):
    if isinstance(v, dict):
        return sum((len(x) if isinstance(x, list) else isinstance(x, str)) if k == "sameAs" else brute_same_as(x) for k, x in v.items())
    return sum(map(brute_same_as, v)) if isinstance(v, list) else 0


@QUICK
@given(st.lists(JSON, min_size=1, max_size=12))
def test_same_as_matches_brute_force(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "page_id int, block string")
    got = {r.page_id: r.same_as for r in jsonld.with_same_as(df).collect()}
    assert got == {i: brute_same_as(d) for i, d in enumerate(docs)}


def similarity(a, b):
    total = 0.0
    for t, tol in cluster.TOLERANCES.items():
        x, y = a[0][t], b[0][t]
        total += 1.0 if x == y == 0 else 0.0 if 0 in (x, y) else float(1 - tol <= x / y <= 1 + tol)
    pa, pb = a[2], b[2]
    same = sum(x == y for x, y in zip(pa, pb))
    url = 1.0 if not pa and not pb else 0.0 if not pa or not pb else same / len(pa) if len(pa) == len(pb) else same / max(len(pa), len(pb)) * 0.85
    sem = 0.0
    for k in cluster.COUNTED:
        x, y = a[1][k], b[1][k]
        r = x / y if y else 0
        sem += 1.0 if x == y == 0 else 0.0 if 0 in (x, y) else 1.0 if 0.8 <= r <= 1.2 else max(0, 1 - abs(r - 1) / 2)
    sem += 1.0 if a[1]["has_form"] == b[1]["has_form"] else 0.5
    ta, tb = set(a[1]["jsonld_types"]), set(b[1]["jsonld_types"])
    return 0.4 * (total / 7) + 0.3 * url + 0.3 * ((sem / 6 * 5 + (len(ta & tb) / len(ta | tb) if ta | tb else 1.0)) / 6)


SHAPES = ("page_id long, url string, site string, dom_structure struct<h1:int,h2:int,h3:int,article:int,section:int,form:int,table:int>, "
          "semantic_features struct<p:int,lists:int,images:int,has_form:int,buttons:int,jsonld_types:array<string>>, pattern array<string>")


@pytest.mark.parametrize("threshold,seed,hot", [(0.85, 1, False), (0.85, 2, True), (0.7, 3, True), (0.93, 4, True)])
def test_clusters_match_all_pairs(spark, threshold, seed, hot):
    rnd = random.Random(seed)
    rows = []
    for i in range(140):
        n = 3 if hot and i % 2 else rnd.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 13])
        pattern = [rnd.choice("ab") if j < 2 else rnd.choice(["a", "b", "{slug}", f"u{i}"]) for j in range(n)]
        tags = {t: rnd.choice([1, 5, 6]) if t in ("h2", "section") else rnd.choice([0, 1, 1, 1]) for t in cluster.TOLERANCES}
        sem = {"p": rnd.choice([0, 1, 10, 12, 40, 90]), "lists": rnd.choice([1, 2, 9]), "images": rnd.choice([0, 1, 30]), "has_form": int(tags["form"] > 0),
               "buttons": rnd.choice([0, 0, 3]), "jsonld_types": sorted(rnd.sample("AB", rnd.choice([0, 0, 1])))}
        rows.append((i, f"u{i}", f"s{i % 3 // 2}", tags, sem, pattern))
    # One template on two sites: never one cluster.
    rows += [(140 + i, f"u{140 + i}", f"s{i % 2}", *rows[0][3:]) for i in range(6)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][2] == rows[j][2] and similarity(rows[i][3:], rows[j][3:]) >= threshold}
    for i, j in sorted(pairs):
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    df = spark.createDataFrame(rows, SHAPES)
    clustered = cluster.cluster_pages(df, threshold)
    assert {r.page_id: (r.site, r.component) for r in clustered.collect()} == {i: (rows[i][2], find(i)) for i in range(len(rows))}

    sizes = {}
    for i in range(len(rows)):
        sizes.setdefault((rows[i][2], find(i)), []).append(i)
    want = [(site, k + 1, c) for site in ("s0", "s1") for k, (_, c) in enumerate(sorted((-len(v), c) for (s, c), v in sizes.items() if s == site))]
    assert sorted(tuple(r)[:3] for r in cluster.number_clusters(clustered).collect()) == want

    # One row per shape, and the exact pairs out of it.
    shapes = cluster.similar_shapes(df, threshold)
    sig = {}
    first = {i: sig.setdefault((rows[i][2], repr(rows[i][3:])), i) for i in range(len(rows))}
    assert {(r.sig, r.component) for r in shapes.collect()} == {(k, find(k)) for k in first.values()}
    exact = {tuple(sorted((first[i], first[j]))) for i, j in pairs if first[i] != first[j]}
    assert {(r.sig_a, r.sig_b) for r in cluster.pairs_within(shapes, threshold).collect()} == exact
    assert {(r.sig_a, r.sig_b) for r in cluster.similar_pairs(df, threshold).collect()} == exact


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbers_within_groups(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "a", "a", "a", None, "b", f"c{i}"]), rnd.randrange(1000), i) for i in range(900)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_in_groups(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), F.col("i")], "n").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for k in {r[0] for r in rows}:
        want |= {r[2]: n + 1 for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])))}
    assert {r.i: r.n for r in got} == want and len(got) == len(rows)


def test_picked_rows_are_broadcast_up_to_a_bound(spark):
    wide = spark.range(1000).selectExpr("id AS k", "repeat('x', 100) AS html")
    few = spark.createDataFrame([(5, "a"), (7, "b"), (5000, "c")], "k long, tag string")
    for most, kind in ((3, "BroadcastHashJoin"), (2, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = pick_rows(few, wide, "k", {"n": F.length("html")}, most)
            text = out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert kind in text and sorted((r.k, r.tag, r.n) for r in out.collect()) == [(5, "a", 100), (7, "b", 100)]


def test_components_match_union_find(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {v: v for v in [*range(200), *range(300, 361)]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(v,) for v in parent], "id long"))
    assert {r.id: r.component for r in got.collect()} == {v: find(v) for v in parent}


def test_upsert_is_idempotent(spark):
    rows = [(1, f"https://a.b/{i % 7}", "Guide", True, 2.0, -1.0, 5, 1, "", i) for i in range(20)]
    new = spark.createDataFrame(rows, "project_id long, url string, content_type string, has_jsonld boolean, jsonld_quality double, content_quality double, "
                                      "monthly_traffic long, backlinks long, last_modified string, batch long")
    empty = sitemap.clean_import(new).limit(0)
    once = sitemap.upsert_pages(empty, new)
    twice = sitemap.upsert_pages(once, new)
    assert once.count() == 7 and sorted(once.collect()) == sorted(twice.collect())


def test_row_numbers_and_top_k_on_a_hot_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    numbered = [(r.n, r.v) for r in with_row_number(df, ["v"], "n").collect()]
    assert [v for _, v in sorted(numbered)] == sorted(v for _, v in numbered) and sorted(n for n, _ in numbered) == list(range(1, 5001))
    assert top_k(df, ["k"], [F.col("v")], 3).filter("k = 0").count() == 3


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_concept_search_matches_brute_force(spark, most):
    rnd = random.Random(3)
    texts = [(i, f"b{i % 2}", "".join(rnd.choice("abC ") for _ in range(rnd.randrange(0, 25))) or None, "prefix " + "".join(rnd.choice("abc") for _ in range(9))) for i in range(60)]
    texts += [(60, "b0", "Prefix", "x" * 5000 + "Needle" + "y" * 5000), (61, "b0", None, None), (62, "b1", "a.c(", "É")]
    concepts = sorted({(f"b{i % 2}", "".join(rnd.choice("ABc ") for _ in range(rnd.randrange(1, 6)))) for i in range(40)} | {
        # All begin alike; only the later grams are rare.
        ("b0", "PREFIX " + "abc"), ("b0", "prefix zzz"), ("b0", "xneedley"), ("b0", ""), ("b1", "A.C("), ("b1", "é"), ("b1", "needle")})
    m = spark.createDataFrame(texts, "mention_id long, brand string, title string, descr string")
    got = [(r.brand, r.concept, r.mention_id) for r in offpage.matches(spark.createDataFrame(concepts, "brand string, concept string"), m, most).collect()]
    want = {(b, k, i) for b, k in concepts for i, mb, t, d in texts if k and mb == b and (k.lower() in (t or "").lower() or k.lower() in (d or "").lower())}
    assert set(got) == want and len(got) == len(want) and ("b0", "xneedley", 60) in want


@pytest.mark.parametrize("most", [1_000_000, 100, 0])
def test_concept_counts_are_made_where_texts_are_read(spark, monkeypatch, most):
    rnd, fixed, keep = random.Random(5), [], offpage.checkpoint

    def noted(df):
        out = keep(df)
        fixed.append(out.count() if "mention_id" in out.columns and "cid" in out.columns else 0)
        return out

    monkeypatch.setattr(offpage, "checkpoint", noted)
    monkeypatch.setattr(offpage, "PIECE", 150)
    draw = lambda letters, most: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, most)))
    # Every text of b0 holds "x y", most several times and beside different letters; an id that comes twice counts four times.
    texts = [(i, f"b{i % 2}", draw("ab  ", 12), draw("abé ", 40) + ("ax yb x y" if i % 2 == 0 else "") + draw("ab ", 30), f"https://h{i}/p") for i in range(400)]
    texts += [(400, "b0", "x y", None, "u"), (400, "b0", "x y", None, "u"), (None, "b0", "x y", "x y", "v"), (401, None, "x y", "x y", "v")]
    texts += [(402, "b1", "aLongWordOfManyLetters", "a b  a", "https://h/p"), (403, "b1", "the long tail of words", "of words the long tail", "https://h/p")]
    concepts = {(f"b{i % 2}", draw("abÉ  ", 9)) for i in range(150)} | {("b0", "X Y"), ("b0", "x y"), ("b1", "longwordofmanyletter"), ("b1", " "), ("b1", "  a"), ("b1", "tail of w"), ("b1", "long tail "), (None, "x"), ("b2", "x")}
    m = spark.createDataFrame(texts, "mention_id long, brand string, title string, descr string, url string")
    got = offpage.concept_mentions(spark.createDataFrame(sorted(concepts, key=str), "brand string, concept string"), m, most=most)
    got = sorted((r.brand, r.concept, r.mention_id, r.position, r.matches, r.host) for r in got.collect())
    want, ids = [], [t[0] for t in texts]
    for b, k in concepts:
        hits = sorted(i for i, mb, t, d, _ in texts if i is not None and b is not None and mb == b and (k.lower() in (t or "").lower() or k.lower() in (d or "").lower()) for _ in range(ids.count(i)))
        want += [(b, k, i, n, len(hits), (u.split("/") + [None, None])[2] or u) for n, i in enumerate(hits[:3], 1) for j, _, _, _, u in texts if j == i]
    assert got == sorted(want) and ("b0", "X Y", 0, 1, 204, "h0") in got
    # Three rows at most of a concept and a piece of a brand are written, not every match.
    assert max(fixed) <= 3 * 2 * len(concepts) < 0.3 * sum({(r[0], r[1]): r[4] for r in got}.values())


def test_contains_any_quotes_its_words(spark):
    df = spark.createDataFrame([("a.b",), ("axb",)], "x string")
    assert [r[0] for r in df.select(contains_any(F.col("x"), ["a.b", "(("])).collect()] == [True, False]
