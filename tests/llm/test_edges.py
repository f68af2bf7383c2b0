"""Nulls, empty and odd texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import decontaminate, neardup, quality, sharding, toolcalls
from corpusaudit.llm.fmindex import FmIndex
from corpusaudit.llm.queries import QUERIES


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", 0) for k, t in rows], "doc_id long, text string, id string, score string, n int")


ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (5, "word " * 40000), (6, "é 😀"), (7, "A b C d e f g h")]


# op 8

def test_jump_moves_only_to_the_new_shard():
    keys = np.arange(20000, dtype=np.uint64)
    before = sharding.jump(keys, 1)
    assert not before.any()
    for n in range(2, 20):
        after = sharding.jump(keys, n)
        assert ((after == before) | (after == n - 1)).all() and abs((after == n - 1).mean() - 1 / n) < 0.02
        before = after


def test_shards_edges(spark):
    got = sharding.shard_documents(docs_of(spark, ROWS), 4).collect()
    assert len(got) == len(ROWS)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    assert {r.size for r in got if r.doc_id == 1} == {1}
    assert sharding.shard_documents(docs_of(spark, ROWS).limit(0)).count() == 0


def test_shards_of_text_keys(spark):
    """Keys that are no integers go by their hash; an empty key is a key, a null one is hashed as 0."""
    rows = [(f"https://site.example/{i}", f"text {i}") for i in range(300)] + [(None, "none"), ("", "empty"), ("7", "a number as text")] + [("twice", "same")] * 2
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sharding.shard_documents(df, 8).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()} | {None: 0}
    for n, of in ((8, "shard"), (9, "grown_shard")):
        want = sharding.jump(np.array([hashes[r.doc_id] for r in got], np.int64).view(np.uint64), n).tolist()
        assert [r[of] for r in got] == want
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.shard for r in got} == set(range(8))


# op 3

def brute_groups(rows, size, num, den):
    sets = {}
    for k, t in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[k] = {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: (len(sets[k]), top(k)) for k in ids}


@pytest.mark.parametrize("size,num,den,bounds", [(3, 85, 100, {}), (5, 4, 5, {}), (3, 85, 100, {"CROWD": 4, "CENTRES": 3, "DRAWN": 2}), (5, 4, 5, {"SETS": 300, "CENTRES": 2, "DRAWN": 1, "SLICE": 900})])
def test_families_of_copies(spark, monkeypatch, size, num, den, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(neardup, name, value)
    rnd = random.Random(size)
    rows, key = [], 0
    for family in range(6):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([8, 30, 120, 400]))]
        for _ in range(30):
            copy = base[:]
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(9999)}"
            rows.append((key := key + 1, " ".join(copy)))
    rnd.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), size, (num, den)).collect()}
    assert got == brute_groups(rows, size, num, den)


def test_near_duplicates_edges(spark):
    got = sorted((tuple(r)[:4] for r in neardup.near_duplicates(docs_of(spark, ROWS)).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, None, True), (5, 1, 5, True), (6, 1, 6, True), (7, 4, 7, True)]
    assert got == sorted(want, key=repr)
    assert neardup.near_duplicates(docs_of(spark, ROWS).limit(0)).count() == 0
    with pytest.raises(ValueError, match="bins"):
        neardup.near_duplicates(docs_of(spark, ROWS), similar=(1, 2))


def test_rows_of_one_key_are_one_document(spark):
    rows = [(1, "a a a"), (5, "a a a"), (5, "b b b"), (7, "b b b"), (9, "c"), (8, "c"), (9, "d"), (3, "d")]
    by_key = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), 3).collect())
    assert by_key == [(1, 1), (3, 3), (5, 1), (5, 1), (7, 1), (8, 3), (9, 3), (9, 3)]
    alone = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), 3, by_key=False).collect())
    assert alone == [(1, 1), (3, 3), (5, 1), (5, 5), (7, 5), (8, 8), (9, 3), (9, 8)]


def unlinked(n, words=120, other=7):
    """Texts that share most of their words, but too few for a link."""
    rnd = random.Random(n)
    base = [f"w{rnd.randrange(4000)}" for _ in range(words)]
    rows = []
    for k in range(n):
        begin = rnd.randrange(words - other)
        rows.append((k + 1, " ".join(base[:begin] + [f"v{k}x{i}" for i in range(other)] + base[begin + other:])))
    return rows


def test_a_pair_is_confirmed_once(spark, monkeypatch, tmp_path):
    """However many buckets of however many rounds it meets in, and its texts move no more often."""
    real = neardup._confirm

    def counted(*args):
        run = real(*args)

        def whole(batches):
            for batch in batches:
                (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
                yield from run(iter([batch]))
        return whole

    monkeypatch.setattr(neardup, "_confirm", counted)
    rows = [r for family in range(4) for r in [(k + 2 * family, t.replace("w", f"f{family}w")) for k, t in unlinked(2)]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), 3, (85, 100)).collect()}
    assert got == brute_groups(rows, 3, 85, 100) and all(k == c for k, (_, c) in got.items())
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == len(rows)


@pytest.mark.parametrize("paired", [0, 2, 5, 256])
def test_pairs_of_small_buckets(spark, monkeypatch, paired):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    rows = unlinked(12) + [(k + 50, t) for k, t in unlinked(9, 120, 3)] + [(k + 80, t) for k, t in unlinked(9, 60, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), 3, (85, 100)).collect()}
    assert got == brute_groups(rows, 3, 85, 100)


def test_crowded_buckets(spark):
    """Whole buckets that hold several rows, none that holds one, whatever cells they share."""
    rows = [(b - 5000, c) for b in range(10000) for c in range(1 + (b % 7 == 0) + 3 * (b % 100 == 0))]
    placed = spark.createDataFrame(rows, "bucket long, class long")
    many = {b for b, c in rows if c}
    for most in (1, 300, 1 << 20):
        got = sorted((r["bucket"], r["class"]) for r in neardup._crowded(placed, most).collect())
        assert got == sorted((b, c) for b, c in rows if b in many)
    assert neardup._crowded(placed.limit(0), 0).count() == 0


# op 6

def test_fm_index_finds_all_occurrences():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        text = rnd.integers(0, 5, 300)
        index = FmIndex(text)
        phrases = rnd.integers(1, 6, (40, 4))
        lens = rnd.integers(1, 5, 40)
        low, high = index.search(phrases, lens)
        for p, n, s, e in zip(phrases, lens, low, high):
            want = [i for i in range(300 - n + 1) if (text[i:i + n] == p[4 - n:]).all()]
            assert sorted(index.locate(np.arange(s, e)).tolist() if s < e else []) == want


def test_benchmark_edges(spark, monkeypatch):
    long_item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, long_item), (2, "One, two"), (3, None), (4, " .. "), (None, "F g"), (2, "solo")], "item_id long, text string")
    rows = [*ROWS, (10, "x " + long_item.upper() + " y"), (11, " ".join(f"q{i}" for i in range(12))), (12, "one two one TWO. solo")]
    df = docs_of(spark, rows).withColumn("n_hit", F.lit("clash"))
    plain = sorted((tuple(r) for r in decontaminate.find_benchmark(df, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated", "spans").collect()), key=repr)
    by = {r[0]: r for r in plain}
    assert by[10][1:5] == (22, 20, ["1"], True) and by[11][2] == 0 and by[12][1:5] == (5, 5, ["2"], True)
    assert by[7][1:5] == (8, 2, ["null"], True) and by[1][1:5] == (0, 0, [], False) and len(plain) == len(rows)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 8)
    again = sorted((tuple(r) for r in decontaminate.find_benchmark(df, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated", "spans").collect()), key=repr)
    assert again == plain
    assert decontaminate.find_benchmark(df.limit(0), bench).count() == 0
    assert decontaminate.find_benchmark(df, bench.limit(0)).filter("contaminated").count() == 0


# op 1

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(got) > 500 and sum(right) / len(right) > 0.98
    assert sum(r.quality == 1 and r.predicted == 0 for r in got) <= len(got) / 200


def test_quality_edges(spark):
    docs = docs_of(spark, ROWS)
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (99, 0)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(docs.limit(0), labels.limit(0)).count() == 0
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score_documents(docs, labels.limit(0)).collect())
    model = quality.train(docs, labels)
    assert quality.score(docs, model).columns == ["doc_id", "text", "id", "n", "score"]


# op 5

def test_tool_calls_edges(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", None, "t", '{"x": 1}', "p"), (1, 1, "b", "a", "t", None, "p"), (1, 2, "c", "d", "t", '{"x":"no"}', "p"), (1, 3, "d", "c", "t", "{}", "p"),
        (1, 4, None, "b", "t", '{"x":2,"a":null}', "p"), (None, 5, "a", "zz", "u", "{}", "p"), (1, 6, "e", "c", None, '{"x":3}', "p")],
        "conv_id long, turn int, call_id string, after string, tool string, arguments string, position string")
    results = spark.createDataFrame([("a", 9, "late"), ("a", 2, "first"), (None, 1, "lost"), ("zz", 1, "orphan"), ("c", 1, None)], "call_id string, turn int, content string")
    schemas = spark.createDataFrame([("t", "x", "BIGINT", True)], "tool string, field string, type string, required boolean")
    got = {r.turn: r for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert len(got) == 7
    assert (got[0].status, got[0].depth, got[0].n_results, got[0].message) == ("ok", 0, 2, '{"arguments":{"x":1},"call_id":"a","result":"first","tool":"t"}')
    assert (got[1].status, got[1].depth, got[1].errors) == ("invalid", 1, ["not an object"])
    assert got[2].status == got[3].status == got[6].status == "cyclic" and got[2].errors == ["x is not BIGINT"] and got[3].errors == ["missing x"]
    assert (got[4].depth, got[4].errors) == (2, ["unknown a"]) and got[5].errors == ["unknown tool"] == got[6].errors
    assert sorted(r.position for r in got.values() if r.conv_id == 1) == list(range(6)) and [got[t].position for t in (0, 1, 4)] == [0, 1, 2]
    assert toolcalls.link_calls(calls.limit(0), results, schemas).count() == 0


def test_tool_calls_run_no_python(spark, sf_dir):
    text = QUERIES["op5_tool_calls"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def test_long_chains_take_few_rounds(spark):
    calls = spark.range(3000).selectExpr("1 as conv_id", "cast(id as int) as turn", "concat('c', id) as call_id", "concat('c', id - 1) as after", "'t' as tool", "'{}' as arguments")
    results = spark.createDataFrame([], "call_id string, turn int, content string")
    schemas = spark.createDataFrame([("t", "x", "BIGINT", False)], "tool string, field string, type string, required boolean")
    got = toolcalls.link_calls(calls, results, schemas).select("turn", "depth", "position").collect()
    assert all(r.turn == r.depth == r.position for r in got) and len(got) == 3000


def test_positions_of_many_groups_are_not_broadcast(spark):
    rows = [(None if i % 50 == 7 else i % 50 if i % 3 else 0, i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sharding.with_slot(df, "conv_id", ["turn"])
        got = {(r.conv_id, r.turn): r.slot for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and "NestedLoop" not in plan
    want = {}
    for c in {c for c, _ in rows}:
        want |= {(c, t): i for i, t in enumerate(sorted(t for g, t in rows if g == c))}
    assert got == want and len(got) == len(rows)


def test_near_duplicates_compare_the_same_classes_once_a_round(spark, tmp_path, monkeypatch):
    # Two texts that share buckets in many bands without being similar enough: each round compares them at most once.
    words = [f"w{i}" for i in range(400)]
    other = [f"x{i}" if i % 40 == 7 else w for i, w in enumerate(words)]
    rounds, real, merged = [], neardup._confirm, neardup._merged

    def counted(*args):
        run = real(*args)

        def whole(batches):
            held = list(batches)
            (tmp_path / uuid.uuid4().hex).write_text(str(sum(b.num_rows for b in held)))
            yield from run(iter(held))
        return whole

    monkeypatch.setattr(neardup, "_confirm", counted)
    monkeypatch.setattr(neardup, "_merged", lambda labels, links: rounds.append(1) or merged(labels, links))
    got = neardup.near_duplicates(docs_of(spark, [(1, " ".join(words)), (2, " ".join(other))]), similar=(4, 5), by_key=False)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2)]
    assert 0 < len(rounds) <= 3
    assert 0 < sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 2 * len(rounds)


def test_only_texts_of_candidates_move(spark, monkeypatch):
    base = spark.range(200_000, numPartitions=3).select((F.monotonically_increasing_id()).alias("row"), F.col("id").cast("string").cast("binary").alias("body"))
    rows = base.select("row").filter("row % 7 = 0 or row in (0, 1, 32767, 32768, 32769)").withColumnRenamed("row", "class")
    members = rows.union(rows)
    expected = sorted(map(tuple, base.join(rows, base["row"] == rows["class"]).select("class", "body").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = neardup._bodies(base, members)
        assert sorted(map(tuple, found.collect())) == expected and len(expected) > 28_000
        assert "hashpartitioning" not in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert neardup._bodies(base, members.limit(0)).count() == 0
        monkeypatch.setattr(neardup, "CHUNKS", 1)
        assert sorted(map(tuple, neardup._bodies(base, members).collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_duplicates_sweep_the_driver_between_rounds(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    words = [f"w{i}" for i in range(60)]
    before = whole()
    got = neardup.near_duplicates(docs_of(spark, [(1, " ".join(words)), (2, " ".join(words) + " x"), (3, "other words altogether")]), similar=(4, 5))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert whole() - before >= 4


def test_the_bitmap_of_crowded_buckets_is_bounded(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("class"), F.lit(0).alias("band"), F.xxhash64(F.col("id") % 2000).alias("bucket"))
    highest, real = [], neardup._marked
    monkeypatch.setattr(neardup, "_marked", lambda rows, wanted, number: highest.append(wanted.agg(F.max(number)).first()[0]) or real(rows, wanted, number))
    got = sorted(r["class"] for r in neardup._crowded(rows, 1 << 40).collect())
    assert got == [*range(1000), *range(2000, 3000)]
    # 16 MB of bits, however many buckets there are.
    assert 1 << 20 < highest[0] < 1 << 27
