"""Order MinHash against a plain loop over the definition."""

from __future__ import annotations

import hashlib
import random

import pytest

from corpusaudit.llm import ordermin
from corpusaudit.llm.queries import QUERIES


def brute(rows):
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        f, g, h = map(ordermin.fingerprint, (text, changed, following))
        out[key] = (key, len(text), hashlib.sha256(changed.encode()).hexdigest(), ordermin.hexed(f), ordermin.hexed(g), ordermin.likeness(f, g), ordermin.likeness(f, h))
    return out


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in QUERIES["op9_order_min_hash"](spark, sf_dir).collect()}
    assert got == brute(rows)
    far = [g[5] for g in got.values() if g[1] > 200]
    assert sum(far) / len(far) > 0.15 and all(0 <= x <= 1 for x in far)


def test_likeness_falls_with_edits_and_with_order():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400))
    ws = text.split()
    base = ordermin.fingerprint(text)
    some, many = ws[:], ws[:]
    some[50], many[::4] = "changed", ["other"] * 100
    swapped = ordermin.fingerprint(" ".join(ws[200:] + ws[:200]))
    assert ordermin.likeness(base, base) == 1
    assert ordermin.likeness(base, ordermin.fingerprint(" ".join(some))) > ordermin.likeness(base, ordermin.fingerprint(" ".join(many)))
    # The k-mers of a rotated text are nearly the same; only their order differs.
    assert 0.2 < ordermin.likeness(base, swapped) < 0.9


def test_nulls_ties_short_and_single(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "a" * 3000), (5, "é😀" * 50), (6, "ab")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, part string")
    assert {r.doc_id: tuple(r) for r in ordermin.order_min_hash(df).collect()} == brute(rows)
    one = ordermin.order_min_hash(df.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    same = spark.createDataFrame([(7, "x y"), (7, "x y"), (7, "z"), (None, "z")], "doc_id long, text string")
    assert ordermin.order_min_hash(same).count() == 4
    assert ordermin.order_min_hash(df.limit(0)).count() == 0
    assert (ordermin.fingerprint("ab") == ordermin.fingerprint("ab")).all()


def plain(text):
    """The fingerprint by a plain loop: numbered k-mers, the two of least value per tuple, in text order."""
    mask, odd = (1 << 64) - 1, 0x9FB21C651E98DF25

    def mixed(x, seed=0):
        x ^= seed
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    grams = [text[i:i + ordermin.K] for i in range(max(len(text) - ordermin.K + 1, min(len(text), 1)))]
    if not grams:
        return [0] * ordermin.TUPLES
    hashes, seen, numbered = [], {}, []
    drop = len(grams).bit_length()
    for g in grams:
        h = 0
        for c in g:
            h = (h * odd + ord(c) + 1) & mask
        h = mixed(h)
        # Occurrences are numbered among k-mers whose hashes agree but for the bits that hold a place.
        n = seen.get(h >> drop, 0)
        seen[h >> drop] = n + 1
        hashes.append(h)
        numbered.append(mixed((h + n * 0xD6E8FEB86659FD93) & mask) >> 32)
    out = []
    seeds = [mixed(i, 0x0DDB1A5E5BAD5EED) & 0xFFFFFFFF for i in range(2 * ordermin.TUPLES)]
    for xor, times in zip(seeds[:ordermin.TUPLES], seeds[ordermin.TUPLES:]):
        value = [((x ^ xor) * (times | 1) & 0xFFFFFFFF, i) for i, x in enumerate(numbered)]
        chosen = sorted(i for _, i in sorted(value)[:ordermin.CHOSEN])
        made = len(chosen)
        for step, i in enumerate(chosen):
            made = mixed((made * odd + hashes[i]) & mask, step + 1)
        out.append(max(made >> 32, 1))
    return out


def test_fingerprint_by_plain_loop():
    rnd = random.Random(9)
    for text in ("", "a", "ab", "abcdef", "abcdefg", "a" * 500, "é😀" * 60, "".join(rnd.choice("ab") for _ in range(700)), "".join(rnd.choice("abcdefghij klm") for _ in range(3000))):
        assert ordermin.fingerprint(text).tolist() == plain(text)


def test_keys_of_text_and_partitions_without_documents(spark):
    rnd = random.Random(4)
    rows = [(f"k{i:03d}", "".join(rnd.choice("abc ") for _ in range(rnd.randrange(90)))) for i in range(150)]
    assert {r.doc_id: tuple(r) for r in ordermin.order_min_hash(spark.createDataFrame(rows, "doc_id string, text string")).collect()} == brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        few = [(i, t) for i, (_, t) in enumerate(rows[:25])]
        assert {r.doc_id: tuple(r) for r in ordermin.order_min_hash(spark.createDataFrame(few, "doc_id long, text string")).collect()} == brute(few)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_key_and_equal_rows(spark):
    """Rows of one key follow each other, equal ones too; each row is followed by exactly one other."""
    rows = [(5, f"text number {i % 40} of one key " * 3) for i in range(400)] + [(4, "before"), (6, "after"), (None, "last of all")]
    out = ordermin.order_min_hash(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(k) for k, _ in rows)
    # Of ten equal rows nine are followed by an equal one.
    assert sum(r.near_next == 1 for r in out if r.doc_id == 5) == 360
    of = {r.doc_id: r for r in out if r.doc_id != 5}
    edited = ordermin.edited("last of all", "after")
    assert of[None].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert of[4].edited_sha256 == hashlib.sha256(ordermin.edited("before", "last of all").encode()).hexdigest()


def test_plan_names_no_split_points(spark, sf_dir):
    plan = QUERIES["op9_order_min_hash"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and len(plan) < 40_000


@pytest.mark.parametrize("n", [96, 97, 500])
def test_threshold_selects_as_sorting(n, monkeypatch):
    text = "".join(random.Random(n).choice("abcd") for _ in range(n + ordermin.K - 1))
    quick = ordermin.fingerprint(text)
    monkeypatch.setattr(ordermin, "EXPECTED", 10 ** 6)
    assert (quick == ordermin.fingerprint(text)).all()
