"""SimHash near-duplicates: fingerprints meet over segments with one bit left open, and every meeting is verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.plans.graph import components
from corpusaudit.plans.shapes import checkpoint

from .arrays import expand, raw, slices

#: Differing bits of a link, and seed of the shingle hash.
DISTANCE, SEED = 3, 42
#: Bytes of text and shingles handled at once, members of a bucket that are compared with each other, and pairs compared at once.
SLICE, SHINGLES, CROWD, PAIRS = 1 << 20, 1 << 16, 1024, 1 << 20


def fingerprints(texts: pa.Array, size: int = 3) -> np.ndarray:
    """64-bit SimHash of every text: a bit is set if it is set in over half of the XXH64 values of the word shingles, repeats included.

    Words are runs of bytes other than white space, A-Z in lower case; shingles join them by one space. Fewer words than ``size``
    are one shingle; without words the fingerprint is 0.
    """
    body, offsets = raw(texts)
    data, bounds = body.tobytes(), offsets.tolist()
    out = np.zeros(len(texts), np.uint64)
    for k, (b, e) in enumerate(zip(bounds[:-1], bounds[1:])):
        split = data[b:e].lower().split()
        if not split:
            continue
        line = b" ".join(split)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        ends = ends[size - 1:].tolist() if len(split) >= size else [len(line)]
        ones = np.zeros(64, np.int64)
        for at in range(0, len(ends), SHINGLES):
            some = ends[at:at + SHINGLES]
            hashes = np.fromiter((xxhash.xxh64_intdigest(line[x:y], SEED) for x, y in zip(begins[at:at + len(some)].tolist(), some)), np.uint64, len(some))
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(ends), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), size).view(np.int64))], ["id", "fp"])
    return run


def groups_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0 .. n - 1 with edges a-b: the smallest vertex of each one's component."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return low


def _near(values: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the values of equal runs (sorted), as star edges (value, smallest value linked to it, at once or through others)."""
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(begin, len(run)))
    low = np.arange(len(values))
    small = np.flatnonzero((size > 1) & (size <= CROWD))
    work = np.cumsum(size[small] ** 2) // PAIRS
    for w in np.unique(work):
        some = small[work == w]
        # Each member meets those after it in its run.
        member, place = expand(size[some])
        first = begin[some][member] + place
        one, step = expand(size[some][member] - 1 - place)
        x, y = first[one], first[one] + 1 + step
        linked = np.bitwise_count(values[x] ^ values[y]) <= DISTANCE
        low = np.minimum(low, groups_of(x[linked], y[linked], len(values)))
    for s in np.flatnonzero(size > CROWD):
        at = slice(begin[s], begin[s] + size[s])
        low[at] = begin[s] + _crowd(values[at])
    moved = np.flatnonzero(low != np.arange(len(values)))
    return values[moved], values[low[moved]]


def _crowd(values: np.ndarray) -> np.ndarray:
    """Components of many distinct sorted values: each looks up what differs from it in up to three of the bits that vary at all."""
    free = [int(b) for b in range(64) if len(np.unique((values >> np.uint64(b)) & np.uint64(1))) > 1]
    low = np.arange(len(values))
    for k in range(1, DISTANCE + 1):
        for bits in combinations(free, k):
            other = values ^ np.uint64(sum(1 << b for b in bits))
            at = np.searchsorted(values, other).clip(max=len(values) - 1)
            here = np.flatnonzero((values[at] == other) & (low[at] != low))
            if len(here):
                low = groups_of(np.concatenate([here, np.arange(len(low))]), np.concatenate([at[here], low]), len(values))
    return low


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of every bucket; buckets come whole and sorted, across batches."""
    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if len(held[0]) < 1 << 16:
            continue
        last = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(last):
            cut = int(last[-1]) + 1
            yield _edges([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield _edges(held)


def _edges(rows: list[np.ndarray]) -> pa.RecordBatch:
    new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
    a, b = _near(rows[2].view(np.uint64), np.cumsum(new))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _solved(members: DataFrame) -> DataFrame:
    keys = ["key", "sub"]
    return members.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_links, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints ``fp`` (distinct) whose distance is at most three, directly or through others.

    Cut into two segments of 32 bits, one of two linked fingerprints differs by at most one bit. So each fingerprint is indexed under either
    segment whole and with each of its bits left open: 66 rows. A bucket with an open bit matters only if both values of that bit meet in it.
    Buckets of more than ``CROWD`` members are never gathered: their members are indexed again under the halves of the other segment, whole and with one bit
    open, since one of those differs by at most one bit too. Such a bucket fixes all but 18 bits, so it has at most 2^18 members, and each
    member looks up its neighbours instead of meeting all others. A bucket yields one edge per member, never its pairs.
    """
    coded = distinct.selectExpr("fp", "explode(sequence(0, 65)) AS code").selectExpr(
        "fp", "code", "code >= 33 AS high", "CASE WHEN code >= 33 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END AS part",
        "CASE WHEN code % 33 < 32 THEN shiftleft(1L, code % 33) ELSE 0L END AS left_open")
    row = coded.selectExpr("fp", "high", "shiftleft(cast(code AS bigint), 32) + (part & ~left_open) AS key", "(part & left_open) <> 0 AS side", "left_open = 0 AS whole")
    counts = row.groupBy("key").agg(F.count("*").alias("size"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.any_value("whole").alias("whole"))
    met = checkpoint(counts.filter("size > 1 AND (whole OR lo <> hi)").select("key", "size"))
    members = checkpoint(row.join(met, "key").select("key", "fp", "high", "size"))
    few = members.filter(F.col("size") <= CROWD).withColumn("sub", F.lit(0))
    halved = members.filter(F.col("size") > CROWD).selectExpr(
        "key", "fp", "CASE WHEN high THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END AS other", "explode(sequence(0, 33)) AS code").selectExpr(
        "key", "fp", "code", "cast(CASE WHEN code >= 17 THEN shiftright(other, 16) ELSE other & 65535 END AS int) AS half",
        "CASE WHEN code % 17 < 16 THEN shiftleft(1, code % 17) ELSE 0 END AS left_open")
    crowded = halved.selectExpr("key", "fp", "shiftleft(code, 16) + (half & ~left_open) AS sub")
    paired = crowded.groupBy("key", "sub").agg(F.count("*").alias("n")).filter("n > 1").select("key", "sub")
    return _solved(few).unionByName(_solved(crowded.join(paired, ["key", "sub"], "left_semi"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most three bits, links taken together: (key, fingerprint, component_id).

    ``component_id`` is the smallest key reachable. Texts without words have fingerprint 0 and are linked like any other. Rows that share a key are one
    document: its fingerprints are linked, and each row keeps its own. A row with a null key is linked by its text like any other but is never the smallest;
    its component is null where no row with a key is in it. Other columns play no part, whatever their names.

    Equal fingerprints collapse first, however many there are; only distinct ones are indexed.
    """
    rows = checkpoint(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _fingerprint(size), f"id {docs.schema[key].dataType.simpleString()}, fp long"))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(classes.select("fp"))
    # Rows of one key but several fingerprints.
    several = rows.filter("id is not null").groupBy("id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    own = rows.join(several, "id").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    edges = checkpoint(found.unionByName(own))
    touched = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    group = components(edges, touched).select(F.col("id").alias("fp"), F.col("component").alias("group"))
    grouped = classes.join(group, "fp", "left").select("fp", "least", F.coalesce("group", "fp").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "group").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
