"""Prefix trie of conversations, and totals of its subtrees by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.plans.shapes import checkpoint

from .sharding import with_slot

#: Weight (turns of members) up to which a component is split further inside one task, and characters of one packed piece of ids.
LOCAL, PIECE = 1 << 17, 1 << 20
#: Fixed values of the rebuilding: conversations in a family, and the bound of turns they may share.
FAMILY, SHARED = 5, 9
LANES = ["s0", "s1", "s2", "s3"]


def rebuild(conversations: DataFrame) -> DataFrame:
    """Rebuilt conversations as (c, d, digest, bytes, size): turn d = 1 .. size of conversation c, and a row d = 0 without a text for each.

    The first turns come from the family's first conversation c - c % 5, as many of its turns as ``crc32(c) % 9`` says; then c's own turns follow after
    as many of its own were left out. A conversation with many turns spans many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    own = checkpoint(with_slot(own, "c", ["turn", "digest"], "at").drop("turn"))
    shared = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(SHARED))
    first = F.col("c") - F.pmod("c", F.lit(FAMILY))
    counts = checkpoint(own.groupBy("c").agg((F.max("at") + 1).alias("n")))
    of_first = counts.select(F.col("c").alias("first"), F.col("n").alias("n_first"))
    plan = counts.select("c", "n", shared.alias("h"), first.alias("first")).join(of_first, "first", "left")
    lent = F.least("h", F.coalesce("n_first", F.lit(0)))
    plan = plan.select("c", "first", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    heads = own.filter(F.col("at") < SHARED).select(F.col("c").alias("first"), "at", "digest", "bytes")
    borrowed = plan.join(heads, "first").filter("at < lent").select("c", (F.col("at") + 1).alias("d"), "digest", "bytes", "size")
    rest = own.join(plan, "c").filter("at >= h").select("c", (F.col("lent") + F.col("at") - F.col("h") + 1).alias("d"), "digest", "bytes", "size")
    starts = plan.select("c", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "size")
    return starts.unionByName(borrowed).unionByName(rest)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the lanes within a conversation, over the sorted rows of one partition."""
    last, carried = None, np.zeros(len(LANES), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(0).to_numpy()
        lanes = np.stack([batch.column(k).to_numpy() for k in range(1, 1 + len(LANES))])
        total = lanes.cumsum(1)
        new = np.concatenate([[c[0] != last], c[1:] != c[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
        base = np.where(head >= 0, total[:, head.clip(0)] - lanes[:, head.clip(0)], -carried[:, None])
        total -= base
        last, carried = c[-1], total[:, -1].copy()
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in total], *[batch.column(k) for k in range(1, batch.num_columns)]],
                                         ["c", *LANES, *[f"own{k}" for k in range(len(LANES))], *batch.schema.names[1 + len(LANES):]])


def _name(lanes: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *lanes, depth).cast("binary")))


def paths(rebuilt: DataFrame) -> DataFrame:
    """Every rebuilt turn with the identity of its whole prefix: (c, d, node, parent, bytes, size).

    A prefix is the sum of the hashes of its (depth, turn) pairs, in four lanes of 32 bits each. So it is a running sum: rows are
    range-partitioned by (conversation, depth), summed piece by piece, and a conversation that goes on in further partitions gets the sum of those before.
    """
    lanes = []
    for seed in (17, 71):
        h = F.xxhash64(F.lit(seed), "d", "digest")
        lanes += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    empty = F.col("digest").isNull()
    coded = rebuilt.select("c", *[F.when(empty, F.lit(0).cast("long")).otherwise(x).alias(n) for x, n in zip(lanes, LANES)], "d", "bytes", "size")
    sorted_ = coded.repartitionByRange("c", "d").sortWithinPartitions("c", "d")
    owned = [f"own{k}" for k in range(len(LANES))]
    fixed = checkpoint(sorted_.mapInArrow(_running, ", ".join(f"{x} long" for x in ["c", *LANES, *owned, "d", "bytes", "size"])).withColumn("piece", F.spark_partition_id()))
    pieces = fixed.groupBy("c", "piece").agg(F.max(F.struct("d", *LANES)).alias("last"))
    before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # A partition has at most one conversation that began in an earlier one: one row per partition at most.
    offsets = pieces.select("c", "piece", *[F.sum(f"last.{x}").over(before).alias(f"_{x}") for x in LANES]).filter("_s0 is not null")
    joined = fixed.join(F.broadcast(offsets), ["c", "piece"], "left")
    here = [F.col(x) + F.coalesce(f"_{x}", F.lit(0)) for x in LANES]
    above = [x - F.col(o) for x, o in zip(here, owned)]
    return joined.select("c", "d", _name(here, F.col("d")).alias("node"), F.when(F.col("d") > 0, _name(above, F.col("d") - 1)).alias("parent"), "bytes", "size")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of each node's conversation ids ``c``, ascending, joined by commas.

    Ids are sorted over all tasks and packed into long pieces there, so the one task that must hash a node's ids in their order reads few rows and keeps one.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, node, first, ids, size = [], None, 0, [], 0
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or size > PIECE:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, size = n, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if ids:
                out.append((node, first, ",".join(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == node:
                    running.update(b"," + ids.encode())
                else:
                    if running:
                        done.append((node, running.hexdigest()))
                    node, running = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.string())], ["node", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["node", "ends_sha256"])

    packed = ends.select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(pack, "node binary, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def tree(walks: DataFrame) -> DataFrame:
    """One row per node: node, parent, d, conv_id (smallest member), parent_conv_id, n_convs, n_children, bytes, weight.

    ``weight`` is the number of members' turns from this node on, which is the sum of ``n_convs`` over its subtree.
    """
    nodes = checkpoint(walks.groupBy("node", "d").agg(
        F.any_value("parent").alias("parent"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("bytes").alias("bytes"),
        F.sum(F.col("size") - F.col("d") + 1).alias("weight")))
    children = nodes.filter("d > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(children, "node", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def subtree_totals(nodes: DataFrame, walks: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``nodes`` with the sums of ``values`` over every subtree, by centroid decomposition of the parent edges.

    A component is a connected part of the forest; weights inside it strictly fall from its top downwards. Nodes with more than half of its
    weight beneath them are one path from the top, and the last of them is the centroid. What lies from the centroid down is summed once, and the sum is added to
    all nodes of that path; a node and its descendant are so counted together in the one component whose centroid lies between them. Then the centroid goes: its
    children head components of their own, the rest loses its weight, and no part keeps more than half. Rounds grow with the logarithm of the weight, not with the depth.

    Components heavier than ``LOCAL`` are split by rounds over the table; a node finds its new component by one look at its smallest member's path, just below
    the centroid. All others are split to the end, by the same rounds, inside tasks that read whole components.
    """
    names = list(values)
    parts = checkpoint(nodes.select("*", *[v.cast("long").alias(f"_{n}") for n, v in values.items()], *[F.lit(0).cast("long").alias(n) for n in names],
                                    _name([F.lit(0)] * len(LANES), F.lit(0)).alias("top")))
    columns, steps = parts.columns, walks.select(F.col("c").alias("conv_id"), F.col("d").alias("below"), F.col("node").alias("child"), F.col("parent").alias("above"))
    done, small = [], []
    while True:
        crowded = checkpoint(parts.groupBy("top").agg(F.max("weight").alias("total")).filter(F.col("total") > LOCAL))
        small.append(parts.join(crowded, "top", "left_anti").select(*columns))
        if crowded.isEmpty():
            break
        inside = parts.join(crowded, "top").withColumn("on_path", 2 * F.col("weight") > F.col("total"))
        centres = inside.filter("on_path").groupBy("top").agg(F.min(F.struct("weight", "d", "node")).alias("centre"))
        looked = inside.join(centres, "top").withColumn("below", F.col("centre.d") + 1).join(steps, ["conv_id", "below"], "left")
        is_centre, beneath = F.col("node") == F.col("centre.node"), (F.col("d") > F.col("centre.d")) & (F.col("above") == F.col("centre.node"))
        looked = checkpoint(looked.withColumn("is_centre", is_centre).withColumn("beneath", F.coalesce(beneath, F.lit(False))))
        sums = looked.filter("is_centre OR beneath").groupBy("top").agg(*[F.sum(f"_{n}").alias(f"sum_{n}") for n in names])
        new = {n: F.col(n) + F.when(F.col("on_path"), F.col(f"sum_{n}")).otherwise(0) for n in names}
        new["weight"] = F.col("weight") - F.when(F.col("on_path") & ~F.col("is_centre"), F.col("centre.weight")).otherwise(0)
        new["top"] = F.when(F.col("beneath"), F.col("child")).otherwise(F.col("top"))
        split = checkpoint(looked.join(sums, "top").select(*[new.get(c, F.col(c)).alias(c) for c in columns], "is_centre"))
        done.append(split.filter("is_centre").select(*columns))
        parts = split.filter("NOT is_centre").select(*columns)
    for more in small[1:]:
        small[0] = small[0].unionByName(more)
    out = small[0].repartition("top").sortWithinPartitions("top").mapInArrow(_split(names), small[0].schema)
    for more in done:
        out = out.unionByName(more)
    return out.drop("top", *[f"_{n}" for n in names])


def _split(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components come whole and one after the other, across batches."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= LOCAL:
                begins = np.flatnonzero(_heads(held))
                yield from _decompose(held.slice(0, begins[-1]), names)
                held = held.slice(begins[-1])
        if held is not None:
            yield from _decompose(held, names)
    return run


def _heads(table: pa.Table) -> np.ndarray:
    """Which rows begin another component."""
    if table.num_rows < 2:
        return np.ones(table.num_rows, bool)
    top = table["top"].combine_chunks()
    return np.concatenate([[True], pc.not_equal(top.slice(1), top.slice(0, len(top) - 1)).to_numpy(zero_copy_only=False)])


def _decompose(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """All rounds of all components of a table, at once."""
    if not table.num_rows:
        return
    read = lambda name: table[name].fill_null(-1).to_numpy().astype(np.int64)
    n, part = table.num_rows, np.cumsum(_heads(table)) - 1
    d, weight, owner = read("d"), read("weight").copy(), read("conv_id")
    # A node is its smallest member and its depth; so is its parent.
    ids, own = np.unique(owner, return_inverse=True)
    lifted = read("parent_conv_id")
    above = np.searchsorted(ids, lifted).clip(max=len(ids) - 1)
    step = int(d.max()) + 2
    place = own * step + d
    order = np.argsort(place)
    wanted = above * step + d - 1
    at = order[np.searchsorted(place[order], wanted).clip(max=n - 1)]
    known = (d > 0) & (ids[above] == lifted) & (place[at] == wanted) & (part[at] == part)
    parent = np.where(known, at, np.arange(n))
    values, sums = {x: read(f"_{x}") for x in names}, {x: read(x).copy() for x in names}
    live = np.arange(n)
    while len(live):
        top = parent.copy()
        while (top[top] != top).any():
            top = top[top]
        head = top[live]
        heavy = live[2 * weight[live] > weight[head]]
        # The lightest node of every top's heavy path.
        order = heavy[np.lexsort((weight[heavy], top[heavy]))]
        centre = np.full(n, -1)
        first = np.concatenate([[True], top[order][1:] != top[order][:-1]])
        centre[top[order[first]]] = order[first]
        gone = order[first]
        is_centre = np.zeros(n, bool)
        is_centre[gone] = True
        # Children of a centre head their own components; everything of theirs hangs from it.
        child = live[is_centre[parent[live]] & (parent[live] != live)]
        hangs = parent.copy()
        hangs[child] = child
        below = hangs.copy()
        while (below[below] != below).any():
            below = below[below]
        lower = live[(below[live] != head) | is_centre[live]]
        for x in names:
            total = np.zeros(n, np.int64)
            np.add.at(total, top[lower], values[x][lower])
            sums[x][heavy] += total[top[heavy]]
        rest = heavy[~is_centre[heavy]]
        weight[rest] -= weight[centre[top[rest]]]
        parent = hangs
        live = live[~is_centre[live]]
    done = {**{x: pa.array(sums[x]) for x in names}, "weight": pa.array(weight)}
    yield from pa.table([done.get(c, table[c]) for c in table.column_names], names=table.column_names).to_batches()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, a row per distinct sequence of their first turns, the empty one included.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns are ordered by ``turn``, null
    first; equal turns follow the digest of role and text, and repeated rows count as often as they stand there. A null role or text is empty. Rows with a null
    conv_id belong to no conversation; the remainder of a negative one is not negative. Without any conversation there is no node, not even the root.
    Other columns play no part, whatever their names. Texts are never shuffled, only digests and sizes.
    """
    walks = checkpoint(paths(rebuild(conversations)))
    values = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    totals = subtree_totals(tree(walks), walks, values)
    digests = ends_digest(walks.filter("d = size"))
    return totals.join(digests, "node", "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
