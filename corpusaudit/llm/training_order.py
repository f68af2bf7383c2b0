"""Training order: a keyed Feistel permutation gives every token sequence its slot; shards of fixed stride are read by seeking."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.plans.shapes import ensure_checkpoint_dir

from . import bpe
from .arrays import mix, raw, slices

#: Tokens of a sequence, and sequences of a shard. Shards that one task writes at most.
LENGTH, PER_SHARD, PER_TASK = 2048, 4096, 32
#: The id after every document where ids are UTF-8 bytes, in which 255 never occurs. With a vocabulary it is the first id beyond that.
END = 255
ROUNDS = 4
SLICE = 4 << 20


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it. Spark's names for S3 are read as pyarrow's."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1: balanced Feistel rounds on the least even number of bits that holds
    ``size``, walked along its cycle until the value lies below ``size``."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + (np.uint64(r) << np.uint64(40)), key) & mask)
        out[open_] = left << half | right
        open_ = open_[out[open_] >= size]
    return out.astype(np.int64)


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of ids as binaries of fixed width."""
        width = np.dtype(kind).itemsize
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([flat[b:e] for b, e in zip(((ends[:-1] - ends[0]) * width).tolist(), ((ends[1:] - ends[0]) * width).tolist())], pa.binary())], ["text"])
    return run


def _fragments(starts: dict[tuple[str, int], int], size: int, key: int, kind: str, stop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stream of a block's ids, an end id after each document, cut at sequence bounds."""
        width = np.dtype(kind).itemsize
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            for part in slices(iter([batch]), "text", SLICE):
                files, blocks = part.column(1).to_pylist(), part.column(2).to_pylist()
                body, offsets = raw(part.column(0))
                body, offsets = body.view(kind), offsets // width
                stream = np.full(len(body) + part.num_rows, stop, kind)
                stream[np.arange(len(body)) + np.repeat(np.arange(part.num_rows), np.diff(offsets))] = body
                bounds = offsets + np.arange(part.num_rows + 1)
                first = 0
                while first < part.num_rows:
                    block, last = (files[first], blocks[first]), first
                    while last < part.num_rows and (files[last], blocks[last]) == block:
                        last += 1
                    here = stream[bounds[first]:bounds[last]]
                    begin = at.get(block, starts[block])
                    at[block] = begin + len(here)
                    cuts = np.arange(begin // LENGTH + 1, (begin + len(here) - 1) // LENGTH + 1) * LENGTH - begin
                    cuts = np.concatenate([[0], cuts, [len(here)]])
                    seq = (begin + cuts[:-1]) // LENGTH
                    data = here.tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(feistel(seq, size, key)), pa.array(seq), pa.array((begin + cuts[:-1]) % LENGTH, pa.int32()),
                        pa.array([data[b:e] for b, e in zip((cuts[:-1] * width).tolist(), (cuts[1:] * width).tolist())], pa.binary())], ["slot", "seq", "place", "ids"])
                    first = last
    return run


def _write(folder: str, end: bytes, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records in slot order into one file per shard; a file gets its name when it is whole, so a lost attempt leaves none."""
        fs, root = filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, sink, out = -1, None, []

        def name(k: int) -> str:
            return f"{root}/shard-{k:08d}.bin"

        def close():
            sink.close()
            fs.move(f"{name(shard)}.{attempt}", name(shard))

        def put(slot: int, seq: int, ids: bytes):
            nonlocal shard, sink
            if slot // per_shard != shard:
                if sink is not None:
                    close()
                shard = slot // per_shard
                sink = fs.open_output_stream(f"{name(shard)}.{attempt}")
            n = len(ids) // len(end)
            record = ids + end * (LENGTH - n)
            sink.write(record)
            out.append((slot, seq, shard, (slot % per_shard) * len(record), n, zlib.crc32(record)))

        def rows() -> pa.RecordBatch:
            got = list(zip(*out)) or [()] * 6
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], ["slot", "seq", "shard", "offset", "n_ids", "crc32"])

        now, held = None, []
        for batch in batches:
            for slot, seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if now is not None and now[0] != slot:
                    put(*now, b"".join(held))
                    held = []
                now = slot, seq
                held.append(ids)
            yield rows()
        if now is not None:
            put(*now, b"".join(held))
            close()
            yield rows()
    return run


def _knows_files(docs: DataFrame) -> bool:
    """Whether each row still tells the file block it is read from."""
    try:
        return bool(docs.select("_metadata.file_block_start").columns)
    except AnalysisException:
        return False


def materialise(docs: DataFrame, key: int, text: str = "text", folder: str | None = None,
                ranks_path: str | None = None, pattern: str | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the token stream of all documents as shuffled sequences and return one row per sequence:
    (slot, seq, shard, offset, n_ids, crc32).

    With ``ranks_path`` and ``pattern`` the stream is every text's token ids as ``bpe.encode`` gives them: texts are encoded once, and their ids
    written as Parquet beside the checkpoints, two bytes each (four where the vocabulary needs them, low byte first); these files give the order.
    The end id is the number of tokens. Without, it is every text's UTF-8 bytes as ids, in the order of the files that ``docs``
    is read from; a table whose rows don't know their file block is written as Parquet first. An end id follows each document. A null or empty text is an end id
    alone; repeated texts stay. The stream is cut into sequences of ``LENGTH`` ids; the last is filled up with end
    ids. Sequence ``seq`` lies in ``slot`` = permutation(seq): shard ``slot // per_shard``, byte ``offset``. An empty table gives no
    rows and no files. Other columns play no part.

    One row per file block tells where its part of the stream begins. Every task takes one range of slots, which is up to ``PER_TASK``
    neighbouring shards, sorts it and writes its shards one after another. The bounds of the ranges are known from the number of sequences,
    so nothing is sampled and one shuffle of the ids is all. ``folder`` is a URI that all executors reach, by
    default a new folder beside the checkpoints.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    base = (folder or f"{spark.sparkContext.getCheckpointDir()}/training-order-{uuid.uuid4().hex}").rstrip("/")
    if "://" not in base:
        base = "file://" + base.removeprefix("file:") if base.startswith(("/", "file:/")) else base
    kind, stop = "u1", END
    if ranks_path is not None:
        stop = len(bpe.read_ranks(ranks_path))
        kind = "<u2" if stop < 1 << 16 else "<u4"
        coded = bpe.encode(docs.select(F.lit(0).alias("none"), F.col(text).alias("text")), ranks_path, pattern, "none")
        coded.select("ids").mapInArrow(_packed(kind), "text binary").write.mode("overwrite").parquet(f"{base}/input")
        docs, text = spark.read.parquet(f"{base}/input"), "text"
    elif not _knows_files(docs):
        docs.select(F.col(text).alias("text")).write.mode("overwrite").parquet(f"{base}/input")
        docs, text = spark.read.parquet(f"{base}/input"), "text"
    rows = docs.select(F.col(text).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # One row per file block: bounded by the number of scan tasks.
    sizes = rows.groupBy("file", "block").agg(F.sum(F.coalesce((F.octet_length("text") / np.dtype(kind).itemsize).cast("long"), F.lit(0)) + 1).alias("n")).orderBy("file", "block").collect()
    ends = np.cumsum([0, *(r.n for r in sizes)]).tolist()
    starts = {(r.file, r.block): b for r, b in zip(sizes, ends)}
    size = -(-ends[-1] // LENGTH)
    shards = max(1, -(-size // per_shard))
    neighbours = min(PER_TASK, max(1, shards // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fs, root = filesystem(base)
    fs.create_dir(f"{root}/shards")
    pieces = rows.mapInArrow(_fragments(starts, size, key, kind, stop), "slot long, seq long, place int, ids binary")
    ranges = F.expr(f"cast(slot div {per_shard * neighbours} as int)")
    dealt = pieces.repartitionById(-(-shards // neighbours), ranges).sortWithinPartitions("slot", "place").select("slot", "seq", "ids")
    return dealt.mapInArrow(_write(f"{base}/shards", np.array(stop, kind).tobytes(), per_shard), "slot long, seq long, shard int, offset long, n_ids int, crc32 long")


def read_slots(folder: str, begin: int, end: int, width: int = 1, per_shard: int = PER_SHARD) -> Iterator[bytes]:
    """Records of slots begin .. end - 1 with ids of ``width`` bytes, by seeking: reading can go on from any slot."""
    fs, root = filesystem(folder)
    for shard in range(begin // per_shard, -(-end // per_shard)):
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as source:
            first = max(begin - shard * per_shard, 0)
            source.seek(first * LENGTH * width)
            for _ in range(first, min(end - shard * per_shard, per_shard)):
                yield source.read(LENGTH * width)
