"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .arrays import mix, raw, released, slices, word_hashes, words

#: Rows of the word-vector table, its width, entries other than 0 of an index vector, and neighbours on each side.
BUCKETS, WIDTH, ENTRIES, REACH = 1 << 14, 64, 4, 2
#: The network is fitted on at most so many labelled rows, the first by a hash of their key.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 48, 24, 256, 3e-3, 1e-4
SLICE = 1 << 20
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: Kinds of bytes: lower case, upper case, digit, other ASCII sign, part of a non-ASCII letter.
KIND = np.full(256, 3, np.int8)
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A], KIND[0x80:] = 0, 1, 2, 4
#: Most that counts as a difference, per kind: a word's shape is its clipped counts and how it repeats words before it.
CLIP = np.array([2, 3, 2, 4, 1])
SHAPES = int(np.prod(CLIP + 1)) * 3


def index_vectors(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each id's index vector."""
    bits = mix(np.asarray(ids, np.uint64)[:, None] * np.uint64(ENTRIES) + np.arange(ENTRIES, dtype=np.uint64), seed)
    return (bits % np.uint64(WIDTH)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def dense(ids: np.ndarray, seed: int) -> np.ndarray:
    place, sign = index_vectors(ids, seed)
    out = np.zeros((len(ids), WIDTH), np.float32)
    np.add.at(out, (np.arange(len(ids))[:, None], place), sign)
    return out


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bucket, shape and text of every word (runs of bytes other than white space, case kept)."""
    body, offsets = raw(texts)
    b, e, owner = words(body, offsets, SPACES[body])
    h = word_hashes(body, b, e)
    shape = np.zeros(len(b), np.int64)
    kind = KIND[body]
    for k, most in enumerate(CLIP):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        shape = shape * (most + 1) + np.minimum(sums[e] - sums[b], most)
    again = np.zeros(len(b), np.int64)
    for back in (2, 1):
        same = np.zeros(len(b), bool)
        same[back:] = (h[back:] == h[:-back]) & (owner[back:] == owner[:-back])
        again[same] = back
    return (h % np.uint64(BUCKETS)).astype(np.int64), shape * 3 + again, owner, len(texts)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors per bucket, for a task's documents: a table of fixed size."""
    total = np.zeros(BUCKETS * WIDTH)
    place, sign = index_vectors(np.arange(BUCKETS), 17)
    for part in slices(batches, "text", SLICE):
        bucket, _, owner, _ = read_words(part.column(0))
        for step in range(1, REACH + 1):
            near = np.flatnonzero(owner[step:] == owner[:-step])
            for word, other in ((bucket[near], bucket[near + step]), (bucket[near + step], bucket[near])):
                for k in range(ENTRIES):
                    total += np.bincount(word * WIDTH + place[other, k], sign[other, k], BUCKETS * WIDTH)
    rows = total.astype(np.float32).reshape(64, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["piece", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_buffer(), np.float32).astype(np.float64) for b in table["sums"])
    return pa.table({"piece": table["piece"][:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


@dataclass
class Features:
    """Word vectors, fixed in size, and the pooling of a text's words."""
    vectors: np.ndarray
    shapes: np.ndarray

    def pool(self, texts: pa.Array) -> np.ndarray:
        bucket, shape, owner, n = read_words(texts)
        count = np.bincount(owner, minlength=n)
        share = 1 / np.maximum(count, 1)[:, None]
        cells = np.bincount(owner * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
        out = np.zeros((n, 2 * WIDTH + 2), np.float32)
        out[:, :WIDTH] = cells @ self.shapes * share
        some = np.flatnonzero(count)
        if len(some):
            starts = (np.cumsum(count) - count)[some]
            out[some, WIDTH:2 * WIDTH] = np.add.reduceat(self.vectors[bucket], starts, axis=0) * share[some]
        out[:, -2], out[:, -1] = np.log1p(count) / 10, count == 0
        return out


@dataclass
class Network:
    """tanh layer and logistic output over standardised inputs; logits are divided by the temperature."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on cross entropy over four fifths of the rows; the others set the temperature. Without both labels: the smoothed share of label 1."""
    width = x.shape[1]
    rnd = np.random.default_rng(seed)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    net = Network(mean, scale, np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior)
    if len(y) < 10 or y.min() == y.max():
        return net
    order = rnd.permutation(len(y))
    aside, train = order[:len(y) // 5], order[len(y) // 5:]
    p = [rnd.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN ** -0.5, HIDDEN), np.array(prior)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for epoch in range(EPOCHS):
        rnd.shuffle(train)
        for at in range(0, len(train), BATCH):
            k = train[at:at + BATCH]
            h = np.tanh(z[k] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[k]) / len(k)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[k].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum()]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    logits, target = net.logit(x[aside]), y[aside]
    heats = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, np.where(target > 0, -logits, logits) / h).mean() for h in heats]
    net.temperature = float(heats[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    features: Features
    network: Network


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``fit_rows`` labelled rows.

    Rows without key or label don't count; several labels of a key each count. All that comes to the driver has a fixed
    size: the table of word vectors, and the pooled vectors of the rows fitted on.
    """
    sums = docs.select(F.col(text).alias("text")).mapInArrow(released(_contexts), "piece int, sums binary").groupBy("piece").applyInArrow(_add, "piece int, sums binary")
    table = np.zeros((64, BUCKETS * WIDTH // 64), np.float32)
    for r in sums.collect():
        table[r.piece] = np.frombuffer(r.sums, np.float32)
    vectors = table.reshape(BUCKETS, WIDTH)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    features = Features(vectors, dense(np.arange(SHAPES), 23))

    known = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    # At most fit_rows keys and labels: a fixed size.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(features)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            x = shipped.value.pool(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    # Copies of a row are equal and sorted rows don't depend on the order of tasks.
    got = sorted((r.x, r.y) for r in rows.mapInArrow(released(pooled), "y double, x binary").collect())[:2 * fit_rows]
    x = np.array([np.frombuffer(a, np.float32) for a, _ in got], np.float32).reshape(-1, 2 * WIDTH + 2)
    return QualityModel(features, fit(x, np.array([b for _, b in got])))


def score(docs: DataFrame, model: QualityModel, text: str = "text", to: str = "score") -> DataFrame:
    """Add each whole text's calibrated probability of label 1. A null text counts as empty; an input column named ``to`` gives way."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    row_type = to_arrow_type(StructType.fromDDL(f"row {kind}")["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(row_type), pa.array(m.network.score(m.features.pool(part.column(1))), pa.float64())], ["row", "score"])

    out = rows.mapInArrow(released(run), f"row {kind}, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != to], F.col("score").alias(to))


def held_out(key: str = "doc_id"):
    """Rows set aside: crc32 of the key as text is a multiple of 5. A null key is set aside."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) of every document; labels of held-out rows are not used."""
    model = train(docs, labels.filter(~held_out(key)), key, text)
    scored = score(docs.select(key, text), model, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
