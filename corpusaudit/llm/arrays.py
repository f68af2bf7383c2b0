"""Arrow and numpy helpers that tasks share: raw bytes of texts, bounded slices, segment arithmetic."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


#: Bytes of a group after which a worker gives free memory back.
LARGE = 1 << 20
#: What operators keep in a worker between tasks, each as a function that drops it.
KEPT: list[Callable[[], None]] = []


def drop_kept() -> None:
    for drop in KEPT:
        drop()


def trim() -> None:
    """Give free memory back to the system, as it is."""
    pa.default_memory_pool().release_unused()
    # Only the GNU library has it; elsewhere free memory simply stays with the worker.
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give this process's free memory back to the system, cycles of objects too."""
    gc.collect()
    trim()


def released(run: Callable) -> Callable:
    """A task's function that gives free memory back to the system at its end: workers are used again, and what one stage held would stand beside the next one's. What other operators kept there goes first."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def freed(run: Callable) -> Callable:
    """The same for a function of a group, or of two groups that meet: free memory goes back after each large one. What small groups leave behind is used again by the next."""
    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes > LARGE:
                trim()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            if left.nbytes + right.nbytes > LARGE:
                trim()
    return two if run.__code__.co_argcount == 2 else one


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have at most ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets of the texts in them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if ends is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = body[offsets[0]:offsets[-1]]
    return body, offsets - offsets[0]


def lower_ascii(body: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[body]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ U64(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def words(body: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside`` true that cross no text: begins, ends, and the number of the text."""
    n = len(body)
    on = inside.copy()
    begin = on.copy()
    begin[1:] &= ~on[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begin[heads] = on[heads]
    stop = np.zeros(n + 1, bool)
    stop[1:] = on
    stop[1:n] &= ~on[1:] if n else on
    stop[heads] = np.where(heads > 0, on[heads - 1], False)
    b, e = np.flatnonzero(begin), np.flatnonzero(stop)
    return b, e, np.searchsorted(offsets, b, side="right") - 1


def word_hashes(body: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word's bytes, from a wrapped prefix polynomial; its length takes part."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = U64(0x9E3779B97F4A7C15 | 1)
        powers = powers_of(base, len(body) + 1)
        inverse = powers_of(U64(pow(int(base), -1, 1 << 64)), len(body) + 1)
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(SCRAMBLE[body] * powers[:-1], out=sums[1:])
        return mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64) * U64(0xD6E8FEB86659FD93), seed)


_POWERS: dict[int, np.ndarray] = {}


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        _POWERS[int(base)] = have
    return have[:n]


SCRAMBLE = mix(np.arange(1, 257, dtype=np.uint64), 0x5851F42D4C957F2D)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the number of each item's owner, and its place among the owner's items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return owner, np.arange(len(owner)) - first[owner]


def merge_spans(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans per owner as maximal runs (touching runs join), sorted by owner and begin."""
    if not len(begin):
        return begin.astype(np.int64), end.astype(np.int64), owner.astype(np.int64)
    order = np.lexsort((begin, owner))
    b, e, o = begin[order].astype(np.int64), end[order].astype(np.int64), owner[order].astype(np.int64)
    shift = int(e.max()) + 2
    top = np.maximum.accumulate(e + o * shift)
    new = np.ones(len(b), bool)
    new[1:] = b[1:] + o[1:] * shift > top[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(b)) - 1
    return b[at], top[last] - o[at] * shift, o[at]


def member(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.searchsorted(ranked, values).clip(max=len(ranked) - 1)] == values
