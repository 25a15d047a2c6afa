"""Vectorised word and window hashes over Arrow text, shared by several operators.

Words are ``[^\\x20\\x09-\\x0D]+``.  A hash is 64 bits wide and the same in every
task.  Text is hashed in pieces, so memory is bounded by the piece and eight
bytes per word, however long a text is.
"""

from __future__ import annotations

import ctypes
import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ship the task functions inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 18
GROUP_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


def worker_cache(key, build: Callable):
    """A value built once per Python worker, kept outside the shipped closure."""
    held = sys.__dict__.setdefault("_wakelens_llm_cache", {})
    if key not in held:
        held[key] = build()
    return held[key]


def worker_slot(key, build: Callable):
    """Like ``worker_cache`` for large values: the worker keeps the last one only, up to a task that needs none."""
    held = worker_cache("slot", dict)
    worker_cache("used", set).add(key)
    if key not in held:
        held.clear()
        held[key] = build()
    return held[key]


class Shared:
    """A broadcast of one value; its size bound is the caller's to state."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.key = uuid.uuid4().hex

    def get(self):
        return worker_slot(self.key, lambda: pickle.loads(self.sent.value))


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def arrow_map(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``task`` maps an iterator of record batches to one, inside Spark's tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("slot", dict)
        worker_cache("used", set).clear()
        yield from task(batches)
        if not worker_cache("used", set):
            held.clear()
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i up to ``n``."""

    def build(size: int):
        forward = np.full(size, base, np.uint64)
        back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        forward[0] = back[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(forward, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    held = worker_cache(("powers", base), lambda: [build(PIECE + 1)])
    if len(held[0][0]) <= n:
        held[0] = build(max(n + 1, 2 * len(held[0][0])))
    return held[0]


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if lower:
        values[65:91] = values[97:123]
    return values


def _separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; no word crosses a text."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~_separators()[raw[lo:hi]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside), bool)
    edges = offsets[:-1] - lo
    first[edges[edges < len(inside)]] = True
    starts = inside & (first | ~np.concatenate(([False], inside[:-1])))
    last = np.concatenate((first[1:], [True]))
    ends = inside & (last | ~np.concatenate((inside[1:], [False])))
    return np.flatnonzero(starts) + lo, np.flatnonzero(ends) + lo + 1


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word."""
    values = _byte_values(lower)
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            forward, back = powers(hi - lo + 1, 0x9E3779B97F4A7C15)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[raw[lo:hi]] * forward[: hi - lo], out=total[1:])
            at, to = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((total[to] - total[at]) * back[at] + (to - at).astype(np.uint64) * _ODD)
            i = j
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive entries, by first entry."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = mix(words ^ np.uint64(seed)) if seed else words
    with np.errstate(over="ignore"):
        if width <= 8:
            out = words[:n].copy()
            for k in range(1, width):
                out = out * _ODD + words[k : k + n]
        else:
            forward, back = powers(len(words) + 1, 0xD1342543DE82EF95)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * forward[: len(words)], out=total[1:])
            out = (total[width:] - total[:n]) * back[:n]
        return mix(out + np.uint64(width))


def text_groups(batch_column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``GROUP_BYTES``: first row, end row, bytes, offsets."""
    raw, offsets = text_buffers(batch_column)
    row, rows = 0, len(batch_column)
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, side="right")) - 1)
        yield row, to, raw, offsets[row : to + 1]
        row = to


def group_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word starts and ends, and the first word of each text (and the end)."""
    starts, ends = word_bounds(raw, offsets)
    return hash_words(raw, starts, ends, lower), starts, ends, np.searchsorted(starts, offsets)


def within_texts(n_windows: int, width: int, bounds: np.ndarray) -> np.ndarray:
    """Which windows lie in one text, for windows over the words of several."""
    owner_end = np.repeat(bounds[1:], np.diff(bounds))[:n_windows]
    return np.arange(n_windows) + width <= owner_end


def slices(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Bucket (the leading bits) and range of every bucket of sorted hashes."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), slice(int(a), int(b))


def rows_batch(rows: Iterator[tuple], fields: tuple) -> pa.RecordBatch:
    """A record batch of row tuples; ``fields`` are (name, type)."""
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def low_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits that follow the bucket."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def slot(low: np.ndarray, k: int, own: int) -> np.ndarray:
    """Place ``k`` of an entry in its bucket's part (of ``own`` entries) of a filter."""
    return (mix(low.astype(np.uint64) * np.uint64(2) + np.uint64(k)) & np.uint64(own - 1)).astype(np.int64)


def bloom(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of fixed size over the hashes in ``column``; the driver gets its words of 64 bits only."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([bloom_places(hashes, k, bits) for k in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    marks = arrow_map(df.select(column), task, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[marks["word"].to_numpy(np.int64)] = marks["bit"].to_numpy(np.int64)
    return out.view(np.uint64)


def bloom_places(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix(hashes + np.uint64(k * 0x9E3779B9 + 1)) & np.uint64(bits - 1)


def maybe_in(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; none that is in it is missed."""
    ok = np.ones(len(hashes), bool)
    for k in range(3):
        at = bloom_places(hashes, k, 64 * len(held))
        ok &= (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok
