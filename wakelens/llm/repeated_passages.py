"""Removal of repeated passages by fixed-block anchors (operator 5).

Every text is cut into reference blocks of ``block`` words that do not overlap;
any window of ``width >= 2 * block - 1`` words holds a whole block.  All rolling
windows of ``block`` words probe the blocks.  An anchor is a block whose words
are found at two places or more.  Wherever an anchor occurs, the windows of
``width`` words around it are extension candidates; those whose word sequence
really starts at two places or more are repeats, and the union of neighbouring
ones is the maximal exact repeat.  Its words are removed.

How it runs: hashes of probes are exchanged in packed blocks of 32 bits, each
task sending a hash once.  Anchors come back as a filter of fixed size; false
positives only add candidates, which are compared on 96 bits afterwards.  What a
task has found twice itself needs no exchange, so a passage that a third of all
texts share is sent once a task.  Pairs of places are never formed.

Defined cases: a null or empty text has no words and keeps none; shorter texts
than ``width`` keep all; windows never cross texts; repeated rows are repeats of
each other; windows are judged on the input.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .packed import Shared, arrow_map, bloom, group_words, low_bits, maybe_in, mix, rows_batch, slices, slot, text_groups, window_hashes, within_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 35
FLUSH = 1_000_000
BUCKET_HASHES = 8_000_000
MIN_BUCKETS = 256
FILTER_BITS = 1 << 28
KEY_BITS = 1 << 25
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): ``key`` names the row by identifier and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("text"))


def bucket_bits(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Leading bits that make buckets of bounded size, and the filter bits, from the size of all texts."""
    words = (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / 6
    bits = ceil(log2(max(MIN_BUCKETS, words / BUCKET_HASHES)))
    wanted = 1 << ceil(log2(max(1 << 20, words / 2)))
    return bits, min(FILTER_BITS, wanted)


def _probes(block: int, bits: int):
    """Per task: each probe hash once, with whether it is a block and whether it was met twice."""

    def flush(parts: list, marks: list) -> Iterator[tuple]:
        hashes, blocks = np.concatenate(parts), np.concatenate(marks)
        order = np.argsort(hashes, kind="stable")
        hashes, blocks = hashes[order], blocks[order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        at = np.flatnonzero(first)
        twice = np.diff(np.append(at, len(hashes))) > 1
        is_block = np.add.reduceat(blocks.astype(np.int32), at) > 0
        hashes = hashes[at]
        low = low_bits(hashes, bits)
        flags = is_block.astype(np.uint8) | (twice.astype(np.uint8) << 1)
        for bucket, part in slices(hashes, bits):
            yield bucket, low[part].tobytes(), np.packbits(np.stack([flags[part] & 1, flags[part] >> 1])).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, marks, held = [], [], 0
        for batch in batches:
            for _, _, raw, offsets in text_groups(batch.column(2)):
                words, _, _, bounds = group_words(raw, offsets)
                hashes = window_hashes(words, block, 1)
                ok = within_texts(len(hashes), block, bounds)
                owner_start = np.repeat(bounds[:-1], np.diff(bounds))[: len(hashes)]
                is_block = (np.arange(len(hashes)) - owner_start) % block == 0
                parts.append(hashes[ok])
                marks.append(is_block[ok])
                held += len(parts[-1])
                if held >= FLUSH:
                    yield rows_batch(flush(parts, marks), _PROBE)
                    parts, marks, held = [], [], 0
        if held:
            yield rows_batch(flush(parts, marks), _PROBE)

    return task


_PROBE = (("bucket", pa.int64()), ("low", pa.binary()), ("flags", pa.binary()))


def _anchors(bits: int, filter_bits: int):
    """Per bucket: the part of the filter that holds its anchors."""
    own = filter_bits >> bits

    def reduce(table: pa.Table) -> pa.Table:
        low, block, twice = [], [], []
        for piece, flags in zip(table.column("low").to_pylist(), table.column("flags").to_pylist()):
            low.append(np.frombuffer(piece, np.uint32))
            both = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * len(low[-1])).reshape(2, -1)
            block.append(both[0])
            twice.append(both[1])
        hashes, block, twice = np.concatenate(low), np.concatenate(block), np.concatenate(twice)
        order = np.argsort(hashes, kind="stable")
        hashes, block, twice = hashes[order], block[order], twice[order]
        at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        count = np.add.reduceat(1 + twice.astype(np.int64), at)
        found = hashes[at][(count > 1) & (np.add.reduceat(block.astype(np.int64), at) > 0)]
        part = np.zeros(own, bool)
        for k in range(2):
            part[slot(found, k, own)] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    return reduce


def _anchored(held: np.ndarray, hashes: np.ndarray, bits: int, filter_bits: int) -> np.ndarray:
    own = filter_bits >> bits
    low = low_bits(hashes, bits)
    base = (hashes >> np.uint64(64 - bits)).astype(np.int64) * own
    ok = np.ones(len(hashes), bool)
    for k in range(2):
        at = base + slot(low, k, own)
        ok &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


_ASKED = (("kind", pa.int32()), ("bucket", pa.int64()), ("hash", pa.binary()), ("check", pa.binary()), ("key", pa.binary()), ("start", pa.binary()))


def _candidates(block: int, width: int, bits: int, filter_bits: int, held: Shared):
    """Windows around anchors: those met twice here are results (kind 1), the others ask (kind 0).

    Of a hash met twice here one representative asks as well, marked by start -1,
    so that other tasks learn of it.
    """

    def flush(parts: list) -> Iterator[tuple]:
        hashes, check, keys, starts = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((check, hashes))
        hashes, check, keys, starts = hashes[order], check[order], keys[order], starts[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(hashes)))
        here = np.repeat(size > 1, size)
        yield from _results(keys[here], starts[here], bits)
        asked = at
        sent = np.where(size > 1, -1, starts[at]).astype(np.int32)
        for bucket, part in slices(hashes[asked], bits):
            i = asked[part]
            yield 0, bucket, hashes[i].tobytes(), check[i].tobytes(), keys[i].tobytes(), sent[part].tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, size = held.get(), [], 0
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, raw, offsets in text_groups(batch.column(2)):
                words, _, _, bounds = group_words(raw, offsets)
                probes = window_hashes(words, block, 1)
                hit = _anchored(known, probes, bits, filter_bits) & within_texts(len(probes), block, bounds)
                n = len(words) - width + 1
                if n <= 0 or not hit.any():
                    continue
                upto = np.concatenate(([0], np.cumsum(hit)))
                reach = width - block + 1
                near = np.flatnonzero((upto[np.minimum(np.arange(n) + reach, len(hit))] > upto[:n]) & within_texts(n, width, bounds))
                if not len(near):
                    continue
                text = np.searchsorted(bounds, near, "right") - 1
                parts.append((window_hashes(words, width, 2)[near], (window_hashes(words, width, 3)[near] >> np.uint64(32)).astype(np.uint32), keys[first + text], near - bounds[text]))
                size += len(near)
                if size >= FLUSH // 2:
                    yield rows_batch(flush(parts), _ASKED)
                    parts, size = [], 0
        if size:
            yield rows_batch(flush(parts), _ASKED)

    return task


def _results(keys: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple]:
    """Packed results for the buckets of the rows, by key."""
    spread = mix(keys.view(np.uint64))
    order = np.lexsort((starts, spread))
    spread, keys, starts = spread[order], keys[order], starts[order].astype(np.int32)
    for bucket, part in slices(spread, bits):
        yield 1, bucket, None, None, keys[part].tobytes(), starts[part].tobytes()


def _confirmed(bits: int):
    """Per bucket: the windows whose sequence starts at two places or more; results pass."""

    def reduce(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table
        get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        hashes, check, keys, starts = get("hash", np.uint64), get("check", np.uint32), get("key", np.int64), get("start", np.int32)
        order = np.lexsort((check, hashes))
        hashes, check, keys, starts = hashes[order], check[order], keys[order], starts[order]
        at = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1]))))
        size = np.diff(np.append(at, len(hashes)))
        settled = np.minimum.reduceat(starts, at) < 0
        here = np.repeat((size > 1) | settled, size) & (starts >= 0)
        return pa.Table.from_batches([rows_batch(_results(keys[here], starts[here], bits), _ASKED)])

    return reduce


def _runs(width: int):
    """Per bucket of rows: the word ranges to remove, one row a text."""

    def reduce(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("key").to_pylist()])
        starts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("start").to_pylist()])
        order = np.lexsort((starts, keys))
        keys, starts = keys[order], starts[order]
        text = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(text | np.concatenate(([True], starts[1:] > starts[:-1] + width)))
        last = np.append(first[1:], len(keys)) - 1
        rows = np.flatnonzero(text[first])
        pairs = np.stack([starts[first], starts[last] + width], axis=1).reshape(-1)
        offsets = np.append(rows * 2, len(pairs)).astype(np.int32)
        return pa.table({"key": pa.array(keys[first][rows]), "runs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs, pa.int32()))})

    return reduce


def repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, runs): word ranges [start, end) of maximal exact repeats, flattened, per text."""
    block = (width + 1) // 2
    texts = keyed(df, id_col, text_col)
    bits, filter_bits = bucket_bits(texts, "text")
    probes = arrow_map(texts, _probes(block, bits), "bucket long, low binary, flags binary")
    anchors = probes.groupBy("bucket").applyInArrow(_anchors(bits, filter_bits), "bucket long, part binary")
    # Size bound: FILTER_BITS, whatever the corpus.
    own = max(1, (filter_bits >> bits) // 8)
    held = np.zeros(own << bits, np.uint8)
    for row in anchors.collect():
        held[row.bucket * own : (row.bucket + 1) * own] = np.frombuffer(row.part, np.uint8)
    schema = "kind int, bucket long, hash binary, check binary, key binary, start binary"
    found = arrow_map(texts, _candidates(block, width, bits, filter_bits, Shared(df.sparkSession, held)), schema)
    results = found.groupBy("kind", "bucket").applyInArrow(_confirmed(bits), schema).select("bucket", "key", "start")
    return results.groupBy("bucket").applyInArrow(_runs(width), "key long, runs array<int>")


def remove_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): every text without its repeats, words joined by one space.

    Only texts that may hold a repeat, by a filter of fixed size, are joined with
    the ranges; the others are written where they are.
    """
    runs = cut(repeats(df, width, id_col, text_col))
    held = Shared(df.sparkSession, bloom(runs, "key", KEY_BITS))
    texts = keyed(df, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_hold(batch, held)))

    def shortened(with_runs: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                whole = whole if with_runs else whole.filter(pa.array(~_may_hold(whole, held)))
                for i in range(0, whole.num_rows, 200):
                    batch = whole.slice(i, 200)
                    ranges = batch.column(3).to_pylist() if with_runs else [None] * batch.num_rows
                    rows = [_shortened(t, r) for t, r in zip(batch.column(2).to_pylist(), ranges)]
                    counts, gone, kept = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

        return task

    schema = f"id {kind}, n_words long, n_removed long, kept string"
    maybe = arrow_map(texts, near, f"id {kind}, key long, text string").join(runs, "key", "left").select("id", "key", "text", "runs")
    return arrow_map(texts, shortened(False), schema).unionByName(arrow_map(maybe, shortened(True), schema))


def _may_hold(batch: pa.RecordBatch, held: Shared) -> np.ndarray:
    return maybe_in(held.get(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))


def _shortened(text: str, ranges: list[int] | None) -> tuple[int, int, str]:
    words = _WORD.findall(text)
    n = len(words)
    for a, b in reversed(list(zip(ranges[::2], ranges[1::2]))) if ranges else ():
        del words[a:b]
    return n, n - len(words), " ".join(words)
