"""Word and character alignment of many text pairs at once, as Arrow-batched steps."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers inside the task closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One edit path is packed as distance, insertions, deletions in one integer, so
# integer order is the tie-break order and costs simply add up.
_FIELD = (1 << 21) - 1
INSERT, DELETE, REPLACE = (1 << 42) + (1 << 21), (1 << 42) + 1, 1 << 42
# Table cells of the pairs aligned together; a pair beyond it is aligned alone.
_CELLS = 1 << 18
# Longer texts are left to Spark's own function.
_LONG = 1024


def _together(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of like size, so that padding stays small."""
    order = np.argsort(sizes, kind="stable")
    while len(order):
        cells = (sizes[order] + 1) * np.arange(1, len(order) + 1)
        count = max(1, int(np.searchsorted(cells, _CELLS, "right")))
        yield order[:count]
        order = order[count:]


def _rows(flat: np.ndarray, counts: np.ndarray, chosen: np.ndarray, width: int, fill: int) -> np.ndarray:
    """The chosen lists of ``flat`` as the rows of one padded table."""
    starts = (np.cumsum(counts) - counts)[chosen]
    at = np.arange(width)
    inside = at < counts[chosen][:, None]
    return np.where(inside, flat[np.where(inside, starts[:, None] + at, 0)] if len(flat) else fill, fill)


def _words(texts: pd.Series) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and how many each text has; null has none."""
    lists = pc.split_pattern(pc.fill_null(pa.array(texts, pa.string(), from_pandas=True), ""), " ")
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    kept = pc.not_equal(words, "")
    return words.filter(kept), np.bincount(parents.filter(kept).to_numpy(), minlength=len(texts))


def _least_edits(ref: np.ndarray, n_ref: np.ndarray, hyp: np.ndarray, n_hyp: np.ndarray) -> np.ndarray:
    """Least packed edits of every pair, one reference word of all pairs after another."""
    first = np.arange(hyp.shape[1] + 1) * INSERT
    row, out = np.tile(first, (len(ref), 1)), np.empty(len(ref), dtype=np.int64)
    for i in range(ref.shape[1] + 1):
        over = np.flatnonzero(n_ref == i)
        out[over] = row[over, n_hyp[over]]
        if i < ref.shape[1]:
            cells = row + DELETE
            np.minimum(cells[:, 1:], row[:, :-1] + np.where(hyp == ref[:, i : i + 1], 0, REPLACE), out=cells[:, 1:])
            # A run of insertions costs the same a word: the least start counts.
            row = np.minimum.accumulate(cells - first, axis=1) + first
    return out


@F.pandas_udf(T.LongType())
def packed_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Least (distance, insertions, deletions) between the words of two texts, packed."""
    (ref, n_ref), (hyp, n_hyp) = _words(reference), _words(hypothesis)
    codes = pa.concat_arrays([ref, hyp]).dictionary_encode().indices.to_numpy().astype(np.int64)
    ref, hyp = codes[: len(ref)], codes[len(ref) :]
    out = np.zeros(len(reference), dtype=np.int64)
    for rows in _together(np.maximum(n_ref, n_hyp)):
        r = _rows(ref, n_ref, rows, n_ref[rows].max(), -1)
        h = _rows(hyp, n_hyp, rows, n_hyp[rows].max(), -2)
        out[rows] = _least_edits(r, n_ref[rows], h, n_hyp[rows])
    return pd.Series(out)


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Struct of substitutions, deletions and insertions that turn one text into the other."""
    packed = packed_edits(reference, hypothesis)
    insertions = F.shiftright(packed, 21).bitwiseAND(F.lit(_FIELD))
    deletions = packed.bitwiseAND(F.lit(_FIELD))
    replaced = F.shiftright(packed, 42) - insertions - deletions
    return F.struct(replaced.alias("substitutions"), deletions.alias("deletions"), insertions.alias("insertions"))


def _bit_distances(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two character tables, 64 cells of a column a word (Myers 1999)."""
    blocks, one = a.shape[1] // 64, np.uint64(1)
    last, top = ((n_a - 1) % 64).astype(np.uint64), np.uint64(63)
    score = n_a.astype(np.int64)
    up = [np.full(len(a), ~np.uint64(0)) for _ in range(blocks)]
    down = [np.zeros(len(a), dtype=np.uint64) for _ in range(blocks)]
    for j in range(b.shape[1]):
        same = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view("<u8")
        more, less = np.full(len(a), one), np.zeros(len(a), dtype=np.uint64)
        for k in range(blocks):
            vertical = same[:, k] | down[k]
            equal = same[:, k] | less
            across = (((equal & up[k]) + up[k]) ^ up[k]) | equal
            plus, minus = down[k] | ~(across | up[k]), up[k] & across
            if k == blocks - 1:
                change = ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
                score += np.where(j < n_b, change, 0)
            shifted, taken = (plus << one) | more, (minus << one) | less
            more, less = plus >> top, minus >> top
            up[k], down[k] = taken | ~(vertical | shifted), shifted & vertical
    return score


def _characters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fillna("")
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    return flat, texts.str.len().to_numpy(dtype=np.int64)


@F.pandas_udf(T.IntegerType())
def short_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distances in characters; null counts as empty."""
    (a, n_a), (b, n_b) = _characters(reference), _characters(hypothesis)
    # What lies behind a text's end touches no cell before it, so any padding will do.
    kind = np.uint8 if max(a.max(initial=0), b.max(initial=0)) < 256 else np.uint32
    out = np.where(n_a == 0, n_b, 0)
    blocks = (n_a + 63) // 64
    for count in np.unique(blocks[blocks > 0]):
        found = np.flatnonzero(blocks == count)
        for part in _together(np.maximum(n_b[found], 64 * count)):
            rows = found[part]
            x, y = (_rows(*c, rows, width, 0).astype(kind) for *c, width in ((a, n_a, 64 * count), (b, n_b, n_b[rows].max())))
            out[rows] = _bit_distances(x, n_a[rows], y, n_b[rows])
    return pd.Series(out.astype(np.int32))


def char_distance(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance in characters; null where a text is."""
    short = (F.length(reference) <= _LONG) & (F.length(hypothesis) <= _LONG)
    near = short_distance(F.when(short, reference), F.when(short, hypothesis))
    return F.when(short, near).otherwise(F.levenshtein(F.when(~short, reference), F.when(~short, hypothesis)))
