"""Connected components of a graph given as (node, hub) rows.

Edges shrink from round to round.  Inside every task a union-find leaves a star
per local component, so what is exchanged has at most one row per node and task.
Then every node takes the first of its neighbours and itself, edges are renamed to
what their ends took, and loops and repeats go.  Nodes are ordered by number in
odd rounds, which settles stars at once, and by a hash that changes with the
round in even ones, which shrinks chains of any order by a constant factor.
What the nodes of each round took is composed backwards at the end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .packed import arrow_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Edges a task holds before it sends their stars on.
HELD_EDGES = 1 << 21


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of some edges but the smallest ones."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        if not apart.any():
            break
        x, y = high[apart], low[apart]
        np.minimum.at(label, x, y)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return stars(*map(np.concatenate, zip(*held)))

    def sent(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size >= HELD_EDGES:
            held = [joined()]
            size = len(held[0][0])
            if size >= HELD_EDGES // 2:
                yield sent(*held.pop())
                size = 0
    if held:
        yield sent(*joined())


def _shrunk(pairs: DataFrame) -> DataFrame:
    return cut(arrow_map(pairs, _local, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node or hub reachable, for every node and hub.

    A graph without edges has no rows; loops and repeated edges add nothing, but a
    node that has loops only is a row of its own.
    """
    # Written once: it is read for its loops and for its edges.
    plain = cut(edges.select(F.col("node").cast("long").alias("a"), F.col("hub").cast("long").alias("b")))
    alone = plain.where("a = b").select(F.col("a").alias("node")).distinct()
    pairs = _shrunk(plain.where("a <> b"))
    taken: list[DataFrame] = []
    while not pairs.isEmpty():
        by_number = len(taken) % 2 == 0
        order = (lambda c: F.col(c)) if by_number else (lambda c, k=len(taken): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v")))
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min(order("b")), order("a")).alias("low")).select(F.col("a").alias("node"), (F.col("low") if by_number else F.col("low.v")).alias("component"))
        taken.append(cut(low))
        left, right = (taken[-1].select(F.col("node").alias(f"{c}_"), F.col("component").alias(f"{c}_to")) for c in "ab")
        renamed = pairs.join(left, F.col("a") == F.col("a_")).join(right, F.col("b") == F.col("b_")).where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        pairs = _shrunk(renamed)
    if not taken:
        return alone.select("node", F.col("node").alias("component"))
    labels = taken[-1]
    for earlier in reversed(taken[:-1]):
        of = labels.select(F.col("node").alias("up"), F.col("component").alias("above"))
        labels = cut(earlier.join(of, earlier["component"] == of["up"], "left").select("node", F.coalesce("above", "component").alias("component")))
    if len(taken) > 1:  # a hash may have chosen another than the smallest
        least = labels.groupBy("component").agg(F.min("node").alias("least"))
        labels = cut(labels.join(least, "component").select("node", F.col("least").alias("component")))
    single = alone.join(labels.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
    return labels.unionByName(single.select("node", F.col("node").alias("component")))
