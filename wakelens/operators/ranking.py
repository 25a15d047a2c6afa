"""Running totals and ranks that never gather a whole group in one task.

A plain ``row_number() over (partition by key)`` sends all rows of a key to one
task.  Here the caller names a bucket that grows with the order (an hour, a
score step, a hash prefix).  Each (key, bucket) is one window partition, and
what the earlier buckets contribute comes from a pre-aggregated table with one
row per key and bucket.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ship the task functions inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(before, here)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    aggs: dict[str, tuple[str, Column]],
    *,
    descending: bool = False,
    inclusive: bool = True,
    totals_as: str | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``keys``.

    ``bucket`` must be monotone in ``order``; ``descending`` says its larger
    values come first.  ``aggs`` maps a new column to (sum|max|min, value).
    ``totals_as='all_'`` also adds each aggregate over the whole key.
    Keys and bucket must not be null.
    """
    keys = list(keys)
    base = df.withColumn("_bucket", bucket)
    for name, (_, value) in aggs.items():
        base = base.withColumn(f"_in_{name}", value)
    totals = base.groupBy(*keys, "_bucket").agg(
        *[_AGG[kind](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in aggs.items()]
    )
    step = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = [_AGG[kind](f"_tot_{name}").over(earlier).alias(f"_pre_{name}") for name, (kind, _) in aggs.items()]
    if totals_as is not None:
        carry += [_AGG[kind](f"_tot_{name}").over(whole).alias(totals_as + name) for name, (kind, _) in aggs.items()]
    carried = totals.select(*keys, "_bucket", *carry)
    last = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    joined = base.join(carried, [*keys, "_bucket"])
    added = {
        name: _merge(kind, F.col(f"_pre_{name}"), _AGG[kind](f"_in_{name}").over(local))
        for name, (kind, _) in aggs.items()
    }
    extra = [] if totals_as is None else [totals_as + name for name in aggs]
    return joined.select(*df.columns, *[c.alias(name) for name, c in added.items()], *extra)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """Row number within ``keys`` from 1, safe for a hot key."""
    out = running(df, keys, order, bucket, {name: ("sum", F.lit(1))}, descending=descending)
    return out.withColumn(name, F.col(name).cast("long"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, name: str = "rank") -> DataFrame:
    """Top ``count`` rows per key.

    The filter sits right on the rank, so Spark limits each group before the
    shuffle and a hot key ships at most ``count`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= count)


def _sorted_groups(keys: list[str], task: Callable):
    """Batches of sorted rows in, one task call per complete group."""

    def finish(frame: pd.DataFrame, starts: np.ndarray):
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        ends = np.append(starts[1:], len(frame))
        parts = [task({c: v[lo:hi] for c, v in columns.items()}) for lo, hi in zip(starts, ends)]
        return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            if held and (held[-1][keys].iloc[-1].to_numpy() == batch[keys].iloc[0].to_numpy()).all():
                changed[0] = False
            starts = np.flatnonzero(changed)
            if len(starts) == 0:
                held.append(batch)
                continue
            ready = pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True) if held else batch.iloc[: starts[-1]]
            held_rows = sum(len(h) for h in held)
            if len(ready):
                inner = starts[:-1] + held_rows
                yield finish(ready, np.append(0, inner) if held_rows else inner)
            held = [batch.iloc[starts[-1] :]]
        if held:
            yield finish(pd.concat(held, ignore_index=True), np.array([0]))

    return run


def map_sorted_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], task: Callable, schema: str) -> DataFrame:
    """Run ``task`` on each group's column arrays, many groups per batch.

    Groups arrive sorted and one after another, so tiny groups cost no
    per-group transfer and memory holds one group at a time.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(_sorted_groups(list(keys), task), schema=schema)
