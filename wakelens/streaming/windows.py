"""Event-time windows over score streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import islands


def _measures(theta: float):
    hit = F.col("score") >= theta
    return [
        F.count(F.lit(1)).alias("chunks"),
        F.max("score").alias("max_score"),
        F.count_if(hit).alias("candidates"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("candidate_rate"),
    ]


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")).drop("window")


def sliding(stream: DataFrame, *, ts: str, size: str, slide: str, theta: float, delay: str | None = None, keys: tuple = ("session",)) -> DataFrame:
    """Per-window maximum and candidate rate; works on tables and streams."""
    rows = stream.withWatermark(ts, delay) if delay else stream
    return _spread(rows.groupBy(F.window(ts, size, slide), *keys).agg(*_measures(theta)))


def tumbling(stream: DataFrame, *, ts: str, size: str, theta: float, delay: str | None = None, keys: tuple = ("session",)) -> DataFrame:
    return sliding(stream, ts=ts, size=size, slide=size, theta=theta, delay=delay, keys=keys)


def sessions(rows: DataFrame, *, ts: str, gap_seconds: int, theta: float, delay: str | None = None, keys: tuple = ("session",)) -> DataFrame:
    """Runs of chunks closer than the gap.

    A stream keeps Spark's session windows as state.  A table goes through
    bucketed islands instead, so one long session key spreads over tasks.
    """
    gap = F.make_dt_interval(secs=F.lit(float(gap_seconds)))
    if rows.isStreaming:
        marked = rows.withWatermark(ts, delay) if delay else rows
        grouped = marked.groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("window"), *keys)
        return _spread(grouped.agg(*_measures(theta)))
    placed = rows.withColumn("_us", F.unix_micros(F.col(ts)))
    step = max(gap_seconds, 86_400) * 1_000_000
    runs = islands(placed, list(keys), "_us", gap_seconds * 1_000_000 - 1, F.floor(F.col("_us") / step))
    merged = runs.groupBy(*keys, "island").agg(
        *_measures(theta), F.min(ts).alias("window_start"), (F.max(ts) + gap).alias("window_end")
    )
    return merged.drop("island")
