"""Window placement and segmentation over energy frame tables.

A frame table has one row per (clip, time, energy).  A clip may be long, so
neighbour lookups go through time buckets instead of one window per clip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ordered_statistics
from .ranking import running


def window_bounds(df: DataFrame, groups: dict[str, str], *, group: str, begin: str, end: str, total: str, window: int) -> DataFrame:
    """Fixed window starts per prompt group, with padding, one row each.

    P2 takes the end of the speech, P3 its start; long negatives are tiled;
    everything else is centred.  All positions are integer samples.
    """
    size = F.col(total)
    b = F.greatest(F.lit(0), F.least(F.col(begin), size))
    base = df.withColumn("_b", b).withColumn("_e", F.greatest(F.col("_b"), F.least(F.col(end), size)))
    b, e, g = F.col("_b"), F.col("_e"), F.col(group)
    tiled = (g == groups["P4"]) & (F.greatest(F.lit(1), e - b) > int(window * 1.35))
    centre = F.floor((b + e) / 2) - window // 2
    starts = (
        F.when(size <= 0, F.array(F.lit(0).cast("long")))
        .when(g == groups["P2"], F.array(e - window))
        .when(g == groups["P3"], F.array(b))
        .when(tiled, F.sequence(b, F.greatest(b, e - 1), F.lit(window).cast("long")))
        .otherwise(F.array(centre))
    )
    rule = (
        F.when(size <= 0, "empty_pad")
        .when(g == groups["P2"], "p2_final_speech_window")
        .when(g == groups["P3"], "p3_initial_speech_window")
        .when(tiled, "p4_negative_nonoverlap")
        .when(g == groups["P1"], "center_speech_window")
        .otherwise("center_negative_window")
    )
    out = base.withColumn("rule", rule).select("*", F.posexplode(starts).alias("window_index", "window_start"))
    stop = F.col("window_start") + window
    return out.drop("_b", "_e").withColumns(
        {
            "window_end": stop,
            "left_pad": F.greatest(F.lit(0), -F.col("window_start")),
            "right_pad": F.greatest(F.lit(0), stop - F.col(total)),
        }
    )


def sliding_windows(df: DataFrame, total: str, window: int, stride: int) -> DataFrame:
    """Overlapping windows plus a last aligned one, generated in the row."""
    size = F.col(total)
    last = F.greatest(F.lit(0), size - window)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))
    out = df.select("*", F.posexplode(starts).alias("window_index", "window_start"))
    stop = F.col("window_start") + window
    return out.withColumns({"window_end": stop, "padded": stop > size})


def sliding_window_count(total: Column, window: int, stride: int) -> Column:
    """Number of windows without the last aligned one."""
    return F.when(total < window, 1).otherwise(F.floor((total - window) / stride) + 1).cast("long")


def _linear(stats: DataFrame, q: float, low: str, high: str) -> Column:
    """Linear interpolation between two order statistics."""
    at = (F.col("n") - 1) * q
    part = at - F.floor(at)
    return F.col(low) * (1 - part) + F.col(high) * part


def frame_quantiles(frames: DataFrame, clip: str, energy: str) -> DataFrame:
    """20th percentile, median and peak per clip, exactly."""
    n = F.col("n")
    fifth = (n - 1) * 0.2
    stats = ordered_statistics(
        frames,
        [clip],
        energy,
        {
            "_a": F.floor(fifth),
            "_b": F.least(F.floor(fifth) + 1, n - 1),
            "_c": F.floor((n - 1) / 2),
            "_d": F.floor(n / 2),
            "peak": n - 1,
        },
        bucket=F.floor(F.col("_v") * 2),
    )
    return stats.select(clip, "n", _linear(stats, 0.2, "_a", "_b").alias("p20"), ((F.col("_c") + F.col("_d")) / 2).alias("median"), "peak")


def activity_bounds(frames: DataFrame, clip: str, t: str, energy: str, *, floor: float = 80.0, pad: int = 0) -> DataFrame:
    """First and last active frame per clip, widened by ``pad``."""
    q = frame_quantiles(frames, clip, energy)
    threshold = F.greatest(F.lit(floor), F.col("p20") * 2.0, F.col("peak") * 0.02)
    limits = q.select(clip, threshold.alias("threshold"))
    joined = frames.join(limits, clip)
    active = F.col(energy) >= F.col("threshold")
    out = joined.groupBy(clip).agg(
        F.max("threshold").alias("threshold"),
        F.count_if(active).alias("active_frames"),
        F.min(t).alias("_lo"),
        F.max(t).alias("_hi"),
        F.min(F.when(active, F.col(t))).alias("_first"),
        F.max(F.when(active, F.col(t))).alias("_last"),
    )
    return out.select(
        clip,
        "threshold",
        "active_frames",
        F.coalesce(F.greatest("_lo", F.col("_first") - pad), "_lo").alias("speech_begin"),
        F.coalesce(F.least("_hi", F.col("_last") + pad), "_hi").alias("speech_end"),
    )


def islands(active: DataFrame, keys: Sequence[str], t: str, gap: int, bucket: Column, tie: Sequence[str] = ()) -> DataFrame:
    """Number runs of frames whose distance is at most ``gap``.

    The previous time is a running maximum and the island number a running
    sum, both carried over buckets, so one long clip spreads over tasks.
    """
    order = [F.col(t).asc(), *[F.col(c).asc() for c in tie]]
    seen = running(active, keys, order, bucket, {"_prev": ("max", F.col(t))}, inclusive=False)
    fresh = F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > gap)
    marked = seen.withColumn("_new", fresh.cast("int"))
    return running(marked, keys, order, bucket, {"island": ("sum", F.col("_new"))}).drop("_prev", "_new")


def segments(
    frames: DataFrame,
    clip: str,
    t: str,
    energy: str,
    *,
    gap: int,
    shortest: int,
    pad: int,
    bucket: Column,
    floor: float = 0.008,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Speech segments above the adaptive threshold, merged, filtered, padded."""
    q = frame_quantiles(frames, clip, energy)
    threshold = F.greatest(F.col("p20") * 3.0, F.col("median") * 1.5, F.col("peak") * 0.08, F.lit(floor))
    span = frames.groupBy(clip).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    limits = q.select(clip, threshold.alias("threshold")).join(span, clip)
    active = frames.join(limits, clip).where(F.col(energy) > F.col("threshold"))
    runs = islands(active, [clip], t, gap, bucket, tie)
    merged = runs.groupBy(clip, "island").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("frames"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    return merged.where(F.col("end") - F.col("start") >= shortest).select(
        clip,
        "island",
        F.greatest("_lo", F.col("start") - pad).alias("start"),
        F.least("_hi", F.col("end") + pad).alias("end"),
        "frames",
    )


def segmentation_status(clips: DataFrame, found: DataFrame, clip: str, expected: str) -> DataFrame:
    """Compare the number of segments with the expected count."""
    counts = found.groupBy(clip).agg(F.count(F.lit(1)).alias("detected"))
    joined = clips.join(counts, clip, "left").na.fill(0, ["detected"])
    status = (
        F.when(F.col("detected") == 0, "failed_no_segments")
        .when(F.col("detected") == F.col(expected), "ok")
        .otherwise("warning_count_mismatch")
    )
    return joined.withColumn("status", status)


def energy_quality(frames: DataFrame, clip: str, t: str, energy: str, *, clipped_above: float = 0.98) -> DataFrame:
    """Duration, RMS, peak, clipped ratio, finiteness and silence per clip."""
    x = F.col(energy)
    broken = F.isnan(x) | (F.abs(x) == float("inf"))
    out = frames.groupBy(clip).agg(
        (F.max(t) - F.min(t)).alias("duration"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.max(F.abs(x)).alias("peak"),
        F.avg((F.abs(x) > clipped_above).cast("double")).alias("clipped_ratio"),
        (F.count_if(broken) == 0).alias("finite"),
    )
    return out.withColumn("silent", F.col("peak") <= 0)


def training_history(history: DataFrame, keys: Sequence[str], epoch: str, score: str, sizes: DataFrame) -> DataFrame:
    """Epochs run, best epoch (first maximum), steps and early stopping.

    ``sizes`` has train_rows, batch_size and configured_epochs per key.
    """
    runs = history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("epochs_completed"),
        F.max(epoch).alias("final_epoch"),
        F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).alias("best_epoch"),
        F.max(score).alias("best_score"),
    )
    steps = F.ceil(F.col("train_rows") / F.col("batch_size"))
    joined = sizes.join(runs, list(keys), "left")
    return joined.withColumns(
        {
            "steps_per_epoch": steps,
            "total_steps": steps * F.col("epochs_completed"),
            "stopped_early": F.coalesce(F.col("final_epoch") < F.col("configured_epochs"), F.lit(False)),
        }
    )


def median_epoch(best: DataFrame, epoch: str, low: int = 1, high: int = 20) -> DataFrame:
    """Median best epoch, half to even, clamped."""
    n = F.col("n")
    stats = ordered_statistics(best, [], epoch, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)}, bucket=F.floor(F.col("_v") / 4))
    value = F.bround((F.col("_a") + F.col("_b")) / 2, 0).cast("int")
    return stats.select(F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), value)), F.lit(low)).alias("epochs"))
