"""Threshold choice from cumulative counts instead of one pass per grid point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import lex
from ..session import cut
from .metrics import COUNTS, cumulative_counts, score_histogram, with_rates


def sweep(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    score: str,
    *,
    grid: int = 101,
    span: str = "unit",
    bucket: Column | None = None,
    floor: float | None = None,
) -> DataFrame:
    """Counts and rates at every distinct score and every grid point, per key.

    Grid points enter as zero-count rows of the score histogram, so one
    cumulative pass covers both.  The histogram is read several times, so it is
    written once to the shared folder.  ``span='unit'`` spreads the grid over [0, 1],
    ``'data'`` over the key's own score range.  Scores at or below ``floor``
    stay in the counts but offer no threshold.
    """
    histogram = cut(score_histogram(df, keys, label, score))
    return sweep_histogram(histogram, keys, grid=grid, span=span, bucket=bucket, floor=floor)


def grid_points(limits: DataFrame, keys: Sequence[str], low: str, high: str, grid: int, span: str) -> DataFrame:
    """The ``grid`` evenly spread scores of every key, over [0, 1] or the key's own range."""
    lo, hi, i = F.col(low), F.col(high), F.col("_i")
    points = limits.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    at = i * F.lit(1.0 / (grid - 1)) if span == "unit" else lo + i * ((hi - lo) / F.lit(float(grid - 1)))
    if span == "data":
        at = F.when(i == grid - 1, hi).otherwise(at)
    return points.select(*keys, at.alias("score"))


def sweep_histogram(
    histogram: DataFrame,
    keys: Sequence[str],
    *,
    grid: int = 101,
    span: str = "unit",
    bucket: Column | None = None,
    floor: float | None = None,
) -> DataFrame:
    """``sweep`` from a materialised (keys, score, pos, neg) table."""
    keys = list(keys)
    offers = histogram if floor is None else histogram.where(F.col("score") > floor)
    limits = offers.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    points = grid_points(limits, keys, "_lo", "_hi", grid, span)
    zero = F.lit(0).cast("long")
    merged = histogram.unionByName(points.select(*keys, "score", zero.alias("pos"), zero.alias("neg")))
    merged = merged.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    curve = cumulative_counts(merged, keys, bucket)
    if floor is not None:
        curve = curve.where(F.col("score") > floor)
    return with_rates(curve.withColumnRenamed("score", "threshold"))


def _picked(curve: DataFrame, keys: Sequence[str], rank: Column, extra: Sequence[str] = ()) -> DataFrame:
    cols = ["threshold", *COUNTS, "precision", "recall", "false_positive_rate", "f1", *extra]
    best = F.max_by(F.struct(*cols), rank).alias("_p")
    return curve.groupBy(*keys).agg(best, F.max("all_pos").alias("_pos"), F.max("threshold").alias("_top"))


def recall_first(curve: DataFrame, keys: Sequence[str], target: Column | float, *, precise: bool = False) -> DataFrame:
    """Lowest FPR among thresholds that reach the recall target.

    If none does: highest recall, then lowest FPR, then highest F1.  ``precise``
    breaks feasible ties by precision and F1 first and infeasible ones by the
    higher threshold; otherwise the lower infeasible threshold wins.
    """
    keys = list(keys)
    goal = target if isinstance(target, Column) else F.lit(float(target))
    fpr = F.coalesce("false_positive_rate", F.lit(1.0))
    recall, f1 = F.coalesce("recall", F.lit(-1.0)), F.coalesce("f1", F.lit(-1.0))
    met = F.coalesce(F.col("recall") >= goal, F.lit(False))
    tie1 = F.coalesce("precision", F.lit(0.0)) if precise else F.lit(0.0)
    tie2 = F.coalesce("f1", F.lit(0.0)) if precise else F.lit(0.0)
    last = F.col("threshold") if precise else -F.col("threshold")
    rank = F.when(met, lex(F.lit(1), -fpr, tie1, tie2, F.col("threshold"))).otherwise(
        lex(F.lit(0), recall, -fpr, f1, last)
    )
    picked = _picked(curve.withColumn("_met", met), keys, rank, ["_met"])
    none = F.col("_pos") == 0
    reason = (
        F.when(none, "no_validation_positives")
        .when(F.col("_p._met"), "met_recall_target")
        .otherwise("recall_target_not_achievable")
    )
    return picked.select(
        *keys,
        F.when(none, F.col("_top") + 1e-6).otherwise(F.col("_p.threshold")).alias("threshold"),
        reason.alias("reason"),
        *[F.col(f"_p.{c}").alias(c) for c in (*COUNTS, "precision", "recall", "false_positive_rate", "f1")],
    )


def safe_f1(curve: DataFrame, keys: Sequence[str], preferred: float = 0.01, allowed: float = 0.02) -> DataFrame:
    """Best F1 under the preferred FPR, else the allowed one, else lowest FPR."""
    keys = list(keys)
    fpr = F.coalesce("false_positive_rate", F.lit(1.0))
    rated = F.col("false_positive_rate").isNotNull()
    band = F.when(rated & (fpr <= preferred), 2).when(rated & (fpr <= allowed), 1).otherwise(0)
    worth = [F.coalesce(c, F.lit(-1.0)) for c in ("f1", "recall", "precision")]
    rank = F.when(band > 0, lex(band, *worth, -fpr, F.col("threshold"))).otherwise(
        lex(band, -fpr, worth[0], worth[1], F.lit(0.0), -F.col("threshold"))
    )
    picked = _picked(curve.withColumn("_band", band), keys, rank, ["_band"])
    name = F.element_at(F.array(F.lit("unsafe"), F.lit("allowed_fpr"), F.lit("preferred_fpr")), F.col("_p._band") + 1)
    return picked.select(
        *keys,
        F.col("_p.threshold").alias("threshold"),
        name.alias("safety_band"),
        *[F.col(f"_p.{c}").alias(c) for c in (*COUNTS, "precision", "recall", "false_positive_rate", "f1")],
    )


def recall_cut(df: DataFrame, keys: Sequence[str], label: str, score: str, target: float) -> DataFrame:
    """Highest score at which cumulative recall reaches the target."""
    keys = list(keys)
    curve = cumulative_counts(score_histogram(df, keys, label, score), keys)
    reached = F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")) >= target
    out = curve.groupBy(*keys).agg(
        F.max(F.when(reached, F.col("score"))).alias("_cut"),
        F.min("score").alias("_low"),
        F.max("all_pos").alias("_pos"),
    )
    cut = F.when(F.col("_pos") == 0, F.lit(1.0)).otherwise(F.coalesce("_cut", "_low"))
    return out.select(*keys, cut.alias("threshold"))


def threshold_audit(chosen: DataFrame, stored: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Compare stored and reported thresholds with freshly computed ones."""
    joined = stored.join(chosen.select(*keys, F.col("threshold").alias("recomputed")), list(keys), "left")
    return joined.withColumns(
        {
            "matches_stored": F.abs(F.col("stored_threshold") - F.col("recomputed")) < tolerance,
            "matches_metrics": F.abs(F.col("metrics_threshold") - F.col("stored_threshold")) < tolerance,
        }
    )


def at_thresholds(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Attach each key's chosen threshold and the decision it gives."""
    picked = thresholds.select(*keys, F.col("threshold").alias("applied_threshold"))
    joined = df.join(picked, list(keys)) if keys else df.crossJoin(F.broadcast(picked))
    return joined.withColumn("decision", F.col(score) >= F.col("applied_threshold"))
