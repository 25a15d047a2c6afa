"""Two-stage scoring over window tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import logit
from .ranking import first_rows

NO_CANDIDATE = -1.0e9


def best_first(score: str, index: str = "window_index") -> Column:
    """Aggregate key: highest score, then the earliest window."""
    return F.struct(F.col(score), -F.col(index))


def first_windows(windows: DataFrame, clip: str = "clip_id", index: str = "window_index", keep: Sequence[str] = ()) -> DataFrame:
    """First window of each clip with its window count (partial aggregates)."""
    rest = [c for c in (keep or windows.columns) if c != clip]
    out = windows.groupBy(clip).agg(
        F.min_by(F.struct(*rest), F.col(index)).alias("_first"), F.count(F.lit(1)).alias("window_count")
    )
    return out.select(clip, "_first.*", "window_count")


def clip_scores(windows: DataFrame, theta: float, *, clip: str = "clip_id", index: str = "window_index", score: str = "stage1_score", keep: Sequence[str] = ()) -> DataFrame:
    """Clip score = best window score, with that window and the decision."""
    best = F.struct(F.col(index), F.col(score), F.col("window_start_sec"), F.col("window_end_sec"))
    out = windows.groupBy(clip).agg(
        F.min_by(F.struct(*keep), F.col(index)).alias("_meta"),
        F.max_by(best, best_first(score, index)).alias("_best"),
        F.count(F.lit(1)).alias("window_count"),
    )
    return out.select(
        clip,
        "_meta.*",
        "window_count",
        F.col(f"_best.{score}").alias("score"),
        F.col(f"_best.{index}").alias("candidate_window_index"),
        F.col("_best.window_start_sec").alias("candidate_window_start_sec"),
        F.col("_best.window_end_sec").alias("candidate_window_end_sec"),
        (F.col(f"_best.{score}") >= theta).alias("stage1_candidate"),
    )


def window_cascade(stage1: DataFrame, stage2: DataFrame, theta1: float, theta2: float, keys: Sequence[str] = ("clip_id", "window_index")) -> DataFrame:
    """Both thresholds on the same window; stage-1 rows without stage 2 drop."""
    both = stage1.join(stage2, list(keys), "inner")
    candidate = F.col("stage1_score") >= theta1
    trigger = candidate & (F.col("stage2_score") >= theta2)
    return both.withColumns({"candidate": candidate, "final_trigger": trigger, "score": trigger.cast("double")})


def top_candidates(windows: DataFrame, theta: Column | float, top_k: int, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """At most ``top_k`` windows per clip above the stage-1 threshold."""
    kept = windows.where(F.col("stage1_score") >= theta)
    return first_rows(kept, keys, [F.col("stage1_score").desc(), F.col("window_index").asc()], top_k)


def clip_cascade(
    stage1: DataFrame,
    stage2: DataFrame,
    theta1: float,
    theta2: float,
    *,
    top_k: int = 3,
    keep: Sequence[str] = ("label", "prompt_group", "speaker"),
    missing: str = "reject",
    empty_score: float = 0.0,
) -> DataFrame:
    """Top-k cascade per clip.

    ``missing='reject'`` lets a candidate without a stage-2 row take a slot and
    fail; ``missing='drop'`` removes such windows before ranking.  The
    diagnostics array holds at most ``top_k`` entries.
    """
    if top_k < 1:
        raise ValueError("top_k must be >= 1")
    keys = ["clip_id", "window_index"]
    scores2 = stage2.select(*keys, "stage2_score")
    if missing == "drop":
        stage1 = stage1.join(scores2, keys)
        ranked = top_candidates(stage1, theta1, top_k)
    else:
        ranked = top_candidates(stage1, theta1, top_k).join(scores2, keys, "left")
    clips = stage1.groupBy("clip_id").agg(
        F.min_by(F.struct(*keep), F.col("window_index")).alias("_meta"),
        F.count(F.lit(1)).alias("window_count"),
        F.max("stage1_score").alias("stage1_clip_score"),
    )
    accepted = F.coalesce(F.col("stage2_score") >= theta2, F.lit(False))
    item = F.struct(
        "rank",
        "window_index",
        "window_start_sec",
        "window_end_sec",
        "stage1_score",
        "stage2_score",
        accepted.alias("accepted"),
    )
    tried = ranked.groupBy("clip_id").agg(
        F.sort_array(F.collect_list(item)).alias("candidate_windows"),
        F.min_by(F.when(accepted, F.col("window_index")), F.when(accepted, F.col("rank"))).alias("winning_window_index"),
        F.count(F.lit(1)).alias("evaluated_candidate_count"),
        F.max("stage2_score").alias("stage2_candidate_score"),
        F.max(accepted).alias("final_trigger"),
    )
    out = clips.join(tried, "clip_id", "left")
    trigger = F.coalesce(F.col("final_trigger"), F.lit(False))
    return out.select(
        "clip_id",
        "_meta.*",
        "window_count",
        "stage1_clip_score",
        F.col("candidate_windows").isNotNull().alias("stage1_candidate"),
        F.coalesce("evaluated_candidate_count", F.lit(0).cast("long")).alias("evaluated_candidate_count"),
        "candidate_windows",
        "winning_window_index",
        F.coalesce("stage2_candidate_score", F.lit(empty_score)).alias("stage2_candidate_score"),
        trigger.alias("final_trigger"),
        trigger.cast("double").alias("score"),
    )


def fused_score(stage1: Column, stage2: Column, a: Column, b: Column, use_logit: Column) -> Column:
    return F.when(use_logit, a * logit(stage2) + b * logit(stage1)).otherwise(stage2)


def fused_clip_scores(
    stage1: DataFrame,
    stage2: DataFrame,
    theta1: float,
    *,
    top_k: int = 3,
    a: float = 1.0,
    b: float = 0.0,
    use_logit: bool = False,
    keep: Sequence[str] = ("label", "prompt_group", "speaker"),
    empty_score: float = NO_CANDIDATE,
) -> DataFrame:
    """Best fused score among the top-k candidates of each clip."""
    joined = stage1.join(stage2.select("clip_id", "window_index", "stage2_score"), ["clip_id", "window_index"])
    fused = fused_score(F.col("stage1_score"), F.col("stage2_score"), F.lit(a), F.lit(b), F.lit(use_logit))
    ranked = top_candidates(joined, theta1, top_k).withColumn("_fused", fused)
    won = F.max_by(F.struct("window_index", "stage2_score"), F.struct(F.col("_fused"), -F.col("rank")))
    tried = ranked.groupBy("clip_id").agg(
        F.max("_fused").alias("_fused"), won.alias("_won"), F.count(F.lit(1)).alias("_n")
    )
    clips = joined.groupBy("clip_id").agg(
        F.max_by(F.struct(*keep), best_first("stage1_score")).alias("_meta"),
        F.count(F.lit(1)).alias("window_count"),
        F.max("stage1_score").alias("stage1_clip_score"),
    )
    return clips.join(tried, "clip_id", "left").select(
        "clip_id",
        "_meta.*",
        "window_count",
        "stage1_clip_score",
        F.col("_won").isNotNull().alias("stage1_candidate"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("evaluated_candidate_count"),
        F.coalesce("_fused", F.lit(empty_score)).alias("score"),
        F.coalesce("_won.stage2_score", F.lit(0.0)).alias("stage2_candidate_score"),
        F.col("_won.window_index").alias("winning_window_index"),
    )


def enrich(predictions: DataFrame, manifest: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Left join that fills missing prediction columns from the manifest."""
    extra = manifest.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in fill])
    joined = predictions.join(extra, list(keys), "left")
    filled = {
        c: F.coalesce(F.col(c), F.col(f"_m_{c}")) if c in predictions.columns else F.col(f"_m_{c}") for c in fill
    }
    return joined.withColumns(filled).drop(*[f"_m_{c}" for c in fill])


def prefix_scores(windows: DataFrame, keys: Sequence[str] = ("clip_id",), bucket: Column | None = None) -> DataFrame:
    """Running best score of the windows seen so far and where it occurred."""
    from .ranking import running

    best = F.struct(F.col("stage1_score"), (-F.col("window_index")).alias("neg_index"))
    step = F.floor(F.col("window_index") / 1024) if bucket is None else bucket
    out = running(windows, keys, [F.col("window_index").asc()], step, {"_best": ("max", best)})
    return out.withColumns(
        {"running_score": F.col("_best.stage1_score"), "running_index": -F.col("_best.neg_index")}
    ).drop("_best")


def strict_lookup(rows: DataFrame, source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, rows without a match); callers fail on any of the latter."""
    keys = list(keys)
    return rows.join(source, keys, "inner"), rows.join(source.select(*keys), keys, "left_anti")


def require_empty(rows: DataFrame, message: str) -> None:
    """Raise when a check finds rows; looks at one row only."""
    found = rows.limit(1).count()
    if found:
        raise ValueError(message)


def feature_coverage(manifest: DataFrame, stage1: DataFrame, stage2: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Covered and missing windows per stage; stage 2 counts where stage 1 is."""
    keys = list(keys)
    one = stage1.select(*keys).distinct().withColumn("_one", F.lit(True))
    two = stage2.select(*keys).distinct().withColumn("_two", F.lit(True))
    flagged = manifest.join(one, keys, "left").join(two, keys, "left")
    has1, has2 = F.col("_one").isNotNull(), F.col("_two").isNotNull()
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(has1).alias("stage1_covered"),
        F.count_if(~has1).alias("stage1_missing"),
        F.count_if(has1 & has2).alias("stage2_covered"),
        F.count_if(has1 & ~has2).alias("stage2_missing"),
    )


def score_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str, tolerance: float) -> DataFrame:
    """Largest score difference between two runs over the same keys."""
    keys = list(keys)
    left, right = a.select(*keys, F.col(score).alias("_a")), b.select(*keys, F.col(score).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    out = left.join(right, keys).agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs_difference"))
    return out.withColumn("within_tolerance", F.col("max_abs_difference") <= tolerance)
