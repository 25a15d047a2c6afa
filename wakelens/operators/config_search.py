"""Grid search over cascade configurations in one pass over the clips."""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import logit
from ..session import cut
from .cascade import NO_CANDIDATE, top_candidates
from .metrics import COUNTS, cumulative_counts, with_rates
from .thresholds import grid_points, safe_f1

# Ship the task functions inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The searched depths and fusion weights.
PLAIN_DEPTHS = (1, 3, 5, 8)
FUSED_DEPTHS = (3, 5, 8)
WEIGHTS_A = (0.5, 1.0, 1.5, 2.0)
WEIGHTS_B = (0.0, 0.25, 0.5, 1.0)


def config_grid() -> list[tuple[int, float, float, bool]]:
    """(top_k, a, b, use_logit) for every configuration of one variant."""
    plain = [(k, 1.0, 0.0, False) for k in PLAIN_DEPTHS]
    return plain + [(k, a, b, True) for k, a, b in product(FUSED_DEPTHS, WEIGHTS_A, WEIGHTS_B)]


def config_array(grid: list[tuple[int, float, float, bool]]) -> Column:
    items = [
        F.struct(
            F.lit(k).alias("top_k"), F.lit(a).alias("fusion_a"), F.lit(b).alias("fusion_b"), F.lit(g).alias("use_logit")
        )
        for k, a, b, g in grid
    ]
    return F.array(*items)


def clip_candidates(joined: DataFrame, theta1: Column | float, depth: int, keys: list[str], keep: list[str]) -> DataFrame:
    """Per clip the best ``depth`` candidate windows as a bounded array."""
    clips = joined.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.col("window_index")).alias("_m"))
    item = F.struct("rank", "stage2_score", logit(F.col("stage1_score")).alias("l1"), logit(F.col("stage2_score")).alias("l2"))
    tried = top_candidates(joined, theta1, depth, keys).groupBy(*keys).agg(F.collect_list(item).alias("tried"))
    return clips.join(tried, keys, "left").select(*keys, "_m.*", "tried")


def configured_scores(candidates: DataFrame, grid: list[tuple[int, float, float, bool]], keep: list[str]) -> DataFrame:
    """One row per clip and configuration, scored inside the clip's row."""
    each = candidates.select(*keep, "tried", F.inline(config_array(grid)))
    usable = F.filter("tried", lambda t: t["rank"] <= F.col("top_k"))

    def one(t):
        fused = F.col("fusion_a") * t["l2"] + F.col("fusion_b") * t["l1"]
        return F.when(F.col("use_logit"), fused).otherwise(t["stage2_score"])

    best = F.array_max(F.transform(usable, one))
    return each.withColumn("score", F.coalesce(best, F.lit(NO_CANDIDATE))).drop("tried")


CONFIG = ["variant", "top_k", "fusion_a", "fusion_b", "use_logit"]


def all_scores(grid: list[tuple[int, float, float, bool]]) -> Callable[[Column], Column]:
    """Scores of all configurations of a clip's tried windows, by the Arrow batch."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scored(tried: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(tried), 0).to_numpy(zero_copy_only=False)
        windows, starts = tried.flatten(), np.cumsum(counts) - counts
        at = np.arange(max(counts.max(initial=0), 1))
        inside = at < counts[:, None]
        place = np.where(inside, starts[:, None] + at, 0)

        def table(name):
            values = windows.field(windows.type.get_field_index(name)) if len(windows) else pa.nulls(1, pa.float64())
            flat, known = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)
            return flat[place], known[place] & inside

        tables = {name: table(name) for name in ("stage2_score", "l1", "l2")}
        out, best = np.empty((len(tried), len(grid))), {}
        for code, (k, *fusion) in enumerate(grid):
            key = tuple(fusion)
            if key not in best:
                a, b, fused = fusion
                (l1, has1), (l2, has2), (plain, known) = tables["l1"], tables["l2"], tables["stage2_score"]
                values, known = (a * l2 + b * l1, has1 & has2) if fused else (plain, known)
                # The best of the first windows, for every number of them.
                best[key] = np.maximum.accumulate(np.where(known, values, -np.inf), axis=1), np.logical_or.accumulate(known, axis=1)
            depth = min(k, len(at)) - 1
            out[:, code] = np.where(best[key][1][:, depth], best[key][0][:, depth], NO_CANDIDATE)
        ends = np.arange(len(tried) + 1, dtype=np.int32) * len(grid)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return scored


def coded_scores(candidates: DataFrame, grid: list[tuple[int, float, float, bool]], keep: list[str]) -> DataFrame:
    """``configured_scores`` with the place in the grid as ``config``.

    ``tried`` is in rank order; a depth takes the best of the first windows.
    """
    scores = candidates.select(*keep, all_scores(grid)(F.col("tried")).alias("scores"))
    # Outer, so that no filter on the scores makes them a second time.
    return scores.select(*keep, F.posexplode_outer("scores").alias("config", "score"))


# Score steps a unit: of second-stage scores and of logits.  Every monotone step gives
# the same result; a finer one leaves less to look at exactly and more bins to count.
PLAIN_STEPS, FUSED_STEPS = 1024, 64
# A configuration has at most twice as many bins and one for scores without a threshold.
LAST_BIN = 4096
FLOOR = -1.0e8


def score_bins(score: Column, steps: Column) -> Column:
    """Monotone, bounded bin of a score; those at or below ``FLOOR`` have one of their own."""
    near = F.least(F.greatest(score * steps, F.lit(-float(LAST_BIN))), F.lit(float(LAST_BIN)))
    return F.when(score > FLOOR, F.floor(near)).otherwise(-LAST_BIN - 1).cast("int")


def hopeful_bins(bins: DataFrame, keys: list[str], preferred: float, allowed: float) -> DataFrame:
    """The bins that may hold the threshold ``safe_f1`` takes, with the counts above them.

    A bin's lowest threshold has the counts of the bin and all above, so some
    threshold is surely as good.  No threshold of a bin has more positives than
    those, or fewer negatives than the bins above: a bin whose best case is worse
    than what is surely reached holds no winner.
    """
    whole = Window.partitionBy(*keys)
    above = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_tp": F.sum("pos").over(above), "_fp": F.sum("neg").over(above)}
    sums = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {"all_pos": F.sum("pos").over(whole), "all_neg": F.sum("neg").over(whole)}
    offers = bins.withColumns(sums).where(F.col("bin") >= -LAST_BIN)

    def rated(tp, fp):
        fpr = F.coalesce(F.try_divide(fp.cast("double"), F.col("all_neg").cast("double")), F.lit(1.0))
        safe = F.col("all_neg") > 0
        band = F.when(safe & (fpr <= preferred), 2).when(safe & (fpr <= allowed), 1).otherwise(0)
        f1 = F.coalesce(F.try_divide(2.0 * tp, (tp + fp + F.col("all_pos")).cast("double")), F.lit(0.0))
        return F.struct(band.alias("band"), F.when((band > 0) | ~safe, f1).otherwise(-fpr).alias("worth"))

    reach = F.col("_tp") + F.col("pos")
    judged = offers.withColumns({"_best": rated(reach, F.col("_fp")), "_sure": rated(reach, F.col("_fp") + F.col("neg"))})
    judged = judged.withColumn("_sure", F.max("_sure").over(whole))
    band, worth = F.col("_best.band") - F.col("_sure.band"), F.col("_best.worth") - F.col("_sure.worth")
    # The slack is for rounding; it lets more bins through.
    return judged.where((band > 0) | ((band == 0) & (worth >= -1e-9))).select(*keys, "bin", "_tp", "_fp", "all_pos", "all_neg")


def search(
    candidates: DataFrame,
    grid: list[tuple[int, float, float, bool]],
    roles: Callable[[DataFrame], DataFrame],
    preferred: float = 0.01,
    allowed: float = 0.02,
) -> DataFrame:
    """Threshold per (configuration, fold) on dev, pooled dev and test metrics.

    ``candidates`` has variant, fold, label and the tried windows; ``roles``
    maps rows with a fold to rows with (fold, role).  Scores are counted by bins
    first; exact scores are counted only in bins that may hold a threshold, so
    nothing but the candidates grows with the clips.  A configuration is known
    by its place in the grid until the pooled counts.
    """
    keys = ["variant", "config", "fold"]
    spot = ["variant", "config", "bin"]
    steps = F.element_at(F.array(*[F.lit(float(FUSED_STEPS if fused else PLAIN_STEPS)) for *_, fused in grid]), F.col("config") + 1)
    # Clips with the same windows, or with none, score alike: they are scored once.
    kinds = cut(candidates.groupBy("variant", "label", "fold", F.sort_array("tried").alias("tried")).agg(F.count(F.lit(1)).alias("clips")))
    scored = coded_scores(kinds, grid, ["variant", "label", "fold", "clips"]).withColumn("bin", score_bins(F.col("score"), steps))
    of = {n: F.sum(F.when(F.col("label") == label, F.col("clips")).otherwise(0)).alias(n) for n, label in (("pos", 1), ("neg", 0))}
    both = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    coarse = roles(cut(scored.groupBy(*keys, "bin").agg(*of.values(), F.min("score").alias("lo"), F.max("score").alias("hi"))))
    dev = coarse.where(F.col("role") == "dev")
    span = dev.where(F.col("bin") >= -LAST_BIN).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    points = grid_points(span, keys, "lo", "hi", 401, "data").select(*keys, "score", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    points = points.withColumn("bin", score_bins(F.col("score"), steps))
    slim = [*keys, "bin", "pos", "neg"]
    bins = dev.select(*slim).unionByName(points.select(*slim)).groupBy(*keys, "bin").agg(*both)
    hopeful = cut(hopeful_bins(bins, keys, preferred, allowed))
    default = coarse.select("variant", "config").distinct().withColumn("bin", score_bins(F.lit(0.5), steps))
    wanted = hopeful.select(*spot).unionByName(default).distinct()
    exact = roles(cut(scored.join(F.broadcast(wanted), spot).groupBy(*keys, "bin", "score").agg(*of.values())))
    near = exact.where(F.col("role") == "dev").drop("role").unionByName(points)
    near = near.join(hopeful.select(*keys, "bin"), [*keys, "bin"]).groupBy(*keys, "bin", "score").agg(*both)
    curve = cumulative_counts(near, [*keys, "bin"], F.floor(F.col("score") * steps * 256)).drop("all_pos", "all_neg")
    curve = curve.join(hopeful, [*keys, "bin"]).withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")})
    curve = curve.withColumns({"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")})
    curve = with_rates(curve.withColumnRenamed("score", "threshold"))
    chosen = safe_f1(curve, keys, preferred, allowed).select(*keys, "threshold")
    at = F.coalesce(F.col("threshold"), F.lit(0.5))
    picks = coarse.select(*keys).distinct().join(chosen, keys, "left").select(*keys, at.alias("threshold"))
    picks = cut(picks.withColumn("_at", score_bins(F.col("threshold"), steps)))
    told = ["variant", "config", "role", "pos", "neg"]
    far = coarse.join(picks, keys).where(F.col("bin") != F.col("_at")).select(*told, (F.col("bin") > F.col("_at")).alias("hit"))
    close = exact.join(picks, keys).where(F.col("bin") == F.col("_at")).select(*told, (F.col("score") >= F.col("threshold")).alias("hit"))
    hit = F.col("hit")
    cells = {"tp": F.when(hit, F.col("pos")), "tn": F.when(~hit, F.col("neg")), "fp": F.when(hit, F.col("neg")), "fn": F.when(~hit, F.col("pos"))}
    pooled = (
        far.unionByName(close)
        .groupBy("variant", "config")
        .agg(
            *[
                F.sum(F.when(F.col("role") == role, F.coalesce(cells[c], F.lit(0))).otherwise(0)).alias(f"{role}_{c}")
                for role in ("dev", "test")
                for c in COUNTS
            ]
        )
    )
    named = F.element_at(config_array(grid), F.col("config") + 1)
    pooled = pooled.withColumn("_c", named).select("variant", "_c.*", *[c for c in pooled.columns if c not in ("variant", "config")])
    shown = ("recall", "false_positive_rate", "precision", "f1")
    rated = with_rates(with_rates(pooled, "dev_", shown), "test_", shown)
    fpr = F.col("dev_false_positive_rate")
    return rated.withColumns(
        {
            "safe_preferred": F.coalesce(fpr <= preferred, F.lit(False)),
            "safe_allowed": F.coalesce(fpr <= allowed, F.lit(False)),
        }
    ).drop(*[f"{r}_{c}" for r in ("dev", "test") for c in COUNTS])


def pick_modes(results: DataFrame) -> DataFrame:
    """Balanced, safe and high-recall choices; ties go by configuration."""
    f1, recall = F.coalesce("dev_f1", F.lit(-1.0)), F.coalesce("dev_recall", F.lit(-1.0))
    fpr, precision = F.coalesce("dev_false_positive_rate", F.lit(1.0)), F.coalesce("dev_precision", F.lit(-1.0))
    name = F.struct(*CONFIG)
    band = F.when(F.col("safe_preferred"), 2).when(F.col("safe_allowed"), 1)
    ranks = {
        "balanced": (F.col("safe_allowed"), F.struct(band, f1, recall, -fpr, precision, name)),
        "safe": (F.lit(True), F.struct(-fpr, recall, name)),
        "high_recall": (F.col("safe_allowed"), F.struct(recall, f1, -fpr, name)),
    }
    cols = F.struct(*CONFIG, "dev_recall", "dev_false_positive_rate", "dev_f1", "test_recall", "test_f1")
    best = results.agg(*[F.max_by(F.when(ok, cols), F.when(ok, rank)).alias(m) for m, (ok, rank) in ranks.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("c")) for m in ranks])
    return best.select(F.inline(rows)).where(F.col("c").isNotNull()).select("mode", "c.*")
