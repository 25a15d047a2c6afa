"""Few-shot adaptation over clip records, in long form.

A record is (target, shot, seed).  Support sets hold at most five clips, so
arrays over one support set are bounded; query rows are never gathered.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.numeric import dot, lex, logit, sigmoid, unit
from .metrics import count_aggs, count_if, ordered_statistics, rate_exprs
from .ranking import first_rows
from .sampling import eligibility, support_ranking

# Ship the task functions inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Support seeds and shots.
SEEDS = (20260620, 20260621, 20260622, 20260623, 20260624)
SHOTS = (3, 5)
RECORD = ["target", "shot", "seed"]

# Preference among methods of equal worth.
METHODS = (
    "zero_shot",
    "stage2_positive_bias",
    "stage2_cosine_prototype",
    "stage2_finetune_bias_only",
    "stage2_finetune_head",
    "stage1_finetune_bias_only",
    "stage1_finetune_head",
    "stage1_stage2_combined",
)

# Safety limits.
FPR_LIMIT, FPR_INCREASE, SLACK = 0.03, 0.02, 1e-12


# --- records -------------------------------------------------------------------


def clip_records(windows: DataFrame, theta1: float, theta2: float, top_k: int, keep: Sequence[str]) -> DataFrame:
    """One row per clip: base score, logit, decision and its best embedding.

    The pool is the top-k candidates or, without any, the single best window.
    """
    logits = windows.withColumns(
        {"_logit": logit(F.col("stage2_score")), "_candidate": F.col("stage1_score") >= theta1}
    )
    order = [F.col("stage1_score").desc(), F.col("window_index").asc()]
    pool = first_rows(logits, ["clip_id"], order, top_k, "_rank").where(F.col("_candidate") | (F.col("_rank") == 1))
    is_candidate = F.col("_candidate")
    out = pool.groupBy("clip_id").agg(
        F.first(F.struct(*keep), ignorenulls=True).alias("_m"),
        F.max(is_candidate).alias("stage1_candidate"),
        F.max(F.when(is_candidate, F.col("stage2_score"))).alias("_score"),
        F.max(F.when(is_candidate, F.col("_logit"))).alias("_blogit"),
        F.max_by("embedding", F.struct(F.col("stage2_score"), -F.col("_rank"))).alias("embedding"),
    )
    score = F.coalesce("_score", F.lit(0.0))
    return out.select(
        "clip_id",
        "_m.*",
        "stage1_candidate",
        score.alias("base_score"),
        F.coalesce("_blogit", F.lit(-20.0)).alias("base_logit"),
        (F.col("stage1_candidate") & (score >= theta2)).alias("base_decision"),
        "embedding",
    )


def supports(clips: DataFrame, seeds: Sequence[int] = SEEDS, shots: Sequence[int] = SHOTS) -> DataFrame:
    """Nested support sets: the smaller one is a prefix of the larger."""
    ranked = support_ranking(clips, "target", seeds, max(shots))
    fit = eligibility(clips, "target", shots).where("eligible").select("target", "shot")
    return ranked.join(fit, "target").where(F.col("support_rank") <= F.col("shot"))


def query_rows(clips: DataFrame, support: DataFrame, seeds: Sequence[int] = SEEDS, shots: Sequence[int] = SHOTS) -> DataFrame:
    """Target clips of each record that are not in its support."""
    fit = eligibility(clips, "target", shots).where("eligible").select("target", "shot")
    rows = clips.join(fit, "target").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return rows.join(support.select(*RECORD, "clip_id"), [*RECORD, "clip_id"], "left_anti")


def support_checks(support: DataFrame, query: DataFrame, content: str) -> DataFrame:
    """Counts that must all be zero, per shot."""
    held = support.select(*RECORD, content).distinct()
    overlap = query.join(held, [*RECORD, content], "left_semi").groupBy("shot").agg(F.count(F.lit(1)).alias("shared_content"))
    ids = query.join(support.select(*RECORD, "clip_id"), [*RECORD, "clip_id"], "left_semi")
    shared = ids.groupBy("shot").agg(F.count(F.lit(1)).alias("shared_clips"))
    base = support.groupBy("shot").agg(F.count(F.lit(1)).alias("support_rows"), F.count_if(F.col("label") != 1).alias("negatives"))
    return base.join(overlap, "shot", "left").join(shared, "shot", "left").na.fill(0)


def replay_lists(clips: DataFrame, seeds: Sequence[int], positives: int, negatives: int) -> DataFrame:
    """One row per seed: the ids any target can draw replay from, in hash order.

    Each owner is cut to as many of its best keys as a target may draw and the
    result to twice that: of those at most half belong to one target, so every
    target still finds its first foreign rows.  Ids only; no vectors.
    """
    negative = F.col("label") == 0
    hard = negative & F.col("prompt_group").startswith("P4")
    pools = {"positive": (F.col("label") == 1, positives), "hard": (hard, negatives), "any": (negative, negatives)}
    named = F.array(*[F.when(member, F.lit(name)) for name, (member, _) in pools.items()])
    cap = F.when(F.col("pool") == "positive", positives).otherwise(negatives)
    most = max(positives, negatives)
    ids = clips.select(F.col("target").alias("owner"), "clip_id", F.explode(F.array_compact(named)).alias("pool"))
    keyed = ids.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    keyed = keyed.withColumn("_key", order_key(F.col("seed"), F.col("clip_id")))
    order = [F.col("_key"), F.col("clip_id")]
    own = first_rows(keyed, ["seed", "pool", "owner"], order, most, "_own").where(F.col("_own") <= cap)
    best = first_rows(own, ["seed", "pool"], order, 2 * most, "_all").where(F.col("_all") <= 2 * cap)
    member = F.struct("_all", "owner", "clip_id")
    return best.groupBy("seed").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("pool") == name, member))).alias(name) for name in pools]
    )


def source_replay(clips: DataFrame, seeds: Sequence[int] = SEEDS, *, positives: int = 24, negatives: int = 48) -> DataFrame:
    """Per (target, seed) rows of other participants: positives and negatives.

    Hard negatives are used alone when the others have any.  A target's rows
    are the first of its seed's list that are not its own, read off inside one
    row; the clips' columns are joined last.  ``clip_id`` is unique.
    """
    targets = clips.select("target").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    # Bounded by construction: a row per seed with 2 * (positives + 2 * negatives) ids.
    lists = targets.join(F.broadcast(replay_lists(clips, seeds, positives, negatives)), "seed")

    def foreign(name, cap):
        return F.slice(F.filter(name, lambda m: m["owner"] != F.col("target")), 1, cap)

    def tagged(rows, pool):
        return F.transform(rows, lambda m: F.struct(F.lit(pool).alias("pool"), m["clip_id"].alias("clip_id")))

    cut_lists = lists.select(
        "target", "seed", foreign("positive", positives).alias("positive"), foreign("hard", negatives).alias("hard"), foreign("any", negatives).alias("any")
    )
    negative = F.when(F.size("hard") > 0, tagged(F.col("hard"), "hard")).otherwise(tagged(F.col("any"), "any"))
    drawn = cut_lists.select("target", "seed", F.inline(F.concat(tagged(F.col("positive"), "positive"), negative)))
    return drawn.join(clips.withColumnRenamed("target", "owner"), "clip_id")


def replay_classes(rows: DataFrame, development: DataFrame, unit: str, phrases: Sequence[str], phrase: Column) -> DataFrame:
    """Development participants only, split into three replay classes."""
    listed = F.lower(F.trim(phrase)).isin(*phrases)
    kind = (
        F.when(F.col("label") == 1, "source_positive")
        .when(listed, "source_hard_negative")
        .otherwise("source_general_negative")
    )
    return rows.join(development.select(unit), unit, "left_semi").withColumn("replay_class", kind)


# --- prototypes ------------------------------------------------------------------


def prototypes(support: DataFrame, keys: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """L2-normalised mean of L2-normalised support vectors.

    Averaged by position, so the vectors of a key merge map-side.  A zero or
    non-finite vector, or vectors of several sizes, fail their key: its
    prototype is null, and ``bad_vectors`` lists the rows.
    """
    wrong = F.coalesce(F.max(unit(F.col(embedding)).isNull()), F.lit(True)) | (F.min(F.size(embedding)) != F.max(F.size(embedding)))
    sound = support.groupBy(*keys).agg((~wrong).alias("_sound"))
    long = support.select(*keys, F.posexplode(unit(F.col(embedding))).alias("_i", "_x"))
    means = long.groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    vectors = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    prototype = F.when(F.col("_sound"), unit(F.transform("_v", lambda s: s["_x"])))
    return sound.join(vectors, list(keys), "left").select(*keys, prototype.alias("prototype"))


def bad_vectors(rows: DataFrame, embedding: str = "embedding", dimension: int | None = None) -> DataFrame:
    """Rows whose vector is empty, zero, non-finite or of another dimension."""
    wrong = unit(F.col(embedding)).isNull()
    if dimension is not None:
        wrong = wrong | (F.size(embedding) != dimension)
    return rows.where(wrong)


def cohesion(support: DataFrame, keys: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """Mean and minimum pairwise similarity inside each support set.

    A support set has at most a handful of vectors; its pairs are formed
    inside one row, without a self-join.
    """
    item = F.struct("clip_id", unit(F.col(embedding)).alias("u"))
    sets = support.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    vectors = F.transform("_s", lambda s: s["u"])
    pairs = F.flatten(
        F.transform(
            vectors,
            lambda a, i: F.transform(F.filter(vectors, lambda b, j: j > i), lambda b: dot(a, b)),
        )
    )
    staged = sets.select(*keys, F.size("_s").alias("support_count"), pairs.alias("_p"))
    mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / F.size("_p")
    return staged.select(
        *keys,
        "support_count",
        F.when(F.size("_p") > 0, mean).alias("pairwise_mean"),
        F.array_min("_p").alias("pairwise_min"),
    )


def support_statistics(support: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quantiles of one support set's logits and stage-1 scores."""
    logits, n = F.sort_array(F.collect_list("base_logit")), F.count(F.lit(1))
    return support.groupBy(*keys).agg(
        F.min("base_logit").alias("q_min"),
        F.percentile("base_logit", 0.2).alias("q_q20"),
        F.percentile("base_logit", 0.5).alias("q_median"),
        F.element_at(logits, (F.floor(n / 2) + 1).cast("int")).alias("q_upper"),
        F.percentile("stage1_clip_score", 0.5).alias("stage1_median"),
        F.max("theta2_logit").alias("theta2_logit"),
        F.max("theta1").alias("theta1"),
    )


def bounded_bias(theta: Column, quantile: Column, max_bias: Column | float, margin: Column | float) -> Column:
    wide = max_bias if isinstance(max_bias, Column) else F.lit(float(max_bias))
    extra = margin if isinstance(margin, Column) else F.lit(float(margin))
    return F.least(wide, F.greatest(F.lit(0.0), theta - quantile + extra))


def calibrated_threshold(theta: Column, median: Column, margin: float, max_drop: float) -> Column:
    """Threshold lowered towards the support median by at most ``max_drop``."""
    return F.greatest(theta - max_drop, F.least(theta, median - margin))


def prototype_or(score: Column, theta: Column, similarity: Column, limit: float) -> Column:
    return (score >= theta) | (similarity >= limit)


def weighted_blend(score: Column, similarity: Column, weight: float) -> Column:
    return score * (1.0 - weight) + similarity * weight


def biased_score(score: Column, bias: Column) -> Column:
    return sigmoid(logit(score) + F.greatest(F.lit(0.0), bias))


# --- recipes ---------------------------------------------------------------------


def recipe_grid() -> list[tuple]:
    """(index, recipe, method, alpha, beta, max_bias, margin, quantile)."""
    rows: list[tuple] = [("zero_shot", "zero_shot", 0.0, 0.0, 0.0, 0.0, "none")]
    for alpha, beta in product((0.25, 0.5, 1.0, 2.0, 4.0), (0.0, 0.25, 0.5)):
        rows.append((f"cosine:{alpha}:{beta}", "stage2_cosine_prototype", alpha, beta, 0.0, 0.0, "none"))
    for width, margin, q in product((0.25, 0.5, 1.0, 2.0), (0.0, 0.25, 0.5), ("min", "q20", "median")):
        rows.append((f"bias:{width}:{margin}:{q}", "stage2_positive_bias", 0.0, 0.0, width, margin, q))
    return [(i, *r) for i, r in enumerate(rows)]


# Learning rates, step counts and ridge weights of the fitted methods.
FINETUNE_RATES = (1e-4, 3e-4, 1e-3)
BIAS_STEPS, HEAD_STEPS = (5, 10, 25, 50), (5, 10, 25)
BIAS_RIDGE, HEAD_RIDGE = 1.0, 10.0


def finetune_grid() -> list[tuple]:
    """(recipe, method, steps, rate) of the fitted methods."""
    bias, head = BIAS_STEPS, HEAD_STEPS
    plan = {
        "stage2_finetune_bias_only": bias,
        "stage2_finetune_head": head,
        "stage1_finetune_bias_only": bias,
        "stage1_finetune_head": head,
    }
    return [(f"{m}:{s}:{r}", m, s, r) for m, steps in plan.items() for s, r in product(steps, FINETUNE_RATES)]


def real_grid(thresholds: Sequence[float] = ()) -> list[tuple]:
    """(method, quantile, margin, limit, alpha, beta, threshold) of the onboarding study."""
    rows: list[tuple] = []
    for q in ("min", "q20", "median"):
        rows += [("support_threshold_calibration", q, m, d, None, None, None) for m, d in product((0.0, 0.05, 0.10, 0.15), (0.05, 0.10, 0.20, 0.30))]
        rows += [("positive_bias_adaptation", q, m, b, None, None, None) for m, b in product((0.0, 0.25, 0.5, 1.0), (0.25, 0.5, 1.0, 2.0))]
    levels = sorted({0.50, 0.75, 0.90, 1.0, *thresholds})
    rows += [("prototype_fusion", None, None, None, a, b, t) for a, b, t in product((0.25, 0.5, 1.0, 2.0, 4.0), (0.0, 0.25, 0.5), levels)]
    return [*rows, ("keyword_or_two_stage", None, None, None, None, None, None)]


def target_grid() -> list[tuple]:
    """(method, max_drop, margin, bias, cosine_threshold) of the target-level study."""
    rows: list[tuple] = [("no_adaptation", None, None, None, None)]
    for drop, margin in product((0.05, 0.10, 0.20, 0.30), (0.0, 0.02, 0.05)):
        rows += [(m, drop, margin, None, None) for m in ("target_threshold_calibration", "stage1_threshold_calibration")]
    rows += [("positive_bias", None, None, b, None) for b in (0.10, 0.25, 0.50, 1.00)]
    return rows + [("target_prototype_fusion", None, None, None, t) for t in (0.70, 0.75, 0.80, 0.85, 0.90)]


def onboarding_grid() -> list[tuple]:
    """(method, top_k, alpha, threshold) of the prototype study."""
    rows: list[tuple] = []
    for k in (1, 3):
        rows += [("prototype_only", k, 0.0, round(0.55 + 0.05 * i, 2)) for i in range(9)]
        rows += [("base_plus_prototype", k, a, round(0.50 + 0.05 * i, 2)) for a, i in product((0.25, 0.5, 1.0, 2.0), range(17))]
    return rows


def _recipes() -> Column:
    names = ("recipe_index", "recipe", "method", "alpha", "beta", "max_bias", "margin", "quantile")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in recipe_grid()])


def with_recipes(rows: DataFrame) -> DataFrame:
    """Rows times the recipe grid, exploded inside each row: no join, no shuffle."""
    return rows.withColumn("_r", F.explode(_recipes())).select("*", "_r.*").drop("_r")


def with_support_facts(query: DataFrame, support: DataFrame) -> DataFrame:
    """Query rows with their record's quantiles and prototype similarity."""
    stats = support_statistics(support, RECORD).select(*RECORD, "q_min", "q_q20", "q_median")
    protos = prototypes(support, RECORD)
    joined = query.join(stats.join(protos, RECORD), RECORD)
    similarity = dot(unit(F.col("embedding")), F.col("prototype"))
    return joined.withColumn("similarity", similarity).drop("prototype", "embedding")


def adapted(facts: DataFrame) -> DataFrame:
    """Every query row under every recipe, exploded inside its row.

    Logits are compared at nine digits, so ties do not hinge on float noise.
    """
    each = with_recipes(facts)
    theta, base = F.col("theta2_logit"), F.col("base_logit")
    fused = base + F.col("alpha") * (F.col("similarity") - F.col("beta"))
    quantile = F.when(F.col("quantile") == "min", F.col("q_min")).when(F.col("quantile") == "q20", F.col("q_q20")).otherwise(F.col("q_median"))
    biased = base + bounded_bias(theta, quantile, F.col("max_bias"), F.col("margin"))
    level = F.when(F.col("method") == "stage2_cosine_prototype", fused).otherwise(biased)
    decision = F.when(F.col("method") == "zero_shot", F.col("base_decision")).otherwise(
        F.col("stage1_candidate") & (F.round(level, 9) >= theta)
    )
    return each.withColumn("adapted_decision", decision)


def recipe_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero-shot and adapted confusion cells plus error counters: additive."""
    label = F.col("label")
    passed = F.col("base_logit") >= F.col("theta2_logit")
    candidate = F.col("stage1_candidate")
    return rows.groupBy(*keys).agg(
        *count_aggs(label, F.col("base_decision"), "zero_"),
        *count_aggs(label, F.col("adapted_decision"), "new_"),
        count_if(F.col("base_decision") != F.col("adapted_decision")).alias("changed"),
        count_if((label == 1) & ~candidate).alias("stage1_misses"),
        count_if((label == 1) & candidate & ~passed).alias("stage2_rejects"),
        count_if((label == 0) & F.col("adapted_decision")).alias("final_false_accepts"),
    )


CELLS = [f"{p}_{c}" for p in ("zero", "new") for c in ("tp", "tn", "fp", "fn")]
COUNTERS = ["changed", "stage1_misses", "stage2_rejects", "final_false_accepts"]


def with_deltas(counts: DataFrame) -> DataFrame:
    """Rates on both sides, their differences and the safety gate."""
    zero, new = rate_exprs("zero_"), rate_exprs("new_")
    names = {"f1": "f1", "recall": "recall", "false_positive_rate": "fpr"}
    out = counts.withColumns(
        {
            **{f"zero_{short}": zero[n] for n, short in names.items()},
            **{f"new_{short}": new[n] for n, short in names.items()},
        }
    )
    gap = {f"delta_{s}": F.coalesce(f"new_{s}", F.lit(0.0)) - F.coalesce(f"zero_{s}", F.lit(0.0)) for s in names.values()}
    return out.withColumns(gap).withColumn("safe", safety_gate(F.col("zero_fpr"), F.col("new_fpr")))


def safety_gate(base: Column, new: Column, limit: float = FPR_LIMIT, increase: float = FPR_INCREASE, slack: float = SLACK) -> Column:
    before, after = F.coalesce(base, F.lit(0.0)), F.coalesce(new, F.lit(0.0))
    return (after - before <= increase + slack) & (after <= limit + slack)


def select_recipes(per_target: DataFrame) -> DataFrame:
    """Best recipe per (held-out target, shot, method) on the other targets.

    Counts are additive, so the development totals are the grand totals minus
    the held-out target's own.  Without a safe recipe zero-shot is used.
    """
    recipe = ["shot", "method", "recipe", "recipe_index"]
    sums = [*CELLS, *COUNTERS]
    totals = per_target.groupBy(*recipe).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    joined = per_target.join(totals, recipe)
    dev = joined.select("target", *recipe, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in sums])
    rated = with_deltas(dev).withColumns(
        {"_df1": F.round("delta_f1", 9), "_drec": F.round("delta_recall", 9), "_chg": (F.col("changed") > 0).cast("int")}
    )
    rank = lex(F.col("safe").cast("int"), F.col("_df1"), F.col("_drec"), F.col("_chg"), -F.col("recipe_index"))
    shown = F.struct("recipe", "safe", "delta_f1", "delta_recall", "new_fpr")
    best = rated.groupBy("target", "shot", "method").agg(F.max_by(shown, rank).alias("_b"))
    return best.select(
        "target",
        "shot",
        "method",
        F.when(F.col("_b.safe"), F.col("_b.recipe")).otherwise("zero_shot").alias("recipe"),
        F.col("_b.safe").alias("selection_safe"),
        *[F.col(f"_b.{c}").alias(c) for c in ("delta_f1", "delta_recall", "new_fpr")],
    )


def summaries(chosen: DataFrame) -> DataFrame:
    """Per seed, per target and per method in one grouping-sets pass."""
    sums = [F.sum(c).alias(c) for c in [*CELLS, *COUNTERS]]
    sets = [["target", "shot", "seed", "method"], ["target", "shot", "method"], ["shot", "method"]]
    out = chosen.groupingSets(sets, "target", "shot", "seed", "method").agg(F.grouping_id().alias("_g"), *sums)
    level = F.when(F.col("_g") == 0, "seed").when(F.col("_g") == 2, "target").otherwise("method")
    rated = with_deltas(out).withColumn("level", level)
    change = F.when(F.col("delta_f1") > 1e-12, "improved").when(F.col("delta_f1") < -1e-12, "degraded").otherwise("unchanged")
    return rated.withColumns(
        {"change_label": change, "fpr_unstable": (F.col("new_tn") + F.col("new_fp")) < 5}
    ).drop("_g")


def method_overview(summary: DataFrame) -> DataFrame:
    """Macro F1, mean and median change and safety rate over targets."""
    rows = summary.where(F.col("level") == "target").withColumn("_delta", F.round("delta_f1", 9))
    keys, n = ["shot", "method"], F.col("n")
    middle = ordered_statistics(rows, keys, "_delta", {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2)})
    medians = middle.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2.0).alias("median_delta_f1"))
    return (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("targets"),
            F.avg("new_f1").alias("macro_f1"),
            F.avg("delta_f1").alias("mean_delta_f1"),
            count_if(F.col("change_label") == "improved").alias("improved"),
            count_if(F.col("change_label") == "degraded").alias("degraded"),
            count_if(F.col("change_label") == "unchanged").alias("unchanged"),
            F.avg(F.col("safe").cast("double")).alias("safety_pass_rate"),
        )
        .join(medians, keys)
    )


def combine_stages(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trigger where the stage-1 side passes (or only stage 2 had refused) and stage 2 passes."""
    left = one.select(*keys, F.col("adapted_decision").alias("_one"), F.col("base_decision").alias("_zero"), F.col("stage2_reject").alias("_reject"))
    joined = two.join(left, list(keys))
    side = F.col("_one") | (F.col("_zero") & F.col("_reject"))
    return joined.withColumn("adapted_decision", side & F.col("adapted_decision")).drop("_one", "_zero", "_reject")


# --- fitted recipes ----------------------------------------------------------------


def _descend(design: np.ndarray, base: np.ndarray, y: np.ndarray, rates: np.ndarray, stops: set[int], ridge: float) -> dict[int, np.ndarray]:
    """Ridge-damped logistic steps for all rates at once, kept at ``stops``.

    ``design`` has a row per clip and a last column of ones; a state has a row
    per coefficient, the intercept last, and a column per rate.
    """
    state, kept = np.zeros((design.shape[1], len(rates))), {}
    for step in range(1, max(stops) + 1):
        residual = 1.0 / (1.0 + np.exp(-(base[:, None] + design @ state))) - y[:, None]
        state = state - rates * (design.T @ residual / len(y) + ridge * state)
        if step in stops:
            kept[step] = state
    return kept


def _fit(grid: list[tuple]):
    """Task function: every fitted recipe of one record's few dozen rows."""
    first = len(recipe_grid())
    wanted: dict[str, list[tuple]] = {}
    for i, (recipe, method, steps, rate) in enumerate(grid):
        wanted.setdefault(method, []).append((first + i, recipe, steps, rate))

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows.iloc[0]
        y = rows["label"].to_numpy(dtype=float)
        near = rows["part"].isin(["support", "negative"]).to_numpy()
        ones = np.ones((len(rows), 1))
        margin = (rows["stage1_clip_score"] - rows["theta1"]).to_numpy(dtype=float)[:, None]
        base = {2: rows["base_logit"].to_numpy(dtype=float), 1: rows["stage1_logit"].to_numpy(dtype=float)}
        fits = []
        for method, recipes in wanted.items():
            stage = 2 if method.startswith("stage2") else 1
            used = near if stage == 1 else np.ones(len(rows), dtype=bool)
            head = method.endswith("head")
            slopes = (np.stack(rows["embedding"].to_numpy()).astype(float) if stage == 2 else margin) if head else ones[:, :0]
            rates = sorted({r for *_, r in recipes})
            states = _descend(
                np.hstack([slopes, ones])[used], base[stage][used], y[used], np.array(rates), {n for _, _, n, _ in recipes}, HEAD_RIDGE if head else BIAS_RIDGE
            )
            for index, recipe, steps, rate in recipes:
                found = states[steps][:, rates.index(rate)]
                fits.append({"recipe_index": index, "recipe": recipe, "method": method, "bias": float(found[-1]), "weights": found[:-1].tolist()})
        return pd.DataFrame([(key["target"], key["shot"], key["seed"], fits)], columns=[*RECORD, "fits"])

    return task


def record_fits(support: DataFrame, replay: DataFrame, grid: list[tuple] | None = None) -> DataFrame:
    """One row per record with all its fitted recipes in an array.

    A group holds one support set and its capped replay: at most 77 rows.
    """
    cols = ["target", "seed", "label", "base_logit", "stage1_clip_score", "theta1", "embedding"]
    own = support.select("shot", *cols, F.lit("support").alias("part"))
    part = F.when(F.col("pool") == "positive", "positive").otherwise("negative")
    shots = support.select(*RECORD).distinct()
    drawn = replay.select(*cols, part.alias("part")).join(shots, ["target", "seed"])
    rows = own.unionByName(drawn).withColumn("stage1_logit", logit(F.col("stage1_clip_score")))
    kinds = dict(support.dtypes)
    fit = "struct<recipe_index: int, recipe: string, method: string, bias: double, weights: array<double>>"
    schema = f"target {kinds['target']}, shot int, seed int, fits array<{fit}>"
    return rows.groupBy(*RECORD).applyInPandas(_fit(grid or finetune_grid()), schema=schema)


def fit_recipes(support: DataFrame, replay: DataFrame, grid: list[tuple] | None = None) -> DataFrame:
    """Biases and linear adapters per record and recipe, in long form."""
    return record_fits(support, replay, grid).select(*RECORD, F.inline("fits"))


def apply_fits(query: DataFrame, fits: DataFrame) -> DataFrame:
    """Decisions of the fitted recipes on the query rows of their record.

    A query row meets its record's array once; vectors and weights are gone
    before the row is unfolded by recipe.  Levels are compared at nine digits.
    """
    candidate, passed = F.col("stage1_candidate"), F.col("base_logit") >= F.col("theta2_logit")
    margin = F.col("stage1_clip_score") - F.col("theta1")
    one, theta1 = logit(F.col("stage1_clip_score")), F.round(logit(F.col("theta1")), 9)

    def decided(fit):
        slope = F.when(fit["method"] == "stage2_finetune_head", dot(F.col("embedding"), fit["weights"])).when(
            fit["method"] == "stage1_finetune_head", F.get(fit["weights"], F.lit(0)) * margin
        )
        shift = fit["bias"] + F.coalesce(slope, F.lit(0.0))
        two = candidate & (F.round(F.col("base_logit") + shift, 9) >= F.col("theta2_logit"))
        return F.when(fit["method"].startswith("stage2"), two).otherwise((F.round(one + shift, 9) >= theta1) & passed)

    def named(fit):
        return F.struct(*[fit[c].alias(c) for c in ("recipe_index", "recipe", "method")], decided(fit).alias("adapted_decision"))

    each = query.join(fits, RECORD).withColumn("_d", F.transform("fits", named)).drop("fits", "embedding")
    return each.select("*", F.inline("_d")).drop("_d")


# What every method's decisions have in common.
DECISION = [*RECORD, "clip_id", "label", "stage1_candidate", "base_logit", "theta2_logit", "base_decision"]
RECIPE = ["recipe_index", "recipe", "method", "adapted_decision"]


def all_decisions(query: DataFrame, support: DataFrame, fits: DataFrame) -> DataFrame:
    """Every query row under every recipe, closed-form and fitted: one long table."""
    closed = adapted(with_support_facts(query, support))
    return closed.select(*DECISION, *RECIPE).unionByName(apply_fits(query, fits).select(*DECISION, *RECIPE))


# The two methods that the combined one is made of.
STAGE1_METHOD, STAGE2_METHOD, COMBINED = "stage1_finetune_bias_only", "stage2_positive_bias", "stage1_stage2_combined"


def combined_decisions(decisions: DataFrame, chosen: DataFrame, one: str = STAGE1_METHOD, two: str = STAGE2_METHOD) -> DataFrame:
    """Each target's chosen recipes of both stages, combined per query row."""
    wanted = chosen.where(F.col("method").isin(one, two)).select("target", "shot", "recipe", "method")
    rows = decisions.drop("method").join(wanted, ["target", "shot", "recipe"])
    rejected = (F.col("label") == 1) & F.col("stage1_candidate") & (F.col("base_logit") < F.col("theta2_logit"))
    first = rows.where(F.col("method") == one).withColumn("stage2_reject", rejected)
    out = combine_stages(first, rows.where(F.col("method") == two), [*RECORD, "clip_id"])
    return out.withColumn("method", F.lit(COMBINED))


# --- studies: the other recipe grids -----------------------------------------------

def literal_rows(kinds: dict[str, str], rows: Sequence[tuple]) -> Column:
    """A constant array of structs, to be unfolded inside a row."""

    def shown(value, kind):
        quoted = "NULL" if value is None else f"'{value}'" if isinstance(value, str) else repr(value)
        return f"CAST({quoted} AS {kind})"

    structs = ["named_struct(" + ", ".join(f"'{n}', {shown(v, k)}" for (n, k), v in zip(kinds.items(), row)) + ")" for row in rows]
    return F.expr(f"array({', '.join(structs)})")


STUDY = ("study", "recipe_index", "recipe", "method", "quantile", "margin", "width", "alpha", "beta", "threshold")
NO_RECIPE = "no_adaptation_zero_shot_fallback"


def study_recipes(thresholds: Sequence[float] = ()) -> list[tuple]:
    """The onboarding study's and the target-level study's grids in one shape, see ``STUDY``.

    ``width`` is the largest threshold drop or bias, ``threshold`` a score or
    similarity limit.
    """
    rows: list[tuple] = []
    for i, (method, q, margin, width, alpha, beta, level) in enumerate(real_grid(thresholds)):
        rows.append(("real", i, method, q, margin, width, alpha, beta, level))
    for i, (method, drop, margin, bias, level) in enumerate(target_grid()):
        rows.append(("target", i, method, None, margin, bias if drop is None else drop, None, None, level))

    def name(method, *values):
        return ":".join([method, *[str(v) for v in values if v is not None]])

    return [(study, i, name(method, *rest), method, *rest) for study, i, method, *rest in rows]


def study_facts(query: DataFrame, support: DataFrame) -> DataFrame:
    """Query rows with score and logit quantiles, stage-1 median and similarity of their record."""
    score = sigmoid(F.col("base_logit"))
    stats = support_statistics(support, RECORD).select(*RECORD, "q_min", "q_q20", "q_median", "stage1_median")
    levels = support.groupBy(*RECORD).agg(
        F.min(score).alias("s_min"), F.percentile(score, 0.2).alias("s_q20"), F.percentile(score, 0.5).alias("s_median")
    )
    joined = query.join(stats.join(levels, RECORD).join(prototypes(support, RECORD), RECORD), RECORD)
    similarity = dot(unit(F.col("embedding")), F.col("prototype"))
    return joined.withColumns({"similarity": similarity, "base_score": score}).drop("prototype", "embedding")


def study_decisions(facts: DataFrame, keyword: Column, theta2: float = 0.5, thresholds: Sequence[float] = ()) -> DataFrame:
    """Every query row under every recipe of both studies, unfolded inside its row.

    ``keyword`` says whether the recognised words hold the keyword.  Scores and
    logits are compared at nine digits.
    """
    kinds = dict(zip(STUDY, ("string", "int", "string", "string", "string", *["double"] * 5)))
    each = facts.withColumn("_keyword", keyword).select("*", F.inline(literal_rows(kinds, study_recipes(thresholds))))

    def quantile(p):
        return F.when(F.col("quantile") == "min", F.col(f"{p}_min")).when(F.col("quantile") == "q20", F.col(f"{p}_q20")).otherwise(F.col(f"{p}_median"))

    def at_least(level, limit):
        return F.round(level, 9) >= F.round(limit, 9)

    theta, score, candidate, method = F.lit(theta2), F.col("base_score"), F.col("stage1_candidate"), F.col("method")
    margin, width = F.col("margin"), F.col("width")
    lowered = F.greatest(theta - width, quantile("s") - margin)
    biased = F.col("base_logit") + bounded_bias(F.col("theta2_logit"), quantile("q"), width, margin)
    fused = score + F.col("alpha") * (F.col("similarity") - F.col("beta"))
    one = calibrated_threshold(F.col("theta1"), F.col("stage1_median"), margin, width)
    decision = (
        F.when(method == "no_adaptation", F.col("base_decision"))
        .when(method == "support_threshold_calibration", candidate & at_least(score, F.least(theta, lowered)))
        .when(method == "positive_bias_adaptation", candidate & at_least(biased, F.col("theta2_logit")))
        .when(method == "prototype_fusion", candidate & at_least(fused, F.col("threshold")))
        .when(method == "keyword_or_two_stage", F.col("base_decision") | F.col("_keyword"))
        .when(method == "target_threshold_calibration", candidate & at_least(score, calibrated_threshold(theta, F.col("s_median"), margin, width)))
        .when(method == "stage1_threshold_calibration", at_least(F.col("stage1_clip_score"), one) & at_least(score, theta))
        .when(method == "positive_bias", candidate & at_least(sigmoid(logit(score) + width), theta))
        .when(method == "target_prototype_fusion", candidate & (at_least(score, theta) | at_least(F.col("similarity"), F.col("threshold"))))
    )
    return each.withColumn("adapted_decision", decision)


def choose_real_recipe(pooled: DataFrame) -> DataFrame:
    """The safe recipe from support that gains most F1, else the named fallback.

    ``pooled`` has one row of cells per recipe over shots and seeds.  Ties go
    to higher recall, then to the lower false-positive rate and grid index.
    """
    rated = with_deltas(pooled)
    both = F.col("zero_f1").isNotNull() & F.col("new_f1").isNotNull()
    gain = F.round("delta_f1", 9)
    ready = F.col("safe") & (F.col("changed") > 0) & (F.col("method") != "keyword_or_two_stage") & both & (gain > 0)
    rank = lex(gain, F.round(F.coalesce("new_recall", F.lit(0.0)), 9), -F.round(F.coalesce("new_fpr", F.lit(0.0)), 9), -F.col("recipe_index"))
    best = F.max_by(F.when(ready, F.col("recipe")), F.when(ready, rank))
    return rated.agg(
        F.coalesce(best, F.lit(NO_RECIPE)).alias("recipe"),
        F.max(F.when(ready, gain)).alias("delta_f1"),
        count_if(F.col("safe")).alias("safe_recipes"),
        count_if(ready).alias("selectable"),
    )


def choose_target_recipe(per_target: DataFrame) -> DataFrame:
    """Per held-out target and shot the recipe that is best on the other targets.

    Totals minus the target's own cells; no adaptation where nothing safe gains.
    """
    recipe, sums = ["shot", "recipe", "recipe_index"], [*CELLS, *COUNTERS]
    totals = per_target.groupBy(*recipe).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    others = per_target.join(totals, recipe).select("target", *recipe, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in sums])
    rated = with_deltas(others)
    gain = F.round("delta_f1", 9)
    rank = lex(F.col("safe").cast("int"), gain, F.round(F.coalesce("new_f1", F.lit(0.0)), 9), -F.round(F.coalesce("new_fpr", F.lit(0.0)), 9), -F.col("recipe_index"))
    best = rated.groupBy("target", "shot").agg(F.max_by(F.struct("recipe", "safe", gain.alias("gain")), rank).alias("_b"))
    kept = F.col("_b.safe") & (F.col("_b.gain") > 1e-12)
    return best.select("target", "shot", F.when(kept, F.col("_b.recipe")).otherwise("no_adaptation").alias("recipe"), F.col("_b.safe").alias("safe"), F.col("_b.gain").alias("delta_f1"))


# --- onboarding by windows ----------------------------------------------------------


def onboarding_clips(windows: DataFrame, theta1: float, theta2: float, top_k: int, keep: Sequence[str]) -> DataFrame:
    """One row per clip: its best windows by stage 1 as a bounded array.

    ``embedding`` is the one of the best window, from which supports make their
    prototype; ``pool`` holds at most ``top_k`` candidates in order.
    """
    order = [F.col("stage1_score").desc(), F.col("window_index").asc()]
    best = first_rows(windows, ["clip_id"], order, top_k, "_rank")
    candidate = F.col("stage1_score") >= theta1
    member = F.struct(F.col("_rank").alias("rank"), "stage2_score", unit(F.col("embedding")).alias("u"))
    out = best.groupBy("clip_id").agg(
        F.first(F.struct(*keep), ignorenulls=True).alias("_m"),
        F.max(candidate).alias("stage1_candidate"),
        F.coalesce(F.max(candidate & (F.col("stage2_score") >= theta2)), F.lit(False)).alias("base_decision"),
        F.min_by("embedding", "_rank").alias("_first"),
        F.sort_array(F.collect_list(F.when(candidate, member))).alias("pool"),
    )
    return out.select("clip_id", "_m.*", "stage1_candidate", "base_decision", F.col("_first").alias("embedding"), "pool")


def onboarding_decisions(query: DataFrame, support: DataFrame) -> DataFrame:
    """Query clips under the onboarding grid: best fused score of their first windows.

    Similarities are taken once a window, maxima once a (top k, alpha) pair;
    thresholds are unfolded last.  A clip without a candidate stays silent.
    """
    joined = query.join(prototypes(support, RECORD), RECORD)
    near = F.transform("pool", lambda w: F.struct(w["rank"].alias("rank"), w["stage2_score"].alias("s"), dot(w["u"], F.col("prototype")).alias("c")))
    near = joined.withColumn("_near", near).drop("pool", "prototype", "embedding")

    def best(k, alpha, only):
        score = (lambda w: w["c"]) if only else (lambda w: w["s"] + alpha * w["c"])
        return F.array_max(F.transform(F.filter("_near", lambda w: w["rank"] <= k), score))

    grid = onboarding_grid()
    pairs = list(dict.fromkeys((m, k, a) for m, k, a, _ in grid))
    scores = F.array(*[best(k, a, m == "prototype_only") for m, k, a in pairs])
    rows = [(i, f"{m}:{k}:{a}:{t}", m, pairs.index((m, k, a)), t) for i, (m, k, a, t) in enumerate(grid)]
    kinds = {"recipe_index": "int", "recipe": "string", "method": "string", "_pair": "int", "_limit": "double"}
    each = near.withColumn("_scores", scores).drop("_near").select("*", F.inline(literal_rows(kinds, rows)))
    decision = F.coalesce(F.round(F.get("_scores", F.col("_pair")), 9) >= F.col("_limit"), F.lit(False))
    return each.withColumn("adapted_decision", decision).drop("_scores", "_pair", "_limit")


def choose_onboarding_recipe(per_target: DataFrame, limit: float = 0.02) -> DataFrame:
    """The safe prototype recipe of best macro recall, macro F1 and lowest rate of false positives.

    ``per_target`` has cells per (target, recipe) over shots and seeds.
    """
    rated = with_deltas(per_target)
    pooled = rated.groupBy("recipe", "recipe_index").agg(
        *[F.sum(c).alias(c) for c in [*CELLS, *COUNTERS]], F.avg("new_recall").alias("macro_recall"), F.avg("new_f1").alias("macro_f1")
    )
    gate = with_deltas(pooled).withColumn("passed", safety_gate(F.col("zero_fpr"), F.col("new_fpr"), limit))
    worth = [F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("macro_recall", "macro_f1")]
    rank = lex(*worth, -F.round(F.coalesce("new_fpr", F.lit(0.0)), 9), -F.col("recipe_index"))
    best = F.max_by(F.when(F.col("passed"), F.col("recipe")), F.when(F.col("passed"), rank))
    return gate.agg(
        F.coalesce(best, F.lit(NO_RECIPE)).alias("recipe"), count_if(F.col("passed")).alias("safe_recipes"), F.count(F.lit(1)).alias("recipes")
    )
