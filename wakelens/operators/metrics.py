"""Confusion, curve, macro and paired metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..session import cut
from .ranking import running

COUNTS = ("tp", "tn", "fp", "fn")
RATES = (
    "precision",
    "recall",
    "false_positive_rate",
    "false_reject_rate",
    "specificity",
    "f1",
    "balanced_accuracy",
)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def count_aggs(label: Column, decision: Column, prefix: str = "") -> list[Column]:
    """The four confusion cells as mergeable aggregates."""
    hit, miss = F.coalesce(decision, F.lit(False)), ~F.coalesce(decision, F.lit(False))
    return [
        count_if((label == 1) & hit).alias(f"{prefix}tp"),
        count_if((label == 0) & miss).alias(f"{prefix}tn"),
        count_if((label == 0) & hit).alias(f"{prefix}fp"),
        count_if((label == 1) & miss).alias(f"{prefix}fn"),
    ]


def rate_exprs(prefix: str = "") -> dict[str, Column]:
    """Rates from the four cells; null wherever a denominator is empty."""
    tp, tn, fp, fn = (F.col(f"{prefix}{c}") for c in COUNTS)
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return {
        "precision": precision,
        "recall": recall,
        "false_positive_rate": ratio(fp, fp + tn),
        "false_reject_rate": ratio(fn, tp + fn),
        "specificity": specificity,
        "f1": f1,
        "balanced_accuracy": (recall + specificity) / 2.0,
    }


def with_rates(counts: DataFrame, prefix: str = "", only: Sequence[str] = RATES) -> DataFrame:
    exprs = rate_exprs(prefix)
    return counts.withColumns({f"{prefix}{name}": exprs[name] for name in only})


def confusion(df: DataFrame, keys: Sequence[str], label: str, decision: Column, prefix: str = "") -> DataFrame:
    """Confusion counts and rates per key, one partial aggregate."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *count_aggs(F.col(label), decision, prefix))
    return with_rates(counts, prefix)


def score_histogram(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: all a curve needs."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"),
    )


def score_step(score: Column, steps: int = 256) -> Column:
    """Monotone bucket of a score, used to spread one curve over tasks."""
    return F.floor(score * steps)


def cumulative_counts(histogram: DataFrame, keys: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """tp/fp at ``score >= threshold`` for every histogram row, plus tn/fn."""
    walked = running(
        histogram,
        keys,
        [F.col("score").desc()],
        score_step(F.col("score")) if bucket is None else bucket,
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
        descending=True,
        totals_as="all_",
    )
    named = walked.withColumnsRenamed({"all_tp": "all_pos", "all_fp": "all_neg"})
    return named.withColumns({"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")})


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Tie-aware AUROC and step-wise average precision per key."""
    curve = cumulative_counts(score_histogram(df, keys, label, score), keys)
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    sums = curve.groupBy(*keys).agg(
        F.max("all_pos").alias("positive"),
        F.max("all_neg").alias("negative"),
        F.sum(neg * (tp - pos / 2.0)).alias("_above"),
        F.sum(F.try_divide(pos * tp, tp + fp)).alias("_steps"),
    )
    both = (F.col("positive") > 0) & (F.col("negative") > 0)
    return sums.select(
        *keys,
        "positive",
        "negative",
        F.when(both, F.try_divide(F.col("_above"), F.col("positive") * F.col("negative").cast("double"))).alias("auroc"),
        F.when(both, F.try_divide(F.col("_steps"), F.col("positive").cast("double"))).alias("auprc"),
    )


def breakdowns(df: DataFrame, label: str, decision: str, group: str, phrase: str) -> DataFrame:
    """Overall, per prompt group and per negative phrase in one pass."""
    flagged = df.select(
        F.col(label).alias("_label"),
        F.col(decision).alias("_decision"),
        F.col(group).alias("_group"),
        F.when(F.col(label) == 0, F.col(phrase)).alias("_phrase"),
    )
    cells = (
        flagged.groupingSets([[], ["_group"], ["_phrase"]], "_group", "_phrase")
        .agg(
            F.grouping_id().alias("_gid"),
            F.count(F.lit(1)).alias("n"),
            *count_aggs(F.col("_label"), F.col("_decision")),
        )
        .where((F.col("_gid") != 2) | F.col("_phrase").isNotNull())
    )
    level = F.when(F.col("_gid") == 3, "all").when(F.col("_gid") == 1, "prompt_group").otherwise("negative_phrase")
    rates = with_rates(cells)
    return rates.select(
        level.alias("level"),
        F.coalesce("_group", "_phrase", F.lit("")).alias("value"),
        "n",
        *COUNTS,
        *RATES,
    )


def prompt_cells(df: DataFrame, label: str, decision: str, group: str, positives: dict[str, str], negative: str) -> DataFrame:
    """Recall of each positive prompt group and FPR of the negative one."""
    hit = F.coalesce(F.col(decision), F.lit(False))

    def share(condition: Column) -> Column:
        return ratio(count_if(condition & hit), count_if(condition))

    cells = [
        share((F.col(group) == value) & (F.col(label) == 1)).alias(f"{name}_recall")
        for name, value in positives.items()
    ]
    cells.append(share((F.col(group) == negative) & (F.col(label) == 0)).alias("P4_false_positive_rate"))
    return df.agg(*cells)


def macro(df: DataFrame, keys: Sequence[str], unit: str, label: str, decision: Column) -> DataFrame:
    """Mean over units of each unit's rates; null rates are left out."""
    per_unit = confusion(df, [*keys, unit], label, decision)
    return per_unit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("participants"),
        *[F.avg(r).alias(f"macro_{r}") for r in ("precision", "recall", "false_positive_rate", "f1")],
    )


def ordered_statistics(
    df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column], bucket: Column | None = None
) -> DataFrame:
    """Exact order statistics per key without gathering a group.

    ``positions`` maps an output to a 0-based rank as an expression of ``n``.
    """
    keys = list(keys)
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    walked = running(
        histogram,
        keys,
        [F.col("_v").asc()],
        score_step(F.col("_v"), 16) if bucket is None else bucket,
        {"_upto": ("sum", F.col("_c"))},
        totals_as="_all",
    )
    return walked.withColumnRenamed("_all_upto", "n").groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("_upto") > pos, F.col("_v"))).alias(name) for name, pos in positions.items()],
    )


def upper_median() -> Column:
    return F.floor(F.col("n") / 2)


def nearest_rank(q: float) -> Column:
    """Element at round((n-1)q), rounding half to even."""
    return F.bround((F.col("n") - 1) * F.lit(q), 0)


def paired_delta(df: DataFrame, keys: Sequence[str], unit: str, label: str, base: Column, adapted: Column, eps: float = 1e-12) -> DataFrame:
    """Per-unit F1 change between two decisions, summarised over units.

    The per-unit table is read by the moments and by the median, so it is
    written once.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, unit).agg(
        *count_aggs(F.col(label), base, "a_"), *count_aggs(F.col(label), adapted, "b_")
    )
    change = rate_exprs("b_")["f1"] - rate_exprs("a_")["f1"]
    deltas = cut(counts.select(*keys, unit, change.alias("delta")).where(F.col("delta").isNotNull()))
    summary = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("delta").alias("mean_delta_f1"),
        count_if(F.col("delta") > eps).alias("improved"),
        count_if(F.col("delta") < -eps).alias("degraded"),
        count_if(F.abs("delta") <= eps).alias("unchanged"),
    )
    median = ordered_statistics(deltas, keys, "delta", {"median_delta_f1": upper_median()}).drop("n")
    return summary.join(median, keys) if keys else summary.crossJoin(F.broadcast(median))


def mean_std(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation; one value deviates by 0, none gives null."""
    aggs = []
    for v in values:
        spread = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))
        aggs += [F.avg(v).alias(f"{v}_mean"), spread.alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*aggs)


def pooled_and_macro(df: DataFrame, keys: Sequence[str], unit: str, label: str, decision: Column) -> DataFrame:
    """Pooled and macro rates per key from one pre-aggregate by unit."""
    per_unit = confusion(df, [*keys, unit], label, decision)
    both = per_unit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("participants"),
        *[F.avg(r).alias(f"macro_{r}") for r in ("precision", "recall", "false_positive_rate", "f1")],
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    return with_rates(both, only=("precision", "recall", "false_positive_rate", "f1"))


def latency_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, p90, p95 and deviation with exact order statistics."""
    keys = list(keys)
    n = F.col("n")
    stats = ordered_statistics(
        df,
        keys,
        value,
        {
            "_lower": F.floor((n - 1) / 2),
            "_upper": F.floor(n / 2),
            "p90": nearest_rank(0.90),
            "p95": nearest_rank(0.95),
        },
    )
    spread = F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0))
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean"), spread.alias("std"), F.max(value).alias("max"))
    joined = stats.join(moments, keys) if keys else stats.crossJoin(F.broadcast(moments))
    median = (F.col("_lower") + F.col("_upper")) / 2.0
    return joined.select(*keys, "n", "mean", median.alias("median"), "p90", "p95", "max", "std")


def approximate_latency(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """One-shuffle alternative to ``latency_summary`` with bounded rank error."""
    cut = F.percentile_approx(value, [0.5, 0.9, 0.95], accuracy)
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), cut.alias("_q"))
    return out.select(*keys, "n", "mean", *[F.col("_q")[i].alias(q) for i, q in enumerate(("median", "p90", "p95"))])


def rates_per_hour(df: DataFrame, keys: Sequence[str], *, seconds: str, windows: str, candidates: str, accepted: Column) -> DataFrame:
    """Long-speech stress summary; rates are null where no audio was seen."""
    sums = df.rollup(*keys).agg(
        F.count(F.lit(1)).alias("utterances"),
        F.sum(seconds).alias("_seconds"),
        F.sum(windows).alias("total_windows"),
        F.sum(candidates).alias("stage1_candidates"),
        count_if(accepted).alias("final_false_accepts"),
    )
    hours = F.col("_seconds") / 3600.0
    return sums.select(
        *keys,
        "utterances",
        hours.alias("total_audio_hours"),
        "total_windows",
        "stage1_candidates",
        "final_false_accepts",
        ratio(F.col("stage1_candidates"), hours).alias("candidates_per_hour"),
        ratio(F.col("final_false_accepts"), hours).alias("false_accepts_per_hour"),
        ratio(F.col("stage1_candidates"), F.col("total_windows")).alias("candidate_rate"),
    )


STAGE_ERRORS = ("STAGE1_MISS", "STAGE2_REJECT", "FINAL_FALSE_ACCEPT", "STAGE1_FALSE_CANDIDATE")


def stage_error(label: Column, candidate: Column, final: Column) -> Column:
    miss, reject, accept, spared = STAGE_ERRORS
    return (
        F.when((label == 1) & final, None)
        .when((label == 1) & ~candidate, miss)
        .when(label == 1, reject)
        .when(final, accept)
        .when(candidate, spared)
    )


def stage_error_counts(df: DataFrame, error: str, group: str, unit: str) -> DataFrame:
    """Error counts by class, (class, group) and (class, unit) in one pass."""
    errors = df.where(F.col(error).isNotNull()).select(error, group, unit)
    cells = errors.groupingSets([[error], [error, group], [error, unit]], error, group, unit).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n")
    )
    level = F.when(F.col("_gid") == 3, "class").when(F.col("_gid") == 1, "class_group").otherwise("class_unit")
    return cells.select(
        level.alias("level"),
        F.col(error).alias("error_type"),
        F.coalesce(F.col(group).cast("string"), F.col(unit).cast("string"), F.lit("")).alias("value"),
        "n",
    )


def false_reject_share(df: DataFrame, error: str) -> DataFrame:
    """Share of missed positives lost at each stage."""
    one, two = count_if(F.col(error) == "STAGE1_MISS"), count_if(F.col(error) == "STAGE2_REJECT")
    return df.agg(
        one.alias("stage1_misses"),
        two.alias("stage2_rejects"),
        ratio(one, one + two).alias("stage1_share"),
        ratio(two, one + two).alias("stage2_share"),
    )
