"""Lexicographic choice of models, configurations and recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import lex


def _worth(name: str, missing: float) -> Column:
    """Null counts as the worst value; a perfect 0.0 rate stays 0.0."""
    return F.coalesce(F.col(name), F.lit(missing))


def choose_variant(
    metrics: DataFrame,
    keys: Sequence[str],
    *,
    recall_target: float = 0.90,
    fpr: str = "false_positive_rate",
    latency: str | None = None,
) -> DataFrame:
    """Best row per key: recall target first, then FPR, precision, F1, latency.

    Where no row meets the target the highest recall comes first instead.
    """
    recall = _worth("recall", -1.0)
    meets = recall >= recall_target
    slow = _worth(latency, 0.0) if latency else F.lit(0.0)
    tail = [-_worth(fpr, 1.0), _worth("precision", -1.0), _worth("f1", -1.0), -slow]
    rank = F.when(meets, lex(F.lit(1), F.lit(0.0), *tail)).otherwise(lex(F.lit(0), recall, *tail))
    rest = [c for c in metrics.columns if c not in keys]
    marked = metrics.withColumn("meets_recall", meets)
    out = marked.groupBy(*keys).agg(F.max_by(F.struct(*rest, "meets_recall"), rank).alias("_best"))
    return out.select(*keys, "_best.*")


def choose_safe_recipe(candidates: DataFrame, recipe: str, passed: str, recall: str, f1: str, latency: str, fallback: str, keys: tuple = ()) -> DataFrame:
    """Best passing recipe, else the named fallback; one row for each of ``keys``, and always one without keys."""
    rank = lex(_worth(recall, 0.0), _worth(f1, 0.0), -_worth(latency, 0.0), F.col(recipe))
    best = F.max_by(F.when(F.col(passed), F.col(recipe)), F.when(F.col(passed), rank))
    return candidates.groupBy(*keys).agg(
        F.coalesce(best, F.lit(fallback)).alias("selected_recipe"),
        F.when(best.isNull(), "no_safe_candidate").otherwise("best_safe_candidate").alias("reason"),
    )
