"""Fold assignment, nested plans and role-separated access."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, order_key
from ..session import cut
from .ranking import numbered, running

# Ship the task functions inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a balanced fold is measured by, and how much each counts.
WEIGHTS = {
    "participants": 5.0,
    "clips": 3.0,
    "positive": 2.0,
    "negative": 2.0,
    "P1": 1.0,
    "P2": 1.0,
    "P3": 1.0,
    "P4": 1.0,
}


def participant_vectors(clips: DataFrame, unit: str, groups: dict[str, str]) -> DataFrame:
    """Eight counts per participant."""
    return clips.groupBy(unit).agg(
        F.lit(1).cast("long").alias("participants"),
        F.count(F.lit(1)).alias("clips"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
        *[F.count_if(F.col("prompt_group") == g).alias(n) for n, g in groups.items()],
    )


def fold_statistics(placed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return placed.groupBy(*keys, "fold").agg(*[F.sum(m).cast("long").alias(m) for m in WEIGHTS])


def fold_objective(stats: DataFrame, fold_count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted squared relative deviation of the folds from their mean.

    With the mean over ``fold_count`` folds the inner sum is
    ``fold_count * (fold_count * sum(v^2) / sum(v)^2 - 1)``, so a fold without
    rows counts as zero and one aggregate suffices.
    """
    terms = None
    for measure, weight in WEIGHTS.items():
        v = F.col(measure).cast("double")
        total = F.sum(v)
        spread = fold_count * (fold_count * F.sum(v * v) / (total * total) - 1.0)
        term = F.when(total == 0, 0.0).otherwise(weight * spread)
        terms = term if terms is None else terms + term
    return stats.groupBy(*keys).agg(terms.alias("objective"))


def _snake(rank: Column, folds: int) -> Column:
    turn, place = F.floor((rank - 1) / folds), (rank - 1) % folds
    return F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("int")


def _by_size(vectors: DataFrame, unit: str, seed: int) -> DataFrame:
    """Rank from the largest participant; equal ones in hash order."""
    keyed = vectors.withColumn("_key", order_key(seed, F.col(unit)))
    order = [F.col("clips").desc(), F.col("positive").desc(), F.col("_key"), F.col(unit)]
    bucket = F.struct(-F.col("clips"), -F.col("positive"), hash_bucket(F.col("_key"), 1))
    return numbered(keyed, [], order, bucket, "size_rank").drop("_key")


def serpentine_folds(vectors: DataFrame, unit: str, folds: int = 5, seed: int = 20260620) -> DataFrame:
    """Snake through the participants by size: one distributed ranking."""
    ranked = _by_size(vectors, unit, seed)
    return ranked.withColumn("fold", _snake(F.col("size_rank"), folds)).drop("size_rank")


# Participants of one size that a task ranks together, and rows of all starts a task ranks.
_TOGETHER = 50_000
_TASK_ROWS = 500_000


def _snakes(vectors: DataFrame, unit: str, starts: Sequence[int], folds: int, seed: int) -> DataFrame:
    """Folds of every participant in every start.

    Only the order within a size differs between starts, so participants are
    dealt by size once and multiplied by the starts behind the shuffle.  A size
    with too many participants for a task is dealt by start and hash bucket, and
    what its earlier buckets hold comes from a table of counts.
    """
    size, everyone = ["clips", "positive"], F.array(*[F.lit(s) for s in starts])
    counts = vectors.groupBy(*size).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col("clips").desc(), F.col("positive").desc()]
    counts = running(counts, [], order, F.col("clips"), {"_before": ("sum", F.col("_n"))}, descending=True, inclusive=False)
    alone = F.transform(everyone, lambda s: F.struct(s.alias("_start"), hash_bucket(order_key(seed, s, F.col(unit))).alias("_part")))
    together = F.array(F.struct(F.lit(None).cast("int").alias("_start"), F.lit(-1).alias("_part")))
    split = F.col("_n") > _TOGETHER
    sized = vectors.join(F.broadcast(counts), size)  # d sizes need some d ** 1.5 clips: far fewer than participants
    parts = sized.where(split).select(*size, F.inline(alone)).groupBy("_start", *size, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_start", *size).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_start").alias("start"), *size, "_part", F.sum("_n").over(earlier).alias("_earlier"))
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() * len(starts) // _TASK_ROWS))
    dealt = sized.select(unit, *WEIGHTS, "_before", F.inline(F.when(split, alone).otherwise(together))).repartition(tasks, *size, "_part")
    tries = dealt.withColumn("start", F.explode(F.when(F.col("_start").isNull(), everyone).otherwise(F.array("_start")))).drop("_start")
    tries = tries.join(F.broadcast(parts), ["start", *size, "_part"], "left")
    within = F.row_number().over(Window.partitionBy("start", *size, "_part").orderBy(order_key(seed, F.col("start"), F.col(unit)), unit))
    rank = F.col("_before") + F.coalesce("_earlier", F.lit(0)) + within
    return tries.select("start", unit, *WEIGHTS, _snake(rank, folds).alias("fold"))


def multistart_folds(vectors: DataFrame, unit: str, *, folds: int = 5, starts: int = 20, seed: int = 20260620) -> DataFrame:
    """Best of several seeded snakes over all participants.

    Every participant takes part in every start; starts differ in the order of
    participants of equal size.  Each start is scored from the sums of its folds;
    the least objective wins, then the first start, whose placements alone are
    made again.  ``vectors`` is read several times.
    """
    placed = _snakes(vectors, unit, range(starts), folds, seed)
    scored = fold_objective(fold_statistics(placed, ["start"]), folds, ["start"])
    best = scored.agg(F.min_by("start", F.struct(F.round("objective", 9), "start")).alias("start")).first()["start"]
    return _snakes(vectors, unit, [best or 0], folds, seed).select(unit, *WEIGHTS, "fold")


def _classes(vectors: DataFrame, folds: int) -> DataFrame:
    """Participants with equal counts as one row: ``every`` for each fold, ``rest`` to be placed."""
    size = F.count(F.lit(1))
    grouped = vectors.groupBy(*WEIGHTS).agg(F.floor(size / folds).alias("every"), (size % folds).alias("rest"))
    return grouped.withColumn("class", F.concat_ws("-", *WEIGHTS))


def _walk(costs: list[float], folds: int, placements: bool):
    """Place the rows of each start, which come in order, one after another.

    Holds the sums of one start's folds and nothing else.
    """
    names = list(WEIGHTS)

    def score(totals: list[list[int]]) -> float:
        means = [sum(t[m] for t in totals) / folds for m in range(len(names))]
        return sum(c * sum((t[m] - means[m]) ** 2 for t in totals) for m, c in enumerate(costs))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, totals = None, []
        for frame in frames:
            out = []
            for row in frame[["start", "class", "rest", *names]].itertuples(index=False):
                own, label, rest, values = row[0], row[1], row[2], row[3:]
                if own != start:
                    if start is not None and not placements:
                        out.append((start, score(totals)))
                    start, totals = own, [[0] * len(names) for _ in range(folds)]
                weighed = [c * v for c, v in zip(costs, values)]
                for copy in range(rest):
                    # The objective grows least where the weighed overlap with what is there is least.
                    overlap = [sum(w * v for w, v in zip(weighed, t)) for t in totals]
                    fold = min(range(folds), key=lambda f: (overlap[f], totals[f][0], f))
                    totals[fold] = [a + v for a, v in zip(totals[fold], values)]
                    if placements:
                        out.append((label, copy, fold))
            yield pd.DataFrame(out, columns=["class", "copy", "fold"] if placements else ["start", "objective"])
        if start is not None and not placements:
            yield pd.DataFrame([(start, score(totals))], columns=["start", "objective"])

    return task


def _costs(vectors: DataFrame, folds: int) -> list[float]:
    totals = vectors.agg(*[F.sum(m).alias(m) for m in WEIGHTS]).first()
    return [w * folds * folds / float(totals[m] * totals[m]) if totals[m] else 0.0 for m, w in WEIGHTS.items()]


def _tries(classes: DataFrame, starts: Column, seed: int) -> DataFrame:
    tries = classes.where("rest > 0").withColumn("start", F.explode(starts))
    placed = tries.withColumn("_key", order_key(seed, F.col("start"), F.col("class"))).repartition("start")
    return placed.sortWithinPartitions("start", F.desc("clips"), F.desc("positive"), "_key", "class").drop("_key")


def start_objectives(vectors: DataFrame, *, folds: int = 5, starts: int = 200, seed: int = 20260620, classes: DataFrame | None = None) -> DataFrame:
    """(start, objective) of seeded greedy placements.

    Participants come from the largest to the smallest, equal sizes in an order
    of the start's own, and each goes where the objective over all eight measures
    is least, then to the fold with fewest participants.  Deviations are taken
    from the means of the whole table.  Of n participants with equal counts every
    fold gets ``n // folds`` beforehand, so a start walks distinct count vectors
    and not participants.  Starts are independent tasks.  Classes without a rest
    place nothing; if all are, no start has a row.
    """
    classes = _classes(vectors, folds) if classes is None else classes
    tries = _tries(classes, F.sequence(F.lit(0), F.lit(starts - 1)), seed)
    return tries.mapInPandas(_walk(_costs(vectors, folds), folds, False), "start int, objective double")


def greedy_folds(vectors: DataFrame, unit: str, *, folds: int = 5, starts: int = 200, seed: int = 20260620) -> DataFrame:
    """Participants with the fold of the best greedy start (ties: the first).

    Only the objectives of the starts are kept; the best start is then walked
    again for its placements.  Within a class participants are dealt in hash
    order, ranked over hash buckets, so a large class spreads over tasks.
    """
    vectors = cut(vectors)
    classes = cut(_classes(vectors, folds))
    scored = start_objectives(vectors, folds=folds, starts=starts, seed=seed, classes=classes)
    best = scored.agg(F.min_by("start", F.struct(F.round("objective", 12), "start")).alias("start")).first()["start"]
    tries = _tries(classes, F.array(F.lit(best or 0)), seed)
    dealt = tries.mapInPandas(_walk(_costs(vectors, folds), folds, True), "class string, copy int, fold int")
    keyed = vectors.withColumn("class", F.concat_ws("-", *WEIGHTS)).withColumn("_key", order_key(seed, F.col(unit)))
    ranked = numbered(keyed, ["class"], [F.col("_key"), F.col(unit)], hash_bucket(F.col("_key"), 3), "_rank")
    place = ranked.join(classes.select("class", "every"), "class").withColumn("copy", (F.col("_rank") - 1 - folds * F.col("every")).cast("int"))
    joined = place.join(dealt.withColumnRenamed("fold", "_fold"), ["class", "copy"], "left")
    fold = F.when(F.col("copy") < 0, (F.col("_rank") - 1) % folds).otherwise(F.col("_fold")).cast("int")
    return joined.select(unit, *WEIGHTS, fold.alias("fold"))


def nested_plan(spark, folds: int = 5) -> DataFrame:
    """(outer, inner, fold, role): four inner plans for every outer fold."""
    ids = F.sequence(F.lit(0), F.lit(folds - 1))
    grid = spark.range(1).select(F.explode(ids).alias("outer"))
    grid = grid.withColumn("inner", F.explode(ids)).where(F.col("inner") != F.col("outer")).withColumn("fold", F.explode(ids))
    role = (
        F.when(F.col("fold") == F.col("outer"), "outer_test")
        .when(F.col("fold") == F.col("inner"), "inner_validation")
        .otherwise("inner_train")
    )
    return grid.withColumn("role", role)


def inner_coverage(plan: DataFrame) -> DataFrame:
    """How often each development fold is validated per outer fold (must be 1)."""
    dev = plan.where(F.col("role") != "outer_test")
    return dev.groupBy("outer", "fold").agg(
        F.count_if(F.col("role") == "inner_validation").alias("validated"),
        F.count_if(F.col("role") == "inner_train").alias("trained"),
    )


def single_validation_role(fold: Column, outer: Column) -> Column:
    """Outer fold tests, the first other fold validates, the rest train."""
    first = F.when(outer == 0, 1).otherwise(0)
    return F.when(fold == outer, "test").when(fold == first, "val").otherwise("train")


def leave_one_out_role(unit: Column, target: Column) -> Column:
    return F.when(unit == target, "test").otherwise("train")


class LeakageError(ValueError):
    """A role was read outside the context it belongs to."""


class RoleSeparated:
    """Rows of one outer fold, readable only by role and context.

    Reads are lazy filters on the fold column; each is logged as
    (context, role), and ``log`` can be counted in one job afterwards.
    """

    def __init__(self, rows: DataFrame, outer: int, folds: int = 5, fold: str = "fold"):
        self.rows, self.outer, self.folds, self.fold = rows, outer, folds, fold
        self.log: list[tuple[str, str, DataFrame]] = []

    def _read(self, context: str, needed: str, role: str, folds: Sequence[int]) -> DataFrame:
        if context != needed:
            raise LeakageError(f"{role} rows may only be read in the {needed} context")
        out = self.rows.where(F.col(self.fold).isin(*folds))
        self.log.append((context, role, out))
        return out

    def _others(self, *without: int) -> list[int]:
        return [f for f in range(self.folds) if f not in (self.outer, *without)]

    def inner_train(self, inner: int, context: str) -> DataFrame:
        self._inner(inner)
        return self._read(context, "inner_selection", "inner_train", self._others(inner))

    def inner_validation(self, inner: int, context: str) -> DataFrame:
        self._inner(inner)
        return self._read(context, "inner_selection", "inner_validation", [inner])

    def refit_train(self, context: str) -> DataFrame:
        return self._read(context, "refit", "refit_train", self._others())

    def outer_test(self, context: str) -> DataFrame:
        return self._read(context, "final_evaluation", "outer_test", [self.outer])

    def _inner(self, inner: int) -> None:
        if inner == self.outer:
            raise LeakageError("outer test fold used as inner validation")

    def access_counts(self, unit: str) -> DataFrame:
        parts = [
            df.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("participants")
            ).select(F.lit(i).alias("step"), F.lit(c).alias("context"), F.lit(r).alias("role"), "rows", "participants")
            for i, (c, r, df) in enumerate(self.log)
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
