"""Speaker-disjoint splits and duplicate reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, order_key
from .ranking import numbered

# Shares of the speakers.
TRAIN_SHARE, VAL_SHARE = 0.70, 0.15
PRIORITY = ("train", "val", "test")


def _ranked_by_hash(df: DataFrame, column: str, seed: int) -> DataFrame:
    keyed = df.withColumn("_key", order_key(seed, F.col(column)))
    return numbered(keyed, [], [F.col("_key"), F.col(column)], hash_bucket(F.col("_key")), "_rank").drop("_key")


def _speaker_roles(ranked: DataFrame, count: DataFrame) -> DataFrame:
    n, rank = F.col("_n"), F.col("_rank")
    train = F.greatest(F.lit(1), F.bround(n * TRAIN_SHARE, 0))
    val = F.greatest(F.lit(1), F.bround(n * VAL_SHARE, 0))
    val_end = F.when(train + val >= n, n - 1).otherwise(train + val)
    large = F.when(rank <= train, "train").when(rank <= val_end, "val").otherwise("test")
    some = F.when(rank == 1, "test").when(rank == 2, "val").otherwise("train")
    pair = F.when(rank == 1, "test").otherwise("train")
    role = F.when(n >= 5, large).when(n >= 3, some).when(n == 2, pair)
    return ranked.crossJoin(F.broadcast(count)).withColumn("split", role).drop("_rank", "_n")


def _clip_roles(clips: DataFrame, seed: int, smoke: bool) -> DataFrame:
    """A hash-ordered fifth of the clips for val, and for test in smoke mode."""
    ranked = _ranked_by_hash(clips, "clip_id", seed)
    sized = ranked.crossJoin(F.broadcast(clips.agg(F.count(F.lit(1)).alias("_n"))))
    fifth = F.greatest(F.lit(1), F.floor(F.col("_n") / 5))
    second = F.greatest(F.lit(2), F.floor(F.col("_n") * 2 / 5))
    role = F.when(F.col("_rank") <= fifth, "val")
    if smoke:
        role = role.when(F.col("_rank") <= second, "test")
    return sized.select("clip_id", role.otherwise("train").alias("_clip_split"))


def assign_splits(rows: DataFrame, speaker: str = "speaker", seed: int = 20260620) -> DataFrame:
    """Add ``split`` and ``split_mode``.

    Whether the clip-level rules of tiny data apply is decided from at most
    six speakers; with more, only the speakers are ranked.
    """
    speakers = rows.select(speaker).distinct()
    seen = speakers.limit(6).count()
    if seen <= 1:
        roles = _clip_roles(rows.select("clip_id").distinct(), seed, True)
        out = rows.join(roles, "clip_id").withColumnRenamed("_clip_split", "split")
        return out.withColumn("split_mode", F.lit("SMOKE_ONLY_NO_SPEAKER_GENERALIZATION"))
    count = speakers.agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.join(_speaker_roles(_ranked_by_hash(speakers, speaker, seed), count), speaker)
    mode = "speaker_disjoint_test_only" if seen == 2 else "speaker_disjoint"
    if seen in (2, 5):  # the validation speakers are used up
        train = placed.where(F.col("split") == "train").select("clip_id").distinct()
        val = _clip_roles(train, seed, False)
        placed = placed.join(val, "clip_id", "left")
        placed = placed.withColumn("split", F.coalesce("_clip_split", "split")).drop("_clip_split")
    return placed.withColumn("split_mode", F.lit(mode))


def _priority(split: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in PRIORITY]), split)


def reconcile_duplicates(rows: DataFrame, content: str, split: str = "split") -> DataFrame:
    """Move all rows of one content to the strictest split among them.

    The strictest split is pre-aggregated and joined back, so a popular content
    never gathers in one task.  Rows without a content get scattered keys that
    match nothing, so they do not meet in one partition either.
    """
    known = rows.where(F.col(content).isNotNull())
    target = known.groupBy(F.col(content).cast("string").alias("_k")).agg(F.max(_priority(F.col(split))).alias("_p"))
    scattered = F.concat(F.lit("no content "), (F.xxhash64(*rows.columns) % 4096).cast("string"))
    keyed = rows.withColumn("_k", F.coalesce(F.col(content).cast("string"), scattered))
    names = F.array(*[F.lit(s) for s in PRIORITY])
    settled = F.when(F.col("_p") > 0, F.element_at(names, F.col("_p").cast("int"))).otherwise(F.col(split))
    return keyed.join(target, "_k", "left").withColumn(split, settled).drop("_k", "_p")


def flag_conflicting(rows: DataFrame, speaker: str, split: str = "split") -> DataFrame:
    """Strict mode: after reconciliation flag rows outside their speaker's strictest split; none goes."""
    strictest = rows.groupBy(speaker).agg(F.max(_priority(F.col(split))).alias("_p"))
    return rows.join(strictest, speaker).withColumn("conflict", _priority(F.col(split)) < F.col("_p")).drop("_p")
