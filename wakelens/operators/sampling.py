"""Stratified caps, support sets and subset selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..session import cut
from .ranking import first_rows, numbered


def stratum_allocation(counts: DataFrame, unit: str, prompt: str, phrase: str, cap: int) -> DataFrame:
    """Largest-remainder share of ``cap`` for each stratum of a unit.

    ``counts`` has one row per (unit, prompt, phrase) with its size ``c``; the
    windows run over these pre-aggregated strata, never over clips.  Integer
    arithmetic throughout.
    """
    whole = Window.partitionBy(unit)
    total = F.sum("c").over(whole)
    c = F.col("c")
    base = counts.withColumn("_total", total).withColumns(
        {"_share": F.expr(f"({cap} * c) div _total"), "_rest": (cap * c) % F.col("_total")}
    )
    slack = F.lit(cap) - F.sum("_share").over(whole)
    place = F.row_number().over(Window.partitionBy(unit).orderBy((F.col("_share") > 0).asc(), prompt, phrase))
    base = base.withColumn("_slack", slack).withColumn("_empty", F.when(F.col("_share") == 0, place))
    lifted = F.when(F.col("_empty") <= F.col("_slack"), 1).otherwise(F.col("_share"))
    base = base.withColumn("_alloc", lifted)
    left = F.lit(cap) - F.sum("_alloc").over(whole)
    label = F.concat_ws("||", prompt, phrase)
    turn = Window.partitionBy(unit).orderBy(
        (F.col("_alloc") < c).desc(), F.col("_rest").desc(), c.desc(), label.desc()
    )
    base = base.withColumns({"_left": left, "_turn": F.row_number().over(turn)})
    extra = ((F.col("_alloc") < c) & (F.col("_turn") <= F.col("_left"))).cast("int")
    quota = F.when(F.col("_total") <= cap, c).otherwise(F.col("_alloc") + extra)
    return base.select(unit, prompt, phrase, "c", quota.cast("long").alias("quota"))


def stratified_cap(clips: DataFrame, unit: str, prompt: str, phrase: str, clip: str, *, cap: int = 100, seed: int = 20260620) -> DataFrame:
    """At most ``cap`` clips per unit, spread over (prompt, phrase) strata.

    Every quota is at most ``cap``, so each stratum is first cut to its
    ``cap`` best hash keys (limited before the shuffle) and then to its quota.
    Units within the cap keep everything through a plain join.
    """
    strata = [unit, prompt, phrase]
    counts = clips.groupBy(*strata).agg(F.count(F.lit(1)).alias("c"))
    quotas = stratum_allocation(counts, unit, prompt, phrase, cap)
    # As bytes the hash sorts as in hex and takes half the room.
    key = F.unhex(order_key(seed, F.col(unit), F.col(prompt), F.col(phrase), F.col(clip)))
    best = first_rows(clips.withColumn("_key", key), strata, [F.col("_key"), F.col(clip)], cap, "_rank")
    joined = best.join(quotas.select(*strata, "quota"), strata)
    return joined.where(F.col("_rank") <= F.col("quota")).drop("_key", "_rank", "quota")


def cap_report(before: DataFrame, after: DataFrame, unit: str) -> DataFrame:
    a = before.groupBy(unit).agg(F.count(F.lit(1)).alias("clips_before"))
    b = after.groupBy(unit).agg(
        F.count(F.lit(1)).alias("clips_after"),
        F.count_if(F.col("label") == 1).alias("positive_after"),
        F.count_if(F.col("label") == 0).alias("negative_after"),
    )
    out = a.join(b, unit, "left").na.fill(0)
    return out.withColumn("clips_removed", F.col("clips_before") - F.col("clips_after"))


def support_ranking(clips: DataFrame, target: str, seeds: Sequence[int], depth: int, *, prompt: str = "prompt_group", clip: str = "clip_id") -> DataFrame:
    """The ``depth`` support positives of every (target, seed), in order.

    One clip of each positive prompt group comes first (in group order), the
    rest follow in hash order.  Both ranks are limited before their shuffle.
    """
    positives = clips.where(F.col("label") == 1).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    key = order_key(F.col("seed"), F.col(target), F.col(prompt), F.col(clip))
    keyed = positives.withColumn("_key", key)
    lead = first_rows(keyed, [target, "seed", prompt], [F.col("_key"), F.col(clip)], depth, "_in_prompt")
    cover = F.when(F.col("_in_prompt") == 1, 0).otherwise(1)
    order = [cover.asc(), F.when(cover == 0, F.col(prompt)).asc(), F.col("_key").asc(), F.col(clip).asc()]
    return first_rows(lead, [target, "seed"], order, depth, "support_rank").drop("_in_prompt", "_key")


def eligibility(clips: DataFrame, target: str, shots: Sequence[int]) -> DataFrame:
    """Per target and shot: positives >= shots + 1 and at least one negative."""
    counts = clips.groupBy(target).agg(
        F.count_if(F.col("label") == 1).alias("positive_clips"), F.count_if(F.col("label") == 0).alias("negative_clips")
    )
    each = counts.withColumn("shot", F.explode(F.array(*[F.lit(s) for s in shots])))
    ok = (F.col("positive_clips") >= F.col("shot") + 1) & (F.col("negative_clips") >= 1)
    return each.withColumns({"eligible": ok, "stable_fpr": F.col("negative_clips") >= 5})


def smoke_subset(rows: DataFrame, speaker: str, duration: str, key: str, *, count: int, seed: int = 20260620) -> DataFrame:
    """The median-duration row of each speaker, filled from interleaved bins.

    The middle row is found through per-bucket running counts; the fill takes
    round-robin from three duration-interleaved bins in hash order.  The rows
    are read several times, so they are written once.
    """
    rows = cut(rows)
    step = F.floor(F.col(duration) * 4)
    order = [F.col(duration).asc(), F.col(key).asc()]
    ranked = numbered(rows, [speaker], order, step, "_rank")
    sizes = rows.groupBy(speaker).agg(F.count(F.lit(1)).alias("_n"))
    middle = ranked.join(sizes, speaker).where(F.col("_rank") == F.floor(F.col("_n") / 2) + 1)
    speakers = middle.withColumn("_key", order_key(seed, F.col(speaker)))
    lead = speakers.orderBy("_key", speaker).limit(count).select(*rows.columns, F.lit(0).alias("_fill"), F.lit(0).cast("long").alias("_turn"), F.lit(0).cast("long").alias("_bin"))
    rest = rows.join(lead.select(key), key, "left_anti")
    placed = numbered(rest, [], order, step, "_pos").withColumn("_bin", (F.col("_pos") - 1) % 3)
    hashed = placed.withColumn("_key", order_key(seed, F.col(key)))
    turns = first_rows(hashed, ["_bin"], [F.col("_key"), F.col(key)], count, "_turn")
    fill = turns.select(*rows.columns, F.lit(1).alias("_fill"), F.col("_turn").cast("long").alias("_turn"), "_bin")
    both = lead.unionByName(fill).orderBy("_fill", "_turn", "_bin", key).limit(count)
    return both.drop("_fill", "_turn", "_bin")


def systematic_sample(rows: DataFrame, group: str, clip: str, order: Sequence[str], quotas: dict[str, int], bucket: Column, *, total: int) -> DataFrame:
    """Every (n div quota)-th row per group up to its quota, then fill up."""
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(group))
    listed = rows.where(F.col(group).isin(*quotas))
    sizes = listed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(listed, [group], [F.col(c).asc() for c in order], bucket, "_rank").join(sizes, group)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / quota))
    picked = ranked.where((F.col("_rank") - 1) % step == 0)
    firsts = picked.groupBy(group, clip).agg(F.min("_rank").alias("_rank"))
    chosen = first_rows(firsts, [group], [F.col("_rank").asc()], max(quotas.values()), "_turn").where(F.col("_turn") <= quota)
    names = F.array(*[F.lit(g) for g in quotas])
    lead = chosen.select(clip, group, F.lit(0).alias("_fill"), F.array_position(names, F.col(group)).alias("_g"), F.col("_rank").alias("_r"))
    others = rows.groupBy(clip).agg(F.min_by(group, F.struct(*order)).alias(group)).join(chosen.select(clip), clip, "left_anti")
    extra = others.orderBy(clip).limit(total).select(clip, group, F.lit(1).alias("_fill"), F.lit(0).cast("long").alias("_g"), F.lit(0).cast("long").alias("_r"))
    both = lead.unionByName(extra).orderBy("_fill", "_g", "_r", clip).limit(total)
    return both.select(clip, group, (F.col("_fill") == 0).alias("by_quota"))


