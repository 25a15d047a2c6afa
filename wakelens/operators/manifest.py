"""Manifest checks: duplicates, leakage, consistency, counters, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import numbered


def duplicate_groups(clips: DataFrame, content: str, unit: str, clip: str = "clip_id") -> DataFrame:
    """Contents held by more than one clip row.

    Counted over (content, unit) first, so a content that fills a third of the
    table still arrives pre-aggregated.  Members are listed by
    ``duplicate_members``, one row each, not as an array.
    """
    per_unit = clips.where(F.col(content).isNotNull()).groupBy(content, unit).agg(
        F.count(F.lit(1)).alias("_n"), F.min(clip).alias("_first")
    )
    return (
        per_unit.groupBy(content)
        .agg(
            F.sum("_n").alias("clip_count"),
            F.count(F.lit(1)).alias("participant_count"),
            F.min("_first").alias("first_clip"),
        )
        .where(F.col("clip_count") > 1)
        .withColumn("cross_participant", F.col("participant_count") > 1)
    )


def duplicate_members(clips: DataFrame, content: str, unit: str, clip: str = "clip_id") -> DataFrame:
    groups = duplicate_groups(clips, content, unit, clip)
    return clips.select(clip, unit, content).join(groups, content)


def drop_duplicates_by_policy(clips: DataFrame, content: str, unit: str, clip: str = "clip_id") -> DataFrame:
    """Drop contents shared across units whole; within one keep the first clip."""
    groups = duplicate_groups(clips, content, unit, clip).select(content, "first_clip", "cross_participant")
    joined = clips.join(groups, content, "left")
    single = F.col("first_clip").isNull()
    kept = ~F.col("cross_participant") & (F.col(clip) == F.col("first_clip"))
    return joined.where(single | kept).drop("first_clip", "cross_participant")


def leakage(rows: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Key values seen in more than one split, for all keys in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    long = rows.select(F.inline(pairs), split).where(F.coalesce("value", F.lit("")) != "")
    found = long.groupBy("key", "value").agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def leakage_summary(rows: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Leaked values per key; a clean key is listed with zero.

    A value is leaked if its least and greatest split differ.  For numbered
    splits that is a hash aggregate; sets of splits would be sorted and spilled.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)])
    long = rows.select(F.inline(pairs), split).where(F.coalesce("value", F.lit("")) != "")
    found = long.groupBy("_key", "value").agg(F.min(split).alias("_least"), F.max(split).alias("_most")).where("_least <> _most")
    counts = found.groupBy("_key").agg(F.count(F.lit(1)).alias("leaked_values"))
    names = rows.sparkSession.createDataFrame(list(enumerate(keys)), "_key int, key string")
    out = names.join(counts, "_key", "left").withColumn("leaked_values", F.coalesce("leaked_values", F.lit(0).cast("long"))).drop("_key")
    return out.withColumn("no_leakage", F.col("leaked_values") == 0)


def clip_consistency(rows: DataFrame, fields: Sequence[str], clip: str = "clip_id") -> DataFrame:
    """Clips whose windows disagree on a field."""

    def differs(f: str):
        value = F.coalesce(F.col(f).cast("string"), F.lit(""))
        return (F.min(value) != F.max(value)).alias(f"inconsistent_{f}")

    checked = rows.groupBy(clip).agg(*[differs(f) for f in fields])
    bad = [F.col(f"inconsistent_{f}") for f in fields]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    return checked.where(any_bad)


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def same_rows(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Multiset difference of two tables as one signed count per row."""
    tagged = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    return tagged.groupBy(*cols).agg(F.sum("_s").alias("surplus")).where(F.col("surplus") != 0)


def split_counters(windows: DataFrame, *, split: str, speaker: str, session: str, content: str, groups: dict[str, str]) -> DataFrame:
    """Dataset counters per split at window and clip level.

    Distinct counts are taken from (split, value) pre-aggregates.
    """

    def distinct(name: str, column: str) -> DataFrame:
        pairs = windows.where(F.col(column).isNotNull()).select(split, column).distinct()
        return pairs.groupBy(split).agg(F.count(F.lit(1)).alias(name))

    clips = windows.groupBy(split, "clip_id").agg(
        F.min_by(F.struct("label", "prompt_group"), F.col("window_index")).alias("_c"), F.count(F.lit(1)).alias("_w")
    )
    per_clip = clips.groupBy(split).agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum("_w").alias("windows"),
        F.count_if(F.col("_c.label") == 1).alias("positive_clips"),
        F.count_if(F.col("_c.label") == 0).alias("negative_clips"),
        *[F.count_if(F.col("_c.prompt_group") == g).alias(f"{n}_clips") for n, g in groups.items()],
    )
    per_window = windows.groupBy(split).agg(
        F.count_if(F.col("label") == 1).alias("positive_windows"),
        F.count_if(F.col("label") == 0).alias("negative_windows"),
        *[F.count_if(F.col("prompt_group") == g).alias(f"{n}_windows") for n, g in groups.items()],
    )
    held = windows.where(F.col(content).isNotNull()).select(split, content, "clip_id").distinct()
    shared = held.groupBy(split, content).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    duplicates = shared.groupBy(split).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.sum("_n").alias("duplicate_clips")
    )
    out = per_clip.join(per_window, split)
    for part in (distinct("speakers", speaker), distinct("sessions", session), duplicates):
        out = out.join(part, split, "left")
    return out.na.fill(0)


def participant_statistics(clips: DataFrame, unit: str, *, content: str, session: str, groups: dict[str, str], windows: str | None = None) -> DataFrame:
    """Per-participant measures; only what they are made of is written once.

    Measures add up per participant before the shuffle.  Contents and sessions
    are told apart as bare (participant, value) pairs, which carry no measures,
    so a participant with many clips still spreads over tasks.
    """
    one = F.col(windows) if windows else F.lit(1)
    invalid = F.col("clip_id").isNull() | F.col(unit).isNull() | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    invalid = invalid | (F.coalesce("prompt_group", F.lit("")) == "")
    used = ["label", "prompt_group", F.coalesce("duration_sec", F.lit(0.0)).alias("_d"), one.alias("_w"), invalid.alias("_bad")]
    rows = cut(clips.select(F.col(unit), F.col(content).alias("_content"), F.col(session).alias("_session"), *used))
    out = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("total_unique_clips"),
        F.sum("_w").cast("long").alias("total_windows"),
        F.count_if(F.col("label") == 1).alias("positive_clips"),
        F.count_if(F.col("label") == 0).alias("negative_clips"),
        *[F.count_if(F.col("prompt_group") == g).alias(f"{n}_clips") for n, g in groups.items()],
        F.round(F.sum("_d"), 3).alias("audio_duration_sec"),
        F.count_if("_bad").alias("invalid_metadata"),
    )
    contents = rows.select(unit, "_content").distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("_contents"))
    sessions = rows.select(unit, "_session").distinct().groupBy(unit).agg(F.count("_session").alias("sessions"))
    pos, neg = F.col("positive_clips"), F.col("negative_clips")
    return out.join(contents, unit).join(sessions, unit).select(
        *out.columns[:-1],
        (F.col("total_unique_clips") - F.col("_contents")).alias("duplicate_hash_count"),
        "invalid_metadata",
        "sessions",
        ((pos >= 4) & (neg >= 1)).alias("eligible_3_shot"),
        ((pos >= 6) & (neg >= 1)).alias("eligible_5_shot"),
        ((pos >= 1) & (neg >= 1)).alias("both_query_kinds"),
    )


def phrase_counts(clips: DataFrame, unit: str, group: str, negative: str, phrase: str) -> DataFrame:
    """Hard-negative phrase counters in long form."""
    rows = clips.where(F.col(group) == negative)
    return rows.groupBy(unit, phrase).agg(F.count(F.lit(1)).alias("n"))


def alias_map(rows: DataFrame, speaker: str, prefix_length: int = 6, pattern: str = "P%03d") -> DataFrame:
    """Aliases by sorted distinct speaker id.

    A string prefix is monotone in string order, so it serves as the bucket
    and no task has to rank all speakers.
    """
    distinct = rows.where(F.col(speaker).isNotNull()).select(speaker).distinct()
    ranked = numbered(distinct, [], [F.col(speaker).asc()], F.substring(speaker, 1, prefix_length), "_rank")
    return ranked.select(speaker, F.format_string(pattern, F.col("_rank")).alias("participant_alias"))


def next_ids(existing: DataFrame, column: str, new_rows: DataFrame, order: Sequence, bucket, prefix: str, width: int) -> DataFrame:
    """Sequential prefixed ids for a batch, after the highest stored number."""
    suffix = F.substring(column, len(prefix) + 1, 1_000_000)
    number = F.when(F.col(column).startswith(prefix) & suffix.rlike(r"^\d+$"), F.try_to_number(suffix, F.lit("9" * 18)))
    top = existing.agg(F.max(number).cast("long").alias("_m"), F.count(F.lit(1)).alias("_n"))
    start = top.select(F.when(F.coalesce("_m", F.lit(0)) > 0, F.col("_m")).otherwise(F.col("_n")).alias("_start"))
    ranked = numbered(new_rows, [], order, bucket, "_rank").crossJoin(F.broadcast(start))
    text = (F.col("_start") + F.col("_rank")).cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return ranked.withColumn("new_id", F.concat(F.lit(prefix), padded)).drop("_rank", "_start")


def fingerprint(rows: DataFrame, config_json: str) -> DataFrame:
    """Order-free digest of a multiset of rows, its row count, and the digest of both with the config.

    A row's canonical form holds every value with its length, so no two rows share
    one; the first 60 bits of its SHA-256 enter a sum and an exclusive or.
    """
    shown = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in rows.columns]
    hashed = rows.select(F.conv(F.substring(F.sha2(F.concat_ws(",", *shown), 256), 1, 15), 16, 10).cast("long").alias("_h"))
    agg = hashed.agg(F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("mixed"), F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"), F.count(F.lit(1)).alias("rows"))
    return agg.select("rows", F.sha2(F.concat_ws("|", "mixed", "total", "rows", F.lit(config_json)), 256).alias("fingerprint"))


def counts_agree(expected: DataFrame, actual: DataFrame, key: str, within: int) -> DataFrame:
    both = expected.select(key, F.col("n").alias("expected")).join(actual.select(key, F.col("n").alias("actual")), key, "full")
    gap = F.abs(F.coalesce("expected", F.lit(0)) - F.coalesce("actual", F.lit(0)))
    return both.withColumn("agrees", gap <= within)


def role_overlap(rows: DataFrame, key: str, role: str) -> DataFrame:
    """Keys present in more than one role; roles are few, so the set is small."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles"))
    return found.where(F.size("roles") > 1)


def id_set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of intersection and differences of two id sets, and equality."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, key, "full")
    out = both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"),
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
    )
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


