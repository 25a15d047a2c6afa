"""Quality flags and review status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from .labels import PromptGroups

# Flags that reject a clip outright.
HARD_FLAGS = ("empty_audio", "duration_less_than_0_3_sec", "ffmpeg_conversion_failed")

REJECTED, FLAGGED, ACCEPTED = "auto_rejected", "flagged_for_review", "auto_accepted"


def flags_from_json(value: Column) -> Column:
    """Stored flag list; text that is no JSON is itself the one flag."""
    parsed = F.try_parse_json(value)
    none = F.array().cast("array<string>")
    listed = F.from_json(value, "array<string>")
    return (
        F.when(F.coalesce(value, F.lit("")) == "", none)
        .when(parsed.isNull(), F.array(value))
        .otherwise(F.coalesce(F.when(F.trim(value).startswith("["), listed), none))
    )


def effective_flags(stored: Column, transcript: Column, group: Column, path: Column, keyword: str, groups: PromptGroups) -> Column:
    """Stored flags plus the derived ones, sorted."""
    has = tx.has_keyword(transcript, keyword)
    derived = F.array_compact(
        F.array(
            F.when(F.coalesce(transcript, F.lit("")) == "", "missing_transcript"),
            F.when(group.isin(groups.before, groups.after) & ~has, "transcript_missing_keyword"),
            F.when((group == groups.negative) & has, "negative_transcript_contains_keyword"),
            F.when(F.coalesce(path, F.lit("")) == "", "missing_audio_file"),
        )
    )
    return F.array_sort(F.array_union(flags_from_json(stored), derived))


def effective_status(stored_status: Column, flags: Column) -> Column:
    flagged = (F.size(flags) > 0) | (stored_status == FLAGGED)
    return F.when(stored_status == REJECTED, REJECTED).when(flagged, FLAGGED).otherwise(ACCEPTED)


def expected_bounds(clip_type: Column, mode: Column, repetitions: Column) -> tuple[Column, Column]:
    times = F.greatest(repetitions, F.lit(1))
    low = F.when(clip_type == "calibration", 1.0).when(mode == "repeat", times * 0.35).otherwise(0.35)
    high = F.when(clip_type == "calibration", 12.0).when(mode == "repeat", times * 2.8).otherwise(8.0)
    return low, high


def audio_flags(duration: Column, samples: Column, rms: Column, clipped: Column, low: Column, high: Column) -> Column:
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(duration < 0.3, "duration_less_than_0_3_sec"),
                F.when(duration < low, "duration_much_shorter_than_expected"),
                F.when(duration > high, "duration_much_longer_than_expected"),
                F.when(samples == 0, "empty_audio"),
                F.when((samples > 0) & (rms < 0.01), "very_low_volume"),
                F.when((samples > 0) & (clipped > 0.01), "severe_clipping"),
            )
        )
    )


def audio_status(flags: Column) -> Column:
    hard = F.array(*[F.lit(f) for f in HARD_FLAGS])
    return F.when(F.arrays_overlap(flags, hard), REJECTED).when(F.size(flags) > 0, FLAGGED).otherwise(ACCEPTED)
