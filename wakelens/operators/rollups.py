"""Account, session and review rollups, exports and erasure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import LEGACY
from .ranking import numbered


def accounted(rows: DataFrame, participants: DataFrame, accounts: DataFrame, key: str = "participant_id") -> DataFrame:
    """Rows whose participant has an account; the others drop out."""
    owned = participants.join(accounts.select(F.col("email").alias("user_email")), "user_email", "left_semi")
    return rows.join(owned.select(key), key, "left_semi")


def admin_summary(accounts: DataFrame, participants: DataFrame, sessions: DataFrame, clips: DataFrame, segments: DataFrame) -> DataFrame:
    """All headline counts, each table scanned once."""
    held = accounted(sessions, participants, accounts)
    count = F.count(F.lit(1))
    per_session = held.agg(count.alias("sessions"), F.count_if(F.col("status") == "submitted").alias("submitted_sessions"))
    own = accounted(clips, participants, accounts)
    status = F.col("auto_qc_status")
    per_clip = own.agg(
        count.alias("total_clips"),
        F.count_if(F.col("label") == 1).alias("positive_clips"),
        F.count_if(F.col("label") == 0).alias("negative_clips"),
        F.count_if(status == "auto_accepted").alias("auto_accepted"),
        F.count_if(status == "flagged_for_review").alias("flagged"),
        F.count_if(status == "auto_rejected").alias("rejected"),
    )
    per_segment = accounted(segments, participants, accounts).agg(count.alias("total_segments"))
    out = accounts.agg(count.alias("participants"))
    for part in (per_session, per_clip, per_segment):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def group_counts(clips: DataFrame, participants: DataFrame, accounts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Clips per prompt group, zero-filled, empty groups folded into legacy."""
    own = accounted(clips, participants, accounts)
    folded = F.coalesce(F.nullif(F.col("prompt_group"), F.lit("")), F.lit(LEGACY))
    found = own.groupBy(folded.alias("prompt_group")).agg(F.count(F.lit(1)).alias("clips"))
    names = clips.sparkSession.createDataFrame([(g,) for g in (*groups, LEGACY)], "prompt_group string")
    out = names.join(found, "prompt_group", "full")
    return out.select("prompt_group", F.coalesce("clips", F.lit(0).cast("long")).alias("clips"))


def clip_cells(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    return clips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clip_count"),
        F.count_if(F.col("label") == 1).alias("positive_clip_count"),
        F.count_if(F.col("label") == 0).alias("negative_clip_count"),
    )


CELLS = ("clip_count", "positive_clip_count", "negative_clip_count")


def session_rollup(sessions: DataFrame, clips: DataFrame) -> DataFrame:
    """Every session with its clip counts; sessions without clips show zero."""
    out = sessions.join(clip_cells(clips, ["session_id"]), "session_id", "left")
    return out.na.fill(0, list(CELLS))


def account_rollup(accounts: DataFrame, participants: DataFrame, sessions: DataFrame, clips: DataFrame) -> DataFrame:
    """Every account with participants, sessions and clips, zeros kept.

    Counts fold upward: clips by session, sessions by participant,
    participants by account.
    """
    by_session = session_rollup(sessions, clips)
    by_participant = by_session.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_if(F.col("status") == "submitted").alias("submitted_session_count"),
        *[F.sum(c).alias(c) for c in CELLS],
    )
    by_account = (
        participants.where(F.col("user_email").isNotNull())
        .join(by_participant, "participant_id", "left")
        .groupBy(F.col("user_email").alias("email"))
        .agg(
            F.count(F.lit(1)).alias("participant_count"),
            *[F.sum(c).alias(c) for c in ("session_count", "submitted_session_count", *CELLS)],
        )
    )
    filled = ["participant_count", "session_count", "submitted_session_count", *CELLS]
    return accounts.join(by_account, "email", "left").na.fill(0, filled)


def session_ordinals(sessions: DataFrame, owner: str, created: str, key: str) -> DataFrame:
    """Display number of a session within its account, oldest first."""
    rows = sessions.where(F.col(owner).isNotNull())
    order = [F.col(created).asc(), F.col(key).asc()]
    return numbered(rows, [owner], order, F.date_trunc("month", F.col(created)), "ordinal")


def review_queue(clips: DataFrame, created: str, key: Sequence[Column], status: Column, *, latest: int = 500, shown: int = 100) -> DataFrame:
    """Among the latest clips, those that need review; the first of them.

    The inner limit is taken before the status filter, as in the review page.
    """
    newest = clips.orderBy(F.col(created).desc(), *key).limit(latest)
    return newest.where(status.isin("flagged_for_review", "auto_rejected")).orderBy(F.col(created).desc(), *key).limit(shown)


def latest(rows: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    return rows.orderBy(*order).limit(count)


def erasure(tables: dict[str, DataFrame], emails: DataFrame) -> dict[str, DataFrame]:
    """What goes when accounts are erased, per table, with the file paths.

    ``tables`` has accounts, participants, sessions, clips and segments.
    """
    gone = {"accounts": tables["accounts"].join(emails, "email", "left_semi")}
    mails = emails.select(F.col("email").alias("user_email"))
    gone["participants"] = tables["participants"].join(mails, "user_email", "left_semi")
    gone["sessions"] = tables["sessions"].join(gone["participants"].select("participant_id"), "participant_id", "left_semi")
    gone["clips"] = tables["clips"].join(gone["sessions"].select("session_id"), "session_id", "left_semi")
    parents = gone["clips"].select(F.col("clip_id").alias("parent_clip_id")).distinct()
    gone["segments"] = tables["segments"].join(parents, "parent_clip_id", "left_semi")
    paths = gone["clips"].select(F.col("raw_audio_path").alias("path"))
    gone["files"] = paths.unionByName(gone["segments"].select(F.col("segment_audio_path").alias("path"))).where("path is not null")
    return gone


def session_erasure(participants: DataFrame, sessions: DataFrame, removed: DataFrame) -> DataFrame:
    """Participants left without a session once ``removed`` sessions go."""
    touched = sessions.join(removed, "session_id", "left_semi").select("participant_id").distinct()
    left = sessions.join(removed, "session_id", "left_anti").select("participant_id")
    return participants.join(touched, "participant_id", "left_semi").join(left, "participant_id", "left_anti")


def kept(tables: dict[str, DataFrame], gone: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    return {name: tables[name].join(gone[name].select(key).distinct(), key, "left_anti") for name, key in keys.items()}


def export_warnings(clips: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded paths without a stored file, by kind."""

    def missing(rows: DataFrame, kind: str, key: str, path: str) -> DataFrame:
        listed = rows.where(F.coalesce(F.col(path), F.lit("")) != "")
        absent = listed.join(files.select(F.col("path").alias(path)), path, "left_anti")
        return absent.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("item"), F.col(path).alias("path"))

    return (
        missing(clips, "missing_raw_audio", "clip_id", "raw_audio_path")
        .unionByName(missing(clips, "missing_processed_wav", "clip_id", "processed_wav_path"))
        .unionByName(missing(segments, "missing_segment_audio", "segment_id", "segment_audio_path"))
    )


def group_manifest(clips: DataFrame, files: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Clips with a stored file; unknown prompt groups count as legacy."""
    present = clips.join(files.select(F.col("path").alias("raw_audio_path")), "raw_audio_path", "left_semi")
    group = F.when(F.col("prompt_group").isin(*groups), F.col("prompt_group")).otherwise(LEGACY)
    return present.withColumn("prompt_group", group)
