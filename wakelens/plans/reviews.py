"""Rollup, review, erasure and export plans over the account star."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as ru
from ..functions import times
from ..sources import export as ex
from ..sources import writers as wr
from ..session import shared_folder
from .bindings import GROUPS, STAR_SQL, accounts, clip_columns, clips, participants, sessions, table, with_ctes
from .registry import plan

SEGMENTS_SQL = """cp AS (SELECT c.*, o_custkey AS participant_id, 'raw/' || clip_id || '-' || prompt_id || '.webm' AS raw_audio_path,
  CASE WHEN label = 1 THEN 'wav/' || clip_id || '-' || prompt_id || '.wav' ELSE '' END AS processed_wav_path FROM clips c JOIN orders ON o_orderkey = session_id),
segs AS (SELECT clip_id || '/' || prompt_id AS segment_id, clip_id AS parent_clip_id, session_id, participant_id, 'seg/' || clip_id || '-' || prompt_id || '.wav' AS segment_audio_path FROM cp WHERE duration_sec > 3)"""
S = with_ctes(STAR_SQL, SEGMENTS_SQL)


def recorded(clip: dict[str, F.Column]) -> dict[str, F.Column]:
    """The recorded paths of a clip and the columns of its segment."""
    number = clip["prompt_id"].cast("string")
    stem = F.concat_ws("-", clip["clip_id"], number)
    return {
        "raw_audio_path": F.concat(F.lit("raw/"), stem, F.lit(".webm")),
        "processed_wav_path": F.when(clip["label"] == 1, F.concat(F.lit("wav/"), stem, F.lit(".wav"))).otherwise(""),
        "segment_id": F.concat_ws("/", clip["clip_id"], number),
        "parent_clip_id": clip["clip_id"],
        "segment_audio_path": F.concat(F.lit("seg/"), stem, F.lit(".wav")),
    }


def owners(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("participant_id"))


def star(spark, sf_dir):
    rows = clips(spark, sf_dir).drop("ingest").join(owners(spark, sf_dir), "session_id")
    made = recorded({c: F.col(c) for c in ("clip_id", "prompt_id", "label")})
    rows = rows.withColumns({c: made[c] for c in ("raw_audio_path", "processed_wav_path")})
    segs = rows.where(F.col("duration_sec") > 3).select(
        made["segment_id"].alias("segment_id"),
        made["parent_clip_id"].alias("parent_clip_id"),
        "session_id",
        "participant_id",
        made["segment_audio_path"].alias("segment_audio_path"),
    )
    return {
        "accounts": accounts(spark, sf_dir),
        "participants": participants(spark, sf_dir),
        "sessions": sessions(spark, sf_dir),
        "clips": rows,
        "segments": segs,
    }


OWNED_SQL = "owned AS (SELECT participant_id, user_email FROM participants WHERE user_email IN (SELECT email FROM accounts))"


@plan(
    "jn6_account_star",
    S
    + f""", {OWNED_SQL} SELECT user_email, count(*) AS clips, count(DISTINCT session_id) AS sessions FROM cp JOIN owned USING (participant_id) GROUP BY 1""",
)
def _jn6(spark, sf_dir):
    """JN6: clips to participants to accounts, inner."""
    s = star(spark, sf_dir)
    held = s["participants"].join(s["accounts"].select(F.col("email").alias("user_email")), "user_email")
    joined = s["clips"].join(held.select("participant_id", "user_email"), "participant_id")
    per_session = joined.groupBy("user_email", "session_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_session.groupBy("user_email").agg(F.sum("_n").alias("clips"), F.count(F.lit(1)).alias("sessions"))


@plan(
    "agg16_admin_summary",
    S
    + f""", {OWNED_SQL}, c AS (SELECT * FROM cp SEMI JOIN owned USING (participant_id)), s AS (SELECT * FROM sessions SEMI JOIN owned USING (participant_id))
SELECT (SELECT count(*) FROM accounts) AS participants, (SELECT count(*) FROM s) AS sessions, (SELECT count(*) FROM s WHERE status = 'submitted') AS submitted_sessions,
  count(*) AS total_clips, count(*) FILTER (WHERE label = 1) AS positive_clips, count(*) FILTER (WHERE label = 0) AS negative_clips,
  count(*) FILTER (WHERE auto_qc_status = 'auto_accepted') AS auto_accepted, count(*) FILTER (WHERE auto_qc_status = 'flagged_for_review') AS flagged,
  count(*) FILTER (WHERE auto_qc_status = 'auto_rejected') AS rejected, (SELECT count(*) FROM segs SEMI JOIN owned USING (participant_id)) AS total_segments FROM c""",
)
def _agg16(spark, sf_dir):
    """AGG16: headline counts of the admin page."""
    s = star(spark, sf_dir)
    return ru.admin_summary(s["accounts"], s["participants"], s["sessions"], s["clips"], s["segments"])


@plan(
    "agg16_group_counts",
    S
    + f""", {OWNED_SQL}, g AS (SELECT coalesce(nullif(prompt_group, ''), 'legacy') AS prompt_group, count(*) AS n FROM cp SEMI JOIN owned USING (participant_id) GROUP BY 1),
names(prompt_group) AS (VALUES ('P1'), ('P2'), ('P3'), ('P4_negative'), ('legacy'))
SELECT prompt_group, coalesce(n, 0) AS clips FROM names FULL JOIN g USING (prompt_group)""",
)
def _agg16_groups(spark, sf_dir):
    """AGG16: clips per prompt group with the legacy fold-in."""
    s = star(spark, sf_dir)
    return ru.group_counts(s["clips"], s["participants"], s["accounts"], list(GROUPS.values()))


@plan(
    "agg17_account_rollup",
    S
    + """, x AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM cp GROUP BY 1)
SELECT email, verified, count(DISTINCT p.participant_id) AS participant_count, count(DISTINCT s.session_id) AS session_count,
  count(DISTINCT s.session_id) FILTER (WHERE status = 'submitted') AS submitted_session_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS clip_count,
  CAST(coalesce(sum(x.p), 0) AS BIGINT) AS positive_clip_count, CAST(coalesce(sum(x.q), 0) AS BIGINT) AS negative_clip_count
FROM accounts a LEFT JOIN participants p ON p.user_email = a.email LEFT JOIN sessions s USING (participant_id) LEFT JOIN x USING (session_id) GROUP BY ALL""",
)
def _agg17(spark, sf_dir):
    """AGG17: per-account counts, zeros kept."""
    s = star(spark, sf_dir)
    return ru.account_rollup(s["accounts"], s["participants"], s["sessions"], s["clips"])


@plan(
    "agg17_session_rollup",
    S
    + """, x AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM cp GROUP BY 1)
SELECT session_id, participant_id, status, coalesce(n, 0) AS clip_count, coalesce(p, 0) AS positive_clip_count, coalesce(q, 0) AS negative_clip_count FROM sessions LEFT JOIN x USING (session_id)""",
)
def _agg17_sessions(spark, sf_dir):
    """AGG17: per-session counts, zeros kept."""
    s = star(spark, sf_dir)
    return ru.session_rollup(s["sessions"], s["clips"]).drop("created_at")


@plan(
    "win27_session_ordinals",
    S
    + """SELECT session_id, user_email, row_number() OVER (PARTITION BY user_email ORDER BY created_at, session_id) AS ordinal
FROM sessions JOIN participants USING (participant_id) WHERE user_email IS NOT NULL""",
)
def _win27(spark, sf_dir):
    """WIN27: display ordinals of sessions within an account."""
    s = star(spark, sf_dir)
    rows = s["sessions"].join(s["participants"].select("participant_id", "user_email"), "participant_id")
    return ru.session_ordinals(rows, "user_email", "created_at", "session_id").select("session_id", "user_email", "ordinal")


ORDER_SQL = "created_at DESC, clip_id, prompt_id, storage_id, duration_sec"
KEY = ("clip_id", "prompt_id", "storage_id", "duration_sec")


@plan(
    "srt1_review_queue",
    S
    + f""", l AS (SELECT * FROM cp ORDER BY {ORDER_SQL} LIMIT 500)
SELECT clip_id, prompt_id, auto_qc_status FROM l WHERE auto_qc_status IN ('flagged_for_review', 'auto_rejected') ORDER BY {ORDER_SQL} LIMIT 100""",
)
def _srt1(spark, sf_dir):
    """SRT1: latest 500 clips, then those to review, then the first 100."""
    queue = ru.review_queue(star(spark, sf_dir)["clips"], "created_at", [F.col(c) for c in KEY], F.col("auto_qc_status"))
    return queue.select("clip_id", "prompt_id", "auto_qc_status")


@plan(
    "srt2_latest_clips",
    S + f"SELECT clip_id, prompt_id, user_email FROM cp JOIN participants USING (participant_id) ORDER BY {ORDER_SQL} LIMIT 500",
)
def _srt2(spark, sf_dir):
    """SRT2: the latest clips with their account, if any."""
    s = star(spark, sf_dir)
    rows = s["clips"].join(s["participants"].select("participant_id", "user_email"), "participant_id")
    top = ru.latest(rows, [F.col("created_at").desc(), *[F.col(c) for c in KEY]], 500)
    return top.select("clip_id", "prompt_id", "user_email")


ERASED_SQL = """em AS (SELECT email FROM accounts WHERE verified), gp AS (SELECT * FROM participants WHERE user_email IN (SELECT email FROM em)),
gs AS (SELECT * FROM sessions SEMI JOIN gp USING (participant_id)), gc AS (SELECT * FROM cp SEMI JOIN gs USING (session_id)),
gg AS (SELECT * FROM segs WHERE parent_clip_id IN (SELECT clip_id FROM gc))"""


def erased(spark, sf_dir):
    s = star(spark, sf_dir)
    return s, ru.erasure(s, s["accounts"].where("verified").select("email"))


def counted(tables):
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@plan(
    "jn14_erasure_removed",
    S
    + f""", {ERASED_SQL} SELECT 'accounts' AS "table", count(*) AS n FROM em UNION ALL SELECT 'participants', count(*) FROM gp UNION ALL SELECT 'sessions', count(*) FROM gs UNION ALL
SELECT 'clips', count(*) FROM gc UNION ALL SELECT 'segments', count(*) FROM gg UNION ALL SELECT 'files', (SELECT count(*) FROM gc) + (SELECT count(*) FROM gg)""",
)
def _jn14(spark, sf_dir):
    """JN14: what goes when the verified accounts are erased."""
    return counted(erased(spark, sf_dir)[1])


@plan(
    "jn14_erasure_kept",
    S
    + f""", {ERASED_SQL} SELECT 'participants' AS "table", count(*) AS n FROM participants WHERE participant_id NOT IN (SELECT participant_id FROM gp) UNION ALL
SELECT 'sessions', count(*) FROM sessions WHERE session_id NOT IN (SELECT session_id FROM gs) UNION ALL
SELECT 'clips', count(*) FROM cp WHERE clip_id NOT IN (SELECT clip_id FROM gc) UNION ALL SELECT 'segments', count(*) FROM segs WHERE segment_id NOT IN (SELECT segment_id FROM gg)""",
)
def _jn14_kept(spark, sf_dir):
    """JN14: what stays."""
    s, gone = erased(spark, sf_dir)
    keys = {"participants": "participant_id", "sessions": "session_id", "clips": "clip_id", "segments": "segment_id"}
    return counted(ru.kept(s, gone, keys))


@plan(
    "jn14_emptied_participants",
    S
    + """, rm AS (SELECT session_id FROM sessions WHERE status = 'submitted')
SELECT participant_id, user_email FROM participants WHERE participant_id IN (SELECT participant_id FROM sessions SEMI JOIN rm USING (session_id))
  AND participant_id NOT IN (SELECT participant_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM rm))""",
)
def _jn14_emptied(spark, sf_dir):
    """JN14: participants left without sessions when the submitted ones go."""
    s = star(spark, sf_dir)
    removed = s["sessions"].where(F.col("status") == "submitted").select("session_id")
    return ru.session_erasure(s["participants"], s["sessions"], removed).select("participant_id", "user_email")


FILES_SQL = """stored AS (SELECT raw_audio_path AS path FROM cp WHERE storage_id > 20 UNION SELECT processed_wav_path FROM cp WHERE storage_id > 10 AND processed_wav_path <> ''
UNION SELECT segment_audio_path FROM segs WHERE session_id > 500)"""


def stored(s):
    raw = s["clips"].where(F.col("storage_id") > 20).select(F.col("raw_audio_path").alias("path"))
    wav = s["clips"].where((F.col("storage_id") > 10) & (F.col("processed_wav_path") != "")).select(F.col("processed_wav_path").alias("path"))
    seg = s["segments"].where(F.col("session_id") > 500).select(F.col("segment_audio_path").alias("path"))
    return raw.unionByName(wav).unionByName(seg).distinct()


@plan(
    "snk4_export_warnings",
    S
    + f""", {FILES_SQL} SELECT 'missing_raw_audio' AS kind, clip_id AS item, raw_audio_path AS path FROM cp WHERE raw_audio_path NOT IN (SELECT path FROM stored) UNION ALL
SELECT 'missing_processed_wav', clip_id, processed_wav_path FROM cp WHERE processed_wav_path <> '' AND processed_wav_path NOT IN (SELECT path FROM stored) UNION ALL
SELECT 'missing_segment_audio', segment_id, segment_audio_path FROM segs WHERE segment_audio_path NOT IN (SELECT path FROM stored)""",
)
def _snk4(spark, sf_dir):
    """SNK4: warnings for recorded paths without a file."""
    s = star(spark, sf_dir)
    return ru.export_warnings(s["clips"], s["segments"], stored(s))


@plan(
    "snk4_group_manifests",
    S
    + f""", {FILES_SQL} SELECT CASE WHEN prompt_group = '' THEN 'legacy' ELSE prompt_group END AS prompt_group, count(*) AS clips, count(DISTINCT clip_id) AS ids FROM cp WHERE raw_audio_path IN (SELECT path FROM stored) GROUP BY 1""",
)
def _snk4_groups(spark, sf_dir):
    """SNK4: per-group manifests, written by group and read back."""
    s = star(spark, sf_dir)
    rows = ru.group_manifest(s["clips"], stored(s), list(GROUPS.values()))
    path = shared_folder(spark)
    wr.write_partitioned(rows.select("prompt_group", "clip_id", "raw_audio_path", "label"), path, ["prompt_group"], "json")
    back = spark.read.schema("clip_id string, raw_audio_path string, label int, prompt_group string").json(path)
    return back.groupBy("prompt_group").agg(F.count(F.lit(1)).alias("clips"), F.count_distinct("clip_id").alias("ids"))


EXPORT_FIELDS = {
    "accounts": ("email", "verified"),
    "participants": ("participant_id", "user_email", "device"),
    "sessions": ("session_id", "participant_id", "status", "created_at"),
    "clips": ("clip_id", "session_id", "prompt_id", "prompt_group", "label", "raw_audio_path", "processed_wav_path", "created_at"),
    "quality": ("clip_id", "auto_qc_status", "duration_sec"),
    "segments": ("segment_id", "parent_clip_id", "session_id", "participant_id", "segment_audio_path"),
}
EXPORT_ORDER = {"accounts": "email", "participants": "participant_id", "sessions": "session_id", "segments": "segment_id"}
EXPORT_SOURCE = {"clips": "cp", "quality": "cp", "segments": "segs"}


def _export_sql(name: str) -> str:
    shown = ["strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')" if f == "created_at" else f"CAST({f} AS VARCHAR)" for f in EXPORT_FIELDS[name]]
    canonical = ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in shown)
    rows = f"SELECT CAST('0x' || left(sha256(concat_ws(',', {canonical})), 15) AS BIGINT) AS h FROM {EXPORT_SOURCE.get(name, name)}"
    return f"SELECT '{name}' AS name, {len(shown)} AS columns, count(*) AS rows, sha256(concat_ws('|', bit_xor(h), CAST(sum(h) AS HUGEINT), count(*), '{name}')) AS fingerprint, true AS intact FROM ({rows})"


def export(spark, sf_dir):
    """The metadata tables of the star, exported to a fresh folder.

    Clips, quality and segments are made of the lines behind the shuffles.  The
    largest tables come first, while little else is written yet.
    """
    s = star(spark, sf_dir)
    made = clip_columns()
    made |= recorded(made) | {"participant_id": F.col("participant_id")}
    lines = table(spark, sf_dir, "lineitem").join(owners(spark, sf_dir), F.col("l_orderkey") == F.col("session_id"))
    rows = {"clips": lines, "quality": lines, "segments": lines.where(made["duration_sec"] > 3)}
    tables = {name: (found, {f: made[f] for f in EXPORT_FIELDS[name]}, [made[EXPORT_ORDER.get(name, "clip_id")]]) for name, found in rows.items()}
    tables |= {name: (s[name], EXPORT_FIELDS[name], [EXPORT_ORDER[name]]) for name in ("sessions", "participants", "accounts")}
    folder = shared_folder(spark)
    ex.write_export(tables, folder)
    return folder


@plan("snk4_metadata_tables", S + " UNION ALL ".join(_export_sql(n) for n in EXPORT_FIELDS))
def _snk4_tables(spark, sf_dir):
    """SNK4: the export's metadata tables, read back and held against their manifest."""
    return ex.check_export(spark, export(spark, sf_dir))


@plan("snk4_exported_clips", S + "SELECT clip_id, prompt_group, processed_wav_path, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM cp")
def _snk4_clips(spark, sf_dir):
    """SNK4: the clip table as a reader of the export sees it."""
    rows = ex.read_export(spark, export(spark, sf_dir))["clips"]
    return rows.select("clip_id", "prompt_group", "processed_wav_path", "created_at")


@plan(
    "date1_utc_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS from_kolkata
FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)""",
)
def _date1(spark, sf_dir):
    """Section 2.11, date: ISO text in UTC, and local wall clocks turned into UTC."""
    local = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", times.iso_utc(F.col("ts").cast("timestamp")).alias("iso"), times.iso_utc(times.to_utc(local, "Asia/Kolkata")).alias("from_kolkata")
    )
