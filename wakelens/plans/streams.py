"""Streaming plans with their batch twins, and frame-table plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import frames as fr
from ..operators import metrics as mt
from ..session import shared_folder
from ..streaming import intake, late, triggers
from ..streaming import windows as sw
from .bindings import (
    FRAMES_SQL,
    GROUPS,
    KEYWORD,
    STAR_SQL,
    UTTERANCES_SQL,
    WINDOWS_SQL,
    clips,
    frames,
    recognised,
    table,
    utterances,
    windows,
    with_ctes,
)
from .registry import plan
from .scoring import C, W, cascaded

DAY = 86_400_000_000
# A row of this time ends a finite stream.
LAST = 250 * 366 * DAY
NAMES = triggers.states(KEYWORD)


def trigger_events(rows):
    """Events as assistant chunks: clicks and purchases trigger."""
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").cast("string").alias("session"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        kind.isin("click", "purchase", "view").alias("candidate"),
        kind.isin("click", "purchase").alias("trigger"),
        kind.alias("text"),
    )


TRIGGER_SQL = f"""te AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, epoch_us(ts) AS t, event_type IN ('click', 'purchase', 'view') AS candidate, event_type IN ('click', 'purchase') AS trig FROM events),
tr AS (SELECT session, event_id, t, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS i FROM te WHERE trig),
walk AS (SELECT session, event_id, t, i FROM tr WHERE i = 1 UNION ALL
  SELECT n.session, n.event_id, n.t, n.i FROM walk w, LATERAL (SELECT * FROM tr WHERE tr.session = w.session AND tr.t >= w.t + {DAY} ORDER BY t, event_id LIMIT 1) n),
tl AS (SELECT te.*, w.event_id IS NOT NULL AS trigger_accepted FROM te LEFT JOIN walk w USING (session, event_id)),
tp AS (SELECT *, max(CASE WHEN trigger_accepted THEN t END) OVER (PARTITION BY session ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM tl),
tz AS (SELECT session, event_id, trigger_accepted, coalesce(t - last < {DAY}, false) AS cooldown_active, candidate FROM tp),
ts_ AS (SELECT session, event_id, trigger_accepted, cooldown_active, CASE WHEN trigger_accepted THEN '{NAMES['accepted']}' WHEN cooldown_active THEN '{NAMES['listening']}'
  WHEN candidate THEN '{NAMES['candidate']}' ELSE '{NAMES['listening']}' END AS assistant_state FROM tz)"""


@plan("str1_trigger_states", with_ctes(TRIGGER_SQL) + "SELECT * FROM ts_")
def _str1(spark, sf_dir):
    """STR1: cool-down trigger states, batch."""
    rows = trigger_events(table(spark, sf_dir, "events"))
    out = triggers.trigger_states(
        rows, session="session", t="t", tie="event_id", trigger="trigger", candidate="candidate", cooldown=DAY, chunk=7 * DAY, keyword=KEYWORD
    )
    return out.select("session", "event_id", "trigger_accepted", "cooldown_active", "assistant_state")


def event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return intake.file_stream(spark, f"{sf_dir}/events.parque[t]", schema)


def drained(rows, idle=None):
    """Decided rows of a finite stream; none is late, since its end comes last."""
    whole = intake.ended(rows, session="", event_id=-1, t=LAST, kind="end")
    return intake.drain(triggers.assistant_stream(whole, cooldown=DAY, keyword=KEYWORD, delay="1 hour", idle=idle))


@plan("str1_trigger_stream", with_ctes(TRIGGER_SQL) + "SELECT * FROM ts_")
def _str1_stream(spark, sf_dir):
    """STR1 and UDF5: the same states from a stateful stream."""
    rows = trigger_events(event_stream(spark, sf_dir)).withColumn("kind", F.lit("chunk"))
    out = drained(rows, idle=90 * DAY)
    return out.select("session", "event_id", "trigger_accepted", "cooldown_active", "assistant_state")


ROLLING_SQL = """ct AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations),
cj AS (SELECT conv_id, turn, string_agg(s, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM ct),
cr AS (SELECT conv_id, turn, regexp_replace(CASE WHEN length(a) > 1600 THEN right(a, 1600) ELSE a END, '^\\s+', '') AS rolling FROM cj)"""


@plan("str2_rolling_transcript", with_ctes(ROLLING_SQL) + "SELECT conv_id, turn, sha256(rolling) AS rolling, length(rolling) AS n FROM cr".replace("length(rolling) AS n", "CAST(length(rolling) AS INT) AS n"))
def _str2(spark, sf_dir):
    """STR2: rolling transcript of the last 1600 characters, batch."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = triggers.rolling_transcript(turns, "conv_id", ["turn"], "text", bucket=F.floor(F.col("turn") / 1024))
    return out.select("conv_id", "turn", F.sha2("rolling_transcript", 256).alias("rolling"), F.length("rolling_transcript").alias("n"))


@plan("str2_rolling_stream", with_ctes(ROLLING_SQL) + "SELECT conv_id, turn, sha256(rolling) AS rolling FROM cr")
def _str2_stream(spark, sf_dir):
    """STR2: the same from the stateful stream."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    stream = intake.file_stream(spark, f"{sf_dir}/conversations.parque[t]", schema)
    no = F.lit(False)
    rows = stream.select(
        F.col("conv_id").cast("string").alias("session"),
        F.col("turn").alias("event_id"),
        (F.col("turn") * 1_000_000).alias("t"),
        F.lit("chunk").alias("kind"),
        "text",
        no.alias("candidate"),
        no.alias("trigger"),
    )
    out = drained(rows)
    return out.select(F.col("session").cast("long").alias("conv_id"), F.col("event_id").alias("turn"), F.sha2("rolling_transcript", 256).alias("rolling"))


@plan(
    "str3_chunk_decisions",
    W
    + """, c AS (SELECT event_id, speaker, stage1_score >= 0.4 AS candidate, CASE WHEN event_type <> 'error' THEN stage2_score END AS s, stage2_score_b AS sim FROM w),
b AS (SELECT *, CASE WHEN speaker < 75 THEN 0.5 ELSE 0.0 END AS bias, CASE WHEN speaker < 40 THEN 0.5 ELSE 0.6 END AS lim, least(greatest(s, 1e-6), 1 - 1e-6) AS c FROM c),
z AS (SELECT *, 1 / (1 + exp(-(ln(c / (1 - c)) + bias))) AS cal FROM b)
SELECT event_id, candidate, round(cal, 6) AS calibrated_score, candidate AND coalesce(cal >= 0.25, false) AS base_trigger, candidate AND sim >= lim AS prototype_detected,
  (candidate AND coalesce(cal >= 0.25, false)) OR (candidate AND sim >= lim) AS trigger_detected FROM z""",
)
def _str3(spark, sf_dir):
    """STR3: per-chunk decision with calibration and prototype."""
    w = windows(spark, sf_dir)
    score = F.when(F.col("event_type") != "error", F.col("stage2_score"))
    chunks = w.select(
        "event_id",
        F.col("speaker").alias("session"),
        (F.col("stage1_score") >= 0.4).alias("candidate"),
        score.alias("stage2_score"),
        F.col("stage2_score_b").alias("similarity"),
    )
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct().where(F.col("session") < 75)
    limit = F.when(F.col("session") < 40, 0.5)
    calibration = known.select("session", F.lit(0.5).alias("bias"), limit.alias("prototype_threshold"))
    out = triggers.chunk_decisions(chunks, calibration, 0.25)
    return out.select("event_id", "candidate", "calibrated_score", "base_trigger", "prototype_detected", "trigger_detected")


ACCOUNT_SQL = f"""ke AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, epoch_us(ts) AS t, event_type,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'reset' ELSE 'chunk' END AS kind FROM events),
ko AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY session) AS n FROM ke),
ac AS (SELECT session, 0::BIGINT AS i, NULL::BIGINT AS last, 0::BIGINT AS chunks, true AS active, '{NAMES['idle']}' AS assistant_state, 0::BIGINT AS accepted FROM ko WHERE i = 1
  UNION ALL SELECT session, i, CASE WHEN hit THEN t WHEN kind = 'reset' THEN NULL ELSE last END, chunks + CAST(kind = 'chunk' AS BIGINT), active OR kind = 'start',
    CASE WHEN hit THEN '{NAMES['accepted']}' WHEN kind = 'reset' THEN '{NAMES['idle']}' WHEN kind = 'chunk' AND event_type IN ('click', 'purchase', 'view') AND NOT cold THEN '{NAMES['candidate']}' ELSE '{NAMES['listening']}' END,
    accepted + CAST(hit AS BIGINT)
  FROM (SELECT *, kind = 'chunk' AND event_type IN ('click', 'purchase') AND NOT cold AS hit
    FROM (SELECT w.session, o.i, w.last, w.chunks, w.active, w.accepted, o.t, o.kind, o.event_type, coalesce(o.t - w.last < {DAY}, false) AS cold FROM ac w JOIN ko o ON o.session = w.session AND o.i = w.i + 1)))"""


@plan("str4_session_accounting", with_ctes(ACCOUNT_SQL) + "SELECT a.session, chunks, active, assistant_state, accepted FROM ac a JOIN (SELECT DISTINCT session, n FROM ko) k ON k.session = a.session AND k.n = a.i")
def _str4(spark, sf_dir):
    """STR4: chunks, active flag and control events per session, streamed."""
    stream = trigger_events(event_stream(spark, sf_dir))
    kind = F.when(F.col("text") == "signup", "start").when(F.col("text") == "error", "reset").otherwise("chunk")
    out = drained(stream.withColumn("kind", kind))
    last = F.struct("t", "event_id")
    return out.groupBy("session").agg(
        F.max("chunks").alias("chunks"),
        F.max_by("active", last).alias("active"),
        F.max_by("assistant_state", last).alias("assistant_state"),
        F.count_if("trigger_accepted").alias("accepted"),
    )


def scored_events(rows):
    return rows.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500.0).alias("score"))


SLIDING_SQL = """sx AS (SELECT user_id AS session, ts, value / 500.0::DOUBLE AS score FROM events),
sy AS (SELECT session, score, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start FROM sx, range(4) r(k)),
sl AS (SELECT session, window_start, count(*) AS chunks, round(max(score), 6) AS max_score, count(*) FILTER (WHERE score >= 0.1) AS candidates,
  round(count(*) FILTER (WHERE score >= 0.1) / count(*)::DOUBLE, 6) AS candidate_rate FROM sy GROUP BY ALL)"""


def shown(rows):
    stamp = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.select("session", stamp, "chunks", "max_score", "candidates", "candidate_rate")


STAMP = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start"


@plan("str5_sliding_windows", with_ctes(SLIDING_SQL) + f"SELECT session, {STAMP}, chunks, max_score, candidates, candidate_rate FROM sl")
def _str5(spark, sf_dir):
    """STR5: sliding-window maxima and candidate rates, batch."""
    rows = scored_events(table(spark, sf_dir, "events"))
    return shown(sw.sliding(rows, ts="ts", size="24 hours", slide="6 hours", theta=0.1))


@plan(
    "str5_sliding_stream",
    with_ctes(SLIDING_SQL)
    + f"SELECT session, {STAMP}, chunks, max_score, candidates, candidate_rate FROM sl WHERE window_start + INTERVAL '24 hours' <= (SELECT max(ts) FROM sx) - INTERVAL '1 hour'",
)
def _str5_stream(spark, sf_dir):
    """STR5: the same windows streamed; those past the watermark are closed."""
    stream = scored_events(event_stream(spark, sf_dir))
    return shown(intake.drain(sw.sliding(stream, ts="ts", size="24 hours", slide="6 hours", theta=0.1, delay="1 hour")))


@plan(
    "str5_tumbling_windows",
    with_ctes(SLIDING_SQL)
    + f""", tb AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS chunks, round(max(score), 6) AS max_score, count(*) FILTER (WHERE score >= 0.1) AS candidates FROM sx GROUP BY 1)
SELECT {STAMP}, chunks, max_score, candidates FROM tb""",
)
def _str5_tumbling(spark, sf_dir):
    """STR5: tumbling sibling over all sessions."""
    rows = sw.tumbling(scored_events(table(spark, sf_dir, "events")), ts="ts", size="1 hour", theta=0.1, keys=())
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "chunks", "max_score", "candidates")


@plan(
    "str5_session_windows",
    with_ctes(SLIDING_SQL)
    + f""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM sx),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS chunks, round(max(score), 6) AS max_score, count(*) FILTER (WHERE score >= 0.1) AS candidates,
  round(count(*) FILTER (WHERE score >= 0.1) / count(*)::DOUBLE, 6) AS candidate_rate FROM i GROUP BY session, island""",
)
def _str5_sessions(spark, sf_dir):
    """STR5: session-window sibling with a twelve-hour gap."""
    return shown(sw.sessions(scored_events(table(spark, sf_dir, "events")), ts="ts", gap_seconds=12 * 3600, theta=0.1))


HALF_SQL = f"""le AS (SELECT user_id AS session, event_id, epoch_us(ts) AS t, value / 500.0::DOUBLE AS score FROM events),
lm AS (SELECT (min(t) + max(t)) // 2 AS mid FROM le), lp AS (SELECT le.*, t > mid OR event_id % 7 = 0 AS second FROM le, lm),
lw AS (SELECT max(t) // 1000 - 3600000 AS wm FROM lp WHERE NOT second)"""
LATE_SHOWN = "SELECT session, NULL::BIGINT AS t, NULL::DOUBLE AS score, window_start, window_end, count(*) AS chunks, round(max(score), 6) AS max_score, count(*) FILTER (WHERE score >= 0.1) AS candidates, false AS late"
LATE_ROWS = "SELECT session, t, round(score, 6), NULL, NULL, NULL, NULL, NULL, true"


def two_runs(spark, sf_dir, windowed):
    """Events in two runs of one stream: the earlier half without every seventh row, then all the rest."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") / 500.0).alias("score"))
    ends = rows.agg(F.min("t"), F.max("t")).first()
    mid = 0 if ends[0] is None else (ends[0] + ends[1]) // 2
    second = (F.col("t") > mid) | (F.col("event_id") % 7 == 0)
    path, base = shared_folder(spark), shared_folder(spark)
    event = [F.col("session").cast("string").alias("session"), "t", "score", F.lit("chunk").alias("kind")]
    end = spark.range(1).select(F.lit("").alias("session"), F.lit(LAST).alias("t"), F.lit(None).cast("double").alias("score"), F.lit("end").alias("kind"))
    for part in (rows.where(~second).select(*event), rows.where(second).select(*event), end):
        part.write.mode("append").parquet(path)
        out = intake.drain(windowed(intake.file_stream(spark, path, end.schema)), base=base)
    return out.withColumn("session", F.col("session").cast("long"))


@plan(
    "str5_late_windows",
    with_ctes(HALF_SQL)
    + f""", lx AS (SELECT lp.*, t - t % {DAY // 4} AS top FROM lp),
ly AS (SELECT lx.*, top - k * {DAY // 4} AS window_start, top - k * {DAY // 4} + {DAY} AS window_end FROM lx, range(4) r(k))
{LATE_SHOWN} FROM ly, lw WHERE NOT second OR window_end // 1000 > wm GROUP BY session, window_start, window_end
UNION ALL {LATE_ROWS} FROM lx, lw WHERE second AND (top + {DAY}) // 1000 <= wm""",
)
def _str5_late(spark, sf_dir):
    """STR5: sliding windows and the table of late rows in one pass of a stream that was stopped and resumed."""
    return two_runs(spark, sf_dir, lambda s: late.sliding(s, size=DAY, slide=DAY // 4, theta=0.1, delay="1 hour"))


@plan(
    "str5_late_sessions",
    with_ctes(HALF_SQL)
    + f""", ld AS (SELECT lp.*, second AND (t + {DAY // 2}) // 1000 <= wm AS gone FROM lp, lw),
la AS (SELECT session, t, score, second, sum(fresh) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t) < {DAY // 2} THEN 0 ELSE 1 END AS fresh FROM ld WHERE NOT second)),
lz AS (SELECT session, run, max(t) AS last FROM la GROUP BY ALL),
lc AS (SELECT la.session, t, score, (last + {DAY // 2}) // 1000 <= wm AS done FROM la JOIN lz USING (session, run), lw),
lo AS (SELECT session, t, score, done FROM lc UNION ALL SELECT session, t, score, false FROM ld WHERE second AND NOT gone),
lr AS (SELECT *, sum(fresh) OVER (PARTITION BY session, done ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session, done ORDER BY t) < {DAY // 2} THEN 0 ELSE 1 END AS fresh FROM lo)),
lv AS (SELECT *, min(t) OVER w AS window_start, max(t) OVER w + {DAY // 2} AS window_end FROM lr WINDOW w AS (PARTITION BY session, done, run))
{LATE_SHOWN} FROM lv GROUP BY session, done, run, window_start, window_end UNION ALL {LATE_ROWS} FROM ld WHERE gone""",
)
def _str5_late_sessions(spark, sf_dir):
    """STR5: session windows with a twelve-hour gap as a stream, with its table of late rows."""
    return two_runs(spark, sf_dir, lambda s: late.sessions(s, gap=DAY // 2, theta=0.1, delay="1 hour"))


@plan(
    "str6_incremental_intake",
    with_ctes(UTTERANCES_SQL)
    + "SELECT status AS outcome, count(*) AS rows, count(DISTINCT id) AS ids FROM run_a GROUP BY status UNION ALL SELECT 'broken', 8, 0",
)
def _str6(spark, sf_dir):
    """STR6: prediction files streamed in and routed; the last row of an id wins, broken lines stay."""
    run = recognised(utterances(spark, sf_dir)).select("id", "status", "hypothesis", F.lit("2024-01-01 00:00:00").alias("at"))
    path = shared_folder(spark)
    # Successes come twice, once after a failed try; five broken lines and three rows without an id.
    tried = run.where(F.col("status") == "success").withColumn("status", F.lit("failed")).withColumn("at", F.lit("2023-12-31 00:00:00"))
    run.unionByName(run.where(F.col("status") == "success")).unionByName(tried).write.json(path)
    odd = F.when(F.col("id") < 5, F.concat(F.lit('{"id": '), F.col("id"))).otherwise(F.lit('{"status": "failed", "at": "2024-01-01 00:00:00"}'))
    spark.range(8).select(odd.alias("value")).write.mode("append").text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "status", "hypothesis", "at")])
    stream = intake.prediction_stream(spark, path, schema).withColumn("ts", F.col("at").cast("timestamp"))
    routed = intake.route_predictions(stream, "id", "ts")
    known = F.when(F.col("outcome") != "broken", F.col("id"))
    return routed.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(known).alias("ids"))


# --- frames and windows ---------------------------------------------------------------

HOUR = 3_600_000_000
QUANT_SQL = """fq AS (SELECT clip_id, count(*) AS n, list(energy ORDER BY energy) AS l FROM fr GROUP BY clip_id),
fx AS (SELECT clip_id, n, (n - 1) * 0.2::DOUBLE AS pos, l FROM fq),
fp AS (SELECT clip_id, n, l[CAST(floor(pos) AS BIGINT) + 1] * (1 - (pos - floor(pos))) + l[least(CAST(floor(pos) AS BIGINT) + 2, n)] * (pos - floor(pos)) AS p20,
  (l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2 AS median, l[n] AS peak FROM fx)"""


@plan(
    "win21_window_placement",
    with_ctes(STAR_SQL)
    + """, p AS (SELECT clip_id, prompt_id, storage_id, prompt_group, CAST(storage_id * 100 - 500 AS BIGINT) AS b0, CAST(storage_id * 100 - 500 + duration_sec * 16000 AS BIGINT) AS e0,
  CAST(duration_sec * 16000 + storage_id * 50 - 200 AS BIGINT) AS n FROM clips),
q AS (SELECT *, greatest(0, least(b0, n)) AS b FROM p), r AS (SELECT *, greatest(b, least(e0, n)) AS e FROM q),
t AS (SELECT *, prompt_group = 'P4_negative' AND greatest(1, e - b) > 43200 AS tiled FROM r),
s AS (SELECT *, CASE WHEN n <= 0 THEN [0] WHEN prompt_group = 'P2' THEN [e - 32000] WHEN prompt_group = 'P3' THEN [b] WHEN tiled THEN range(b, e, 32000) ELSE [(b + e) // 2 - 16000] END AS st,
  CASE WHEN n <= 0 THEN 'empty_pad' WHEN prompt_group = 'P2' THEN 'p2_final_speech_window' WHEN prompt_group = 'P3' THEN 'p3_initial_speech_window' WHEN tiled THEN 'p4_negative_nonoverlap'
  WHEN prompt_group = 'P1' THEN 'center_speech_window' ELSE 'center_negative_window' END AS rule FROM t),
u AS (SELECT rule, n, unnest(st) AS x FROM s)
SELECT rule, count(*) AS windows, CAST(sum(x) AS BIGINT) AS starts, CAST(sum(greatest(0, -x)) AS BIGINT) AS left_pad, CAST(sum(greatest(0, x + 32000 - n)) AS BIGINT) AS right_pad FROM u GROUP BY rule""",
)
def _win21(spark, sf_dir):
    """WIN21: fixed-window placement with padding."""
    rows = clips(spark, sf_dir)
    begin = (F.col("storage_id") * 100 - 500).cast("long")
    speech = F.col("duration_sec") * 16000
    placed = fr.window_bounds(
        rows.select(
            "prompt_group",
            begin.alias("b0"),
            F.round(begin + speech).cast("long").alias("e0"),
            F.round(speech + F.col("storage_id") * 50 - 200).cast("long").alias("n"),
        ),
        GROUPS,
        group="prompt_group",
        begin="b0",
        end="e0",
        total="n",
        window=32000,
    )
    return placed.groupBy("rule").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("window_start").cast("long").alias("starts"),
        F.sum("left_pad").cast("long").alias("left_pad"),
        F.sum("right_pad").cast("long").alias("right_pad"),
    )


@plan(
    "win22_sliding_windows",
    with_ctes(UTTERANCES_SQL)
    + """, a AS (SELECT length(reference) * 1000 AS n FROM utts), b AS (SELECT n, greatest(0, n - 32000) AS last FROM a),
c AS (SELECT n, unnest(list_distinct(list_append(range(0, last + 1, 4000), last))) AS x FROM b)
SELECT CAST(x AS BIGINT) AS window_start, x + 32000 > n AS padded, count(*) AS windows FROM c GROUP BY ALL""",
)
def _win22(spark, sf_dir):
    """WIN22: overlapping windows plus the last aligned one."""
    rows = utterances(spark, sf_dir).select((F.length("reference") * 1000).cast("long").alias("n"))
    made = fr.sliding_windows(rows, "n", 32000, 4000)
    return made.groupBy("window_start", "padded").agg(F.count(F.lit(1)).alias("windows"))


@plan(
    "win22_window_counts",
    with_ctes(UTTERANCES_SQL)
    + """, a AS (SELECT split, length(reference) * 1000 AS n FROM utts)
SELECT split, CAST(sum(CASE WHEN n < 32000 THEN 1 ELSE (n - 32000) // 4000 + 1 END) AS BIGINT) AS windows FROM a GROUP BY split""",
)
def _win22_counts(spark, sf_dir):
    """WIN22: window counts without the last aligned one."""
    size = (F.length("reference") * 1000).cast("long")
    return utterances(spark, sf_dir).groupBy("split").agg(F.sum(fr.sliding_window_count(size, 32000, 4000)).alias("windows"))


@plan(
    "win23_activity_bounds",
    with_ctes(FRAMES_SQL, QUANT_SQL)
    + f""", li AS (SELECT clip_id, greatest(80.0, p20 * 2.0, peak * 0.02) AS threshold FROM fp),
ab AS (SELECT clip_id, max(threshold) AS threshold, count(*) FILTER (WHERE energy >= threshold) AS active_frames, min(t_us) AS lo, max(t_us) AS hi,
  min(t_us) FILTER (WHERE energy >= threshold) AS a, max(t_us) FILTER (WHERE energy >= threshold) AS z FROM fr JOIN li USING (clip_id) GROUP BY clip_id)
SELECT clip_id, round(threshold, 6)::DOUBLE AS threshold, active_frames, coalesce(greatest(lo, a - {HOUR}), lo) AS speech_begin, coalesce(least(hi, z + {HOUR}), hi) AS speech_end FROM ab""",
)
def _win23(spark, sf_dir):
    """WIN23: first and last active frame per clip."""
    return fr.activity_bounds(frames(spark, sf_dir), "clip_id", "t_us", "energy", pad=HOUR)


SEGMENT_SQL = f"""lm AS (SELECT clip_id, greatest(p20 * 3.0, median * 1.5, peak * 0.08, 0.008) AS threshold FROM fp),
sp AS (SELECT clip_id, min(t_us) AS lo, max(t_us) AS hi FROM fr GROUP BY 1),
ac AS (SELECT fr.* FROM fr JOIN lm USING (clip_id) WHERE energy > threshold),
gp AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY clip_id ORDER BY t_us, event_id) <= {DAY} THEN 0 ELSE 1 END AS fresh FROM ac),
il AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY clip_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM gp),
sg AS (SELECT clip_id, island, min(t_us) AS a, max(t_us) AS z, count(*) AS frames FROM il GROUP BY ALL HAVING max(t_us) - min(t_us) >= {6 * HOUR})"""


def found_segments(spark, sf_dir):
    return fr.segments(
        frames(spark, sf_dir), "clip_id", "t_us", "energy", gap=DAY, shortest=6 * HOUR, pad=HOUR, bucket=F.floor(F.col("t_us") / DAY), tie=["event_id"]
    )


@plan(
    "win24_segments",
    with_ctes(FRAMES_SQL, QUANT_SQL, SEGMENT_SQL)
    + f"""SELECT clip_id, island, greatest(lo, a - {HOUR}) AS start, least(hi, z + {HOUR}) AS "end", frames FROM sg JOIN sp USING (clip_id)""",
)
def _win24(spark, sf_dir):
    """WIN24: segments as gaps and islands above an adaptive threshold."""
    return found_segments(spark, sf_dir)


@plan(
    "win24_segmentation_status",
    with_ctes(FRAMES_SQL, QUANT_SQL, SEGMENT_SQL)
    + """, dt AS (SELECT f.clip_id, coalesce(n, 0) AS detected, f.e AS expected FROM (SELECT clip_id, clip_id % 7 + 2 AS e FROM (SELECT DISTINCT clip_id FROM fr)) f LEFT JOIN (SELECT clip_id, count(*) AS n FROM sg GROUP BY 1) g USING (clip_id))
SELECT clip_id, expected, detected, CASE WHEN detected = 0 THEN 'failed_no_segments' WHEN detected = expected THEN 'ok' ELSE 'warning_count_mismatch' END AS status FROM dt""",
)
def _win24_status(spark, sf_dir):
    """WIN24: detected against expected counts."""
    wanted = frames(spark, sf_dir).select("clip_id").distinct().withColumn("expected", F.col("clip_id") % 7 + 2)
    return fr.segmentation_status(wanted, found_segments(spark, sf_dir), "clip_id", "expected")


@plan(
    "win25_energy_quality",
    with_ctes(FRAMES_SQL)
    + """SELECT clip_id, max(t_us) - min(t_us) AS duration, round(sqrt(avg(energy * energy)), 6) AS rms, round(max(abs(energy)), 6) AS peak,
  round(avg(CASE WHEN abs(energy) > 100 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS clipped_ratio, true AS finite, max(abs(energy)) <= 0 AS silent FROM fr GROUP BY clip_id""",
)
def _win25(spark, sf_dir):
    """WIN25: energy quality per clip."""
    return fr.energy_quality(frames(spark, sf_dir), "clip_id", "t_us", "energy", clipped_above=100)


@plan(
    "agg9_stress_rates",
    C
    + """SELECT split, count(*) AS utterances, round(sum(window_count * 2.0) / 3600.0, 6)::DOUBLE AS total_audio_hours, CAST(sum(window_count) AS BIGINT) AS total_windows,
  CAST(sum(evaluated_candidate_count) AS BIGINT) AS stage1_candidates, count(*) FILTER (WHERE final_trigger AND label = 0) AS final_false_accepts,
  round(sum(evaluated_candidate_count)::DOUBLE / (sum(window_count * 2.0)::DOUBLE / 3600.0::DOUBLE), 6) AS candidates_per_hour,
  round((count(*) FILTER (WHERE final_trigger AND label = 0))::DOUBLE / (sum(window_count * 2.0)::DOUBLE / 3600.0::DOUBLE), 6) AS false_accepts_per_hour,
  round(sum(evaluated_candidate_count)::DOUBLE / sum(window_count)::DOUBLE, 6) AS candidate_rate FROM cc GROUP BY ROLLUP (split)""",
)
def _agg9(spark, sf_dir):
    """AGG9: rates per hour overall and per split."""
    rows = cascaded(spark, sf_dir).withColumn("seconds", F.col("window_count") * 2.0)
    return mt.rates_per_hour(
        rows,
        ["split"],
        seconds="seconds",
        windows="window_count",
        candidates="evaluated_candidate_count",
        accepted=F.col("final_trigger") & (F.col("label") == 0),
    )


HISTORY_SQL = """hi AS (SELECT speaker, d AS epoch, avg(k) AS val_score FROM w GROUP BY ALL), sz AS (SELECT speaker, count(*) AS train_rows, 16 AS batch_size, 29 AS configured_epochs FROM w GROUP BY speaker),
hr AS (SELECT speaker, count(*) AS epochs_completed, max(epoch) AS final_epoch, max(val_score) AS best_score FROM hi GROUP BY speaker),
hb AS (SELECT hi.speaker, min(epoch) AS best_epoch FROM hi JOIN hr ON hr.speaker = hi.speaker AND val_score = best_score GROUP BY 1)"""


def history(spark, sf_dir):
    w = windows(spark, sf_dir)
    runs = w.groupBy("speaker", F.col("d").alias("epoch")).agg(F.avg("k").alias("val_score"))
    sizes = w.groupBy("speaker").agg(F.count(F.lit(1)).alias("train_rows"))
    sizes = sizes.withColumns({"batch_size": F.lit(16), "configured_epochs": F.lit(29)})
    return fr.training_history(runs, ["speaker"], "epoch", "val_score", sizes)


@plan(
    "agg22_training_history",
    W
    + f""", {HISTORY_SQL} SELECT speaker, epochs_completed, final_epoch, best_epoch, round(best_score, 6) AS best_score, CAST(ceil(train_rows / 16.0) AS BIGINT) AS steps_per_epoch,
  CAST(ceil(train_rows / 16.0) AS BIGINT) * epochs_completed AS total_steps, final_epoch < 29 AS stopped_early FROM sz JOIN hr USING (speaker) JOIN hb USING (speaker)""",
)
def _agg22(spark, sf_dir):
    """AGG22: epochs, best epoch, steps and early stopping per run."""
    return history(spark, sf_dir).drop("train_rows", "batch_size", "configured_epochs")


@plan(
    "agg22_median_epoch",
    W
    + f""", {HISTORY_SQL}, o AS (SELECT best_epoch, row_number() OVER (ORDER BY best_epoch) - 1 AS i, count(*) OVER () AS n FROM hb)
SELECT CAST(greatest(1, least(20, round_even((max(best_epoch) FILTER (WHERE i = (n - 1) // 2) + max(best_epoch) FILTER (WHERE i = n // 2)) / 2.0::DOUBLE, 0))) AS INT) AS epochs FROM o""",
)
def _agg22_median(spark, sf_dir):
    """AGG22: clamped median of the best epochs."""
    return fr.median_epoch(history(spark, sf_dir).select("best_epoch"), "best_epoch")
