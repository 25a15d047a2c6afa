"""Cascade and metric plans over the scored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as cs
from ..operators import metrics as mt
from .bindings import CASCADE_SQL, GROUPS, WINDOWS_SQL, stage1, stage2, window_table, windows, with_ctes
from .registry import counts_sql, metric_sql, plan

T1, T2, K = 0.4, 0.25, 3
W = with_ctes(WINDOWS_SQL)
C = with_ctes(WINDOWS_SQL, CASCADE_SQL)
POSITIVES = {k: GROUPS[k] for k in ("P1", "P2", "P3")}
KEEP = ("label", "prompt_group", "speaker", "phrase_id", "fold", "split")


def cascaded(spark, sf_dir):
    w = window_table(spark, sf_dir)
    return cs.clip_cascade(stage1(w), stage2(w), T1, T2, top_k=K, keep=KEEP)


# --- joins -------------------------------------------------------------------


@plan(
    "jn1_window_cascade",
    W
    + """
SELECT clip_id, window_index, label, stage1_score::DOUBLE AS s1x, round(stage1_score, 6) AS stage1_score,
  round(stage2_score, 6) AS stage2_score, stage1_score >= 0.4 AS candidate,
  stage1_score >= 0.4 AND stage2_score >= 0.25 AS final_trigger
FROM s1 JOIN s2 USING (clip_id, window_index)""".replace(" stage1_score::DOUBLE AS s1x,", ""),
)
def _jn1(spark, sf_dir):
    """JN1: inner join of both stages on (clip, window)."""
    w = windows(spark, sf_dir)
    out = cs.window_cascade(stage1(w), stage2(w), T1, T2)
    return out.select("clip_id", "window_index", "label", "stage1_score", "stage2_score", "candidate", "final_trigger")


@plan(
    "jn2_ranked_left_join",
    C + "SELECT clip_id, CAST(rank AS BIGINT) AS rank, window_index, round(stage2_score, 6) AS stage2_score, accepted FROM tried",
)
def _jn2(spark, sf_dir):
    """JN2: stage 2 joined after ranking; a missing row keeps its slot."""
    w = windows(spark, sf_dir)
    ranked = cs.top_candidates(stage1(w), T1, K).join(stage2(w), ["clip_id", "window_index"], "left")
    accepted = F.coalesce(F.col("stage2_score") >= T2, F.lit(False)).alias("accepted")
    return ranked.select("clip_id", F.col("rank").cast("long").alias("rank"), "window_index", "stage2_score", accepted)


@plan(
    "jn3_enriched_predictions",
    W
    + """
SELECT s.clip_id, s.window_index, round(s.stage2_score, 6) AS stage2_score,
  round(m.window_start_sec, 6) AS window_start_sec, round(m.window_end_sec, 6) AS window_end_sec, m.content_hash
FROM s2 s LEFT JOIN (SELECT * FROM w WHERE split <> 'train') m USING (clip_id, window_index)""",
)
def _jn3(spark, sf_dir):
    """JN3: predictions filled from a manifest that lacks the training split."""
    w = windows(spark, sf_dir)
    manifest = w.where(F.col("split") != "train")
    fill = ["window_start_sec", "window_end_sec", "content_hash"]
    return cs.enrich(stage2(w), manifest, ["clip_id", "window_index"], fill)


@plan(
    "jn4_strict_lookup",
    W
    + """
SELECT split, count(*) AS rows, count(s2.clip_id) AS matched, count(*) - count(s2.clip_id) AS missing
FROM s1 LEFT JOIN s2 USING (clip_id, window_index) GROUP BY split""",
)
def _jn4(spark, sf_dir):
    """JN4: matched and missing rows of a strict (clip, window) lookup."""
    w = windows(spark, sf_dir)
    matched, missing = cs.strict_lookup(stage1(w), stage2(w), ["clip_id", "window_index"])
    tagged = matched.select("split", F.lit(1).alias("m")).unionByName(missing.select("split", F.lit(0).alias("m")))
    return tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("m").cast("long").alias("matched"),
        F.sum(1 - F.col("m")).cast("long").alias("missing"),
    )


@plan(
    "jn5_feature_coverage",
    W
    + """, a AS (SELECT clip_id, window_index FROM w WHERE event_type <> 'view'),
b AS (SELECT clip_id, window_index FROM s2)
SELECT split, count(*) AS windows, count(a.clip_id) AS stage1_covered, count(*) - count(a.clip_id) AS stage1_missing,
  count(*) FILTER (WHERE a.clip_id IS NOT NULL AND b.clip_id IS NOT NULL) AS stage2_covered,
  count(*) FILTER (WHERE a.clip_id IS NOT NULL AND b.clip_id IS NULL) AS stage2_missing
FROM w LEFT JOIN a USING (clip_id, window_index) LEFT JOIN b USING (clip_id, window_index) GROUP BY split""",
)
def _jn5(spark, sf_dir):
    """JN5: feature coverage of both stages per split."""
    w = windows(spark, sf_dir)
    one = w.where(F.col("event_type") != "view")
    return cs.feature_coverage(w, one, stage2(w), ["clip_id", "window_index"], ["split"])


# --- clip scores ---------------------------------------------------------------


@plan(
    "win1_first_window",
    W
    + """SELECT clip_id, count(*) AS window_count, arg_min(label, window_index) AS label,
  arg_min(content_hash, window_index) AS content_hash, arg_min(event_id, window_index) AS event_id
FROM w GROUP BY clip_id""",
)
def _win1(spark, sf_dir):
    """WIN1: first window of every clip and its window count."""
    out = cs.first_windows(windows(spark, sf_dir), keep=["label", "content_hash", "event_id"])
    return out.select("clip_id", "window_count", "label", "content_hash", "event_id")


@plan(
    "win3_clip_scores",
    W
    + """, b AS (SELECT clip_id, any_value(label) AS label, count(*) AS window_count, max(stage1_score) AS score,
  arg_max(window_index, stage1_score * 1000000 - window_index / 1000.0) AS candidate_window_index FROM s1 GROUP BY clip_id)
SELECT clip_id, label, window_count, round(score, 6) AS score, candidate_window_index,
  round(candidate_window_index * 0.25, 6)::DOUBLE AS candidate_window_start_sec, score >= 0.4 AS stage1_candidate FROM b""",
)
def _win3(spark, sf_dir):
    """WIN3: clip score and its arg-max window."""
    out = cs.clip_scores(stage1(windows(spark, sf_dir)), T1, keep=["label"])
    return out.drop("candidate_window_end_sec")


@plan(
    "win4_clip_cascade",
    C
    + """SELECT clip_id, label, prompt_group, speaker, window_count, round(stage1_clip_score, 6) AS stage1_clip_score,
  stage1_candidate, evaluated_candidate_count, winning_window_index,
  round(stage2_candidate_score, 6)::DOUBLE AS stage2_candidate_score, final_trigger FROM cc""",
)
def _win4(spark, sf_dir):
    """WIN4: two-stage top-k cascade per clip."""
    return cascaded(spark, sf_dir).drop("candidate_windows", "score", "phrase_id", "fold", "split")


@plan(
    "win4_diagnostics",
    C
    + """SELECT clip_id, CAST(rank AS BIGINT) AS rank, window_index, round(stage1_score, 6) AS stage1_score,
  round(stage2_score, 6) AS stage2_score, accepted FROM tried""",
)
def _win4_diagnostics(spark, sf_dir):
    """WIN4: the diagnostics array of each clip, flattened."""
    item = cascaded(spark, sf_dir).select("clip_id", F.explode("candidate_windows").alias("i"))
    cols = ["window_index", "stage1_score", "stage2_score", "accepted"]
    return item.select("clip_id", F.col("i.rank").cast("long").alias("rank"), *[F.col(f"i.{c}").alias(c) for c in cols])


@plan(
    "win5_fused_scores",
    W
    + """, j AS (SELECT s1.*, s2.stage2_score FROM s1 JOIN s2 USING (clip_id, window_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY stage1_score DESC, window_index) AS rank,
  least(greatest(stage1_score, 1e-6), 1 - 1e-6) AS c1, least(greatest(stage2_score, 1e-6), 1 - 1e-6) AS c2
  FROM j WHERE stage1_score >= 0.4 QUALIFY rank <= 3),
f AS (SELECT *, 1.5 * ln(c2 / (1 - c2)) + 0.5 * ln(c1 / (1 - c1)) AS fused FROM r),
b AS (SELECT clip_id, max(fused) AS fused, count(*) AS n FROM f GROUP BY clip_id),
c AS (SELECT clip_id, count(*) AS window_count, max(stage1_score) AS m, any_value(label) AS label FROM j GROUP BY clip_id)
SELECT c.clip_id, label, window_count, round(m, 6) AS stage1_clip_score, n IS NOT NULL AS stage1_candidate,
  coalesce(n, 0) AS evaluated_candidate_count, round(coalesce(fused, -1e9), 6)::DOUBLE AS score
FROM c LEFT JOIN b USING (clip_id)""",
)
def _win5(spark, sf_dir):
    """WIN5: logit fusion of both stages, best of the top-k windows."""
    w = windows(spark, sf_dir)
    out = cs.fused_clip_scores(stage1(w), stage2(w), T1, top_k=K, a=1.5, b=0.5, use_logit=True, keep=["label"])
    return out.drop("stage2_candidate_score", "winning_window_index")


@plan(
    "win26_prefix_scores",
    W
    + """, r AS (SELECT clip_id, window_index, max(stage1_score) OVER p AS running_score,
  arg_max(window_index, stage1_score * 1000000 - window_index / 1000.0) OVER p AS running_index
  FROM s1 WINDOW p AS (PARTITION BY clip_id ORDER BY window_index ROWS UNBOUNDED PRECEDING))
SELECT clip_id, window_index, round(running_score, 6) AS running_score, running_index FROM r""",
)
def _win26(spark, sf_dir):
    """WIN26: running maximum over a clip's window prefix."""
    out = cs.prefix_scores(stage1(windows(spark, sf_dir)))
    return out.select("clip_id", "window_index", "running_score", "running_index")


# --- metrics -------------------------------------------------------------------

CONF = counts_sql("label", "final_trigger")


@plan(
    "agg1_confusion_metrics",
    C + f", x AS (SELECT split, count(*) AS n, {CONF} FROM cc GROUP BY split) SELECT split, n, tp, tn, fp, fn, {metric_sql()} FROM x",
)
def _agg1(spark, sf_dir):
    """AGG1: confusion metrics of the clip cascade per split."""
    return mt.confusion(cascaded(spark, sf_dir), ["split"], "label", F.col("final_trigger"))


@plan(
    "agg2_ranking_metrics",
    W
    + """, h AS (SELECT split, stage1_score AS s, sum(label) AS pos, sum(1 - label) AS neg FROM w GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER p AS tp, sum(neg) OVER p AS fp FROM h WINDOW p AS (PARTITION BY split ORDER BY s DESC)),
x AS (SELECT split, sum(pos) AS p, sum(neg) AS n, sum(neg * (tp - pos / 2.0::DOUBLE)) AS a,
  sum(pos * tp / (tp + fp)::DOUBLE) AS st FROM c GROUP BY split)
SELECT split, CAST(p AS BIGINT) AS positive, CAST(n AS BIGINT) AS negative, round(a / (p * n)::DOUBLE, 6) AS auroc,
  round(st / p::DOUBLE, 6) AS auprc FROM x""",
)
def _agg2(spark, sf_dir):
    """AGG2: exact AUROC and average precision of the stage-1 score."""
    return mt.ranking_metrics(windows(spark, sf_dir), ["split"], "label", "stage1_score")


@plan(
    "agg3_metric_breakdowns",
    C
    + f""", x AS (SELECT 'all' AS level, '' AS value, count(*) AS n, {CONF} FROM cc UNION ALL
SELECT 'prompt_group', prompt_group, count(*), {CONF} FROM cc GROUP BY prompt_group UNION ALL
SELECT 'negative_phrase', phrase_id, count(*), {CONF} FROM cc WHERE label = 0 GROUP BY phrase_id)
SELECT level, value, n, tp, tn, fp, fn, {metric_sql()} FROM x""",
)
def _agg3(spark, sf_dir):
    """AGG3: metrics overall, per prompt group and per negative phrase."""
    return mt.breakdowns(cascaded(spark, sf_dir), "label", "final_trigger", "prompt_group", "phrase_id")


@plan(
    "agg3_prompt_cells",
    C
    + """SELECT """
    + ", ".join(
        f"round(count(*) FILTER (WHERE prompt_group = '{g}' AND label = 1 AND final_trigger) / nullif(count(*) FILTER "
        f"(WHERE prompt_group = '{g}' AND label = 1), 0)::DOUBLE, 6) AS {n}_recall"
        for n, g in POSITIVES.items()
    )
    + """, round(count(*) FILTER (WHERE prompt_group = 'P4_negative' AND label = 0 AND final_trigger) /
nullif(count(*) FILTER (WHERE prompt_group = 'P4_negative' AND label = 0), 0)::DOUBLE, 6) AS P4_false_positive_rate FROM cc""",
)
def _agg3_cells(spark, sf_dir):
    """AGG3: recall of the three positive groups and FPR of the negative one."""
    return mt.prompt_cells(cascaded(spark, sf_dir), "label", "final_trigger", "prompt_group", POSITIVES, GROUPS["P4"])


MACRO = ", ".join(f"round(avg({r}), 6) AS macro_{r}" for r in ("precision", "recall", "false_positive_rate", "f1"))
PER_SPEAKER = f"u AS (SELECT split, speaker, {CONF} FROM cc GROUP BY ALL), v AS (SELECT *, {metric_sql(digits=15)} FROM u)"


@plan(
    "agg4_participant_macro",
    C + f", {PER_SPEAKER} SELECT split, count(*) AS participants, {MACRO} FROM v GROUP BY split",
)
def _agg4(spark, sf_dir):
    """AGG4: participant macro metrics, null rates left out."""
    return mt.macro(cascaded(spark, sf_dir), ["split"], "speaker", "label", F.col("final_trigger"))


@plan(
    "agg5_paired_delta",
    C
    + f""", u AS (SELECT speaker, {counts_sql('label', 'stage1_candidate', 'a_')}, {counts_sql('label', 'final_trigger', 'b_')}
  FROM cc GROUP BY speaker),
v AS (SELECT {metric_sql('a_', 15, ('f1',))}, {metric_sql('b_', 15, ('f1',))} FROM u),
d AS (SELECT b_f1 - a_f1 AS delta FROM v WHERE b_f1 - a_f1 IS NOT NULL),
o AS (SELECT delta, row_number() OVER (ORDER BY delta) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT count(*) AS n_pairs, round(avg(delta), 6) AS mean_delta_f1, count(*) FILTER (WHERE delta > 1e-12) AS improved,
  count(*) FILTER (WHERE delta < -1e-12) AS degraded, count(*) FILTER (WHERE abs(delta) <= 1e-12) AS unchanged,
  round(max(delta) FILTER (WHERE i = n // 2), 6) AS median_delta_f1 FROM o""",
)
def _agg5(spark, sf_dir):
    """AGG5: paired F1 change from stage 1 alone to the full cascade."""
    cc = cascaded(spark, sf_dir)
    return mt.paired_delta(cc, [], "speaker", "label", F.col("stage1_candidate"), F.col("final_trigger"))


@plan(
    "agg6_fold_mean_std",
    C
    + f""", u AS (SELECT fold, {CONF} FROM cc GROUP BY fold), v AS (SELECT {metric_sql(digits=15)} FROM u) SELECT """
    + ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(CASE WHEN count({m}) = 1 THEN 0.0 ELSE stddev_samp({m}) END, 6) AS {m}_std"
        for m in ("precision", "recall", "false_positive_rate", "f1")
    )
    + " FROM v",
)
def _agg6(spark, sf_dir):
    """AGG6: mean and deviation of fold metrics."""
    per_fold = mt.confusion(cascaded(spark, sf_dir), ["fold"], "label", F.col("final_trigger"))
    return mt.mean_std(per_fold, [], ["precision", "recall", "false_positive_rate", "f1"])


METHODS_SQL = """m AS (SELECT 'stage1_only' AS method, label, speaker, prompt_group, stage1_candidate AS decision FROM cc
UNION ALL SELECT 'cascade', label, speaker, prompt_group, final_trigger FROM cc)"""


def methods(cc):
    """Long form: one row per clip and method, built without a second scan."""
    options = F.array(
        F.struct(F.lit("stage1_only").alias("method"), F.col("stage1_candidate").alias("decision")),
        F.struct(F.lit("cascade").alias("method"), F.col("final_trigger").alias("decision")),
    )
    return cc.select("label", "speaker", "prompt_group", F.inline(options))


@plan(
    "agg7_pooled_and_macro",
    C
    + f""", {METHODS_SQL}, u AS (SELECT method, speaker, {counts_sql('label', 'decision')} FROM m GROUP BY ALL),
v AS (SELECT *, {metric_sql(digits=15)} FROM u),
p AS (SELECT method, count(*) AS participants, {MACRO}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn,
  CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM v GROUP BY method)
SELECT *, {metric_sql(only=('precision', 'recall', 'false_positive_rate', 'f1'))} FROM p""",
)
def _agg7(spark, sf_dir):
    """AGG7: pooled and macro metrics per method."""
    return mt.pooled_and_macro(methods(cascaded(spark, sf_dir)), ["method"], "speaker", "label", F.col("decision"))


ERROR_SQL = """e AS (SELECT *, CASE WHEN label = 1 AND final_trigger THEN NULL WHEN label = 1 AND NOT stage1_candidate THEN 'STAGE1_MISS'
WHEN label = 1 THEN 'STAGE2_REJECT' WHEN final_trigger THEN 'FINAL_FALSE_ACCEPT'
WHEN stage1_candidate THEN 'STAGE1_FALSE_CANDIDATE' END AS error FROM cc)"""


def with_errors(cc):
    return cc.withColumn("error", mt.stage_error(F.col("label"), F.col("stage1_candidate"), F.col("final_trigger")))


@plan(
    "agg21_stage_errors",
    C
    + f""", {ERROR_SQL} SELECT 'class' AS level, error AS error_type, '' AS value, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'class_group', error, prompt_group, count(*) FROM e WHERE error IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'class_unit', error, CAST(speaker AS VARCHAR), count(*) FROM e WHERE error IS NOT NULL GROUP BY ALL""",
)
def _agg21(spark, sf_dir):
    """AGG21: stage-error counts by class, group and participant."""
    return mt.stage_error_counts(with_errors(cascaded(spark, sf_dir)), "error", "prompt_group", "speaker")


@plan(
    "agg21_false_reject_share",
    C
    + f""", {ERROR_SQL}, x AS (SELECT count(*) FILTER (WHERE error = 'STAGE1_MISS') AS a, count(*) FILTER (WHERE error = 'STAGE2_REJECT') AS b FROM e)
SELECT a AS stage1_misses, b AS stage2_rejects, round(a / nullif(a + b, 0)::DOUBLE, 6) AS stage1_share,
  round(b / nullif(a + b, 0)::DOUBLE, 6) AS stage2_share FROM x""",
)
def _agg21_share(spark, sf_dir):
    """AGG21: which stage loses the missed positives."""
    return mt.false_reject_share(with_errors(cascaded(spark, sf_dir)), "error")


@plan(
    "agg24_score_parity",
    W
    + """SELECT count(*) AS n, round(max(abs(s2.stage2_score - s2b.stage2_score)), 6) AS max_abs_difference,
  max(abs(s2.stage2_score - s2b.stage2_score)) <= 0.000001 AS within_tolerance
FROM s2 JOIN s2b USING (clip_id, window_index)""",
)
def _agg24(spark, sf_dir):
    """AGG24: largest score difference between two runs."""
    w = windows(spark, sf_dir)
    return cs.score_parity(stage2(w), stage2(w, "b"), ["clip_id", "window_index"], "stage2_score", 1e-6)
