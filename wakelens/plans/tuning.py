"""Threshold, configuration and model-choice plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as cs
from ..operators import config_search as cf
from ..operators import metrics as mt
from ..operators import selection as sl
from ..operators import thresholds as th
from ..session import cut
from .bindings import CASCADE_SQL, GROUPS, WINDOWS_SQL, stage1, stage2, window_table, windows, with_ctes
from .registry import counts_sql, metric_sql, plan
from .scoring import C, W, cascaded

BASE = ("recall", "precision", "false_positive_rate", "f1")


def sweep_sql(src: str, keys: str, score: str, *, grid: int = 101, span: str = "unit", floor: str = "", tag: str = "") -> str:
    """CTEs ending in ``swept{tag}``: counts and raw rates per threshold."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    at = (
        f"i * (1.0::DOUBLE / {grid - 1})"
        if span == "unit"
        else f"CASE WHEN i = {grid - 1} THEN hi ELSE lo + i * ((hi - lo) / {grid - 1}.0::DOUBLE) END"
    )
    cond = f"WHERE threshold > {floor}" if floor else ""
    return f"""
h{tag} AS (SELECT {keys}, {score} AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY ALL),
l{tag} AS (SELECT {keys}, min(threshold) AS lo, max(threshold) AS hi FROM h{tag} {cond} GROUP BY ALL),
g{tag} AS (SELECT {keys}, {at} AS threshold, 0 AS pos, 0 AS neg FROM l{tag}, range({grid}) r(i)),
u{tag} AS (SELECT {keys}, threshold, sum(pos) AS pos, sum(neg) AS neg FROM
  (SELECT {keys}, threshold, pos, neg FROM h{tag} UNION ALL SELECT {keys}, threshold, pos, neg FROM g{tag}) GROUP BY ALL),
c{tag} AS (SELECT *, CAST(sum(pos) OVER q AS BIGINT) AS tp, CAST(sum(neg) OVER q AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY {keys}) AS BIGINT) AS ap, CAST(sum(neg) OVER (PARTITION BY {keys}) AS BIGINT) AS an
  FROM u{tag} WINDOW q AS (PARTITION BY {keys} ORDER BY threshold DESC)),
d{tag} AS (SELECT *, ap - tp AS fn, an - fp AS tn FROM c{tag} {cond}),
swept{tag} AS (SELECT *, {metric_sql(digits=17, only=BASE)} FROM d{tag})"""


RECALL_FIRST_ORDER = """CASE WHEN recall >= {t} THEN 0 ELSE 1 END, CASE WHEN recall >= {t} THEN 0 ELSE -coalesce(recall, -1) END,
coalesce(false_positive_rate, 1.0), CASE WHEN recall >= {t} THEN 0 ELSE -coalesce(f1, -1) END,
CASE WHEN recall >= {t} THEN -threshold ELSE threshold END"""
PRECISE_ORDER = """CASE WHEN recall >= {t} THEN 0 ELSE 1 END, CASE WHEN recall >= {t} THEN 0 ELSE -coalesce(recall, -1) END,
coalesce(false_positive_rate, 1.0), CASE WHEN recall >= {t} THEN -coalesce(precision, 0) ELSE -coalesce(f1, -1) END,
CASE WHEN recall >= {t} THEN -coalesce(f1, 0) ELSE 0 END, -threshold"""
SAFE_ORDER = """CASE WHEN false_positive_rate <= 0.01 THEN 0 WHEN false_positive_rate <= 0.02 THEN 1 ELSE 2 END,
CASE WHEN false_positive_rate <= 0.02 THEN 0 ELSE coalesce(false_positive_rate, 1.0) END, -coalesce(f1, -1), -coalesce(recall, -1),
CASE WHEN false_positive_rate <= 0.02 THEN -coalesce(precision, -1) ELSE 0 END,
CASE WHEN false_positive_rate <= 0.02 THEN coalesce(false_positive_rate, 1.0) ELSE 0 END,
CASE WHEN false_positive_rate <= 0.02 THEN -threshold ELSE threshold END"""


def chosen_sql(keys: str, order: str, *, tag: str = "", name: str = "chosen") -> str:
    return f"""{name} AS (SELECT * FROM swept{tag} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)"""


SHOWN = "round(threshold, 6) AS threshold, tp, tn, fp, fn, " + ", ".join(f"round({m}, 6) AS {m}" for m in BASE)
REASON = "CASE WHEN ap = 0 THEN 'no_validation_positives' WHEN recall >= {t} THEN 'met_recall_target' ELSE 'recall_target_not_achievable' END AS reason"


@plan(
    "win13_recall_first_threshold",
    C
    + f""", {sweep_sql('cc', 'fold', 'stage1_clip_score')}, {chosen_sql('fold', RECALL_FIRST_ORDER.format(t=0.9))}
SELECT fold, {SHOWN}, {REASON.format(t=0.9)} FROM chosen""",
)
def _win13(spark, sf_dir):
    """WIN13: recall-first threshold of the stage-1 clip score per fold."""
    curve = th.sweep(cascaded(spark, sf_dir), ["fold"], "label", "stage1_clip_score")
    return th.recall_first(curve, ["fold"], 0.9)


@plan(
    "win13_unreachable_target",
    C
    + f""", {sweep_sql('cc', 'fold', 'stage2_candidate_score', grid=401, span='data')},
{chosen_sql('fold', PRECISE_ORDER.format(t=1.5))}
SELECT fold, {SHOWN}, {REASON.format(t=1.5)} FROM chosen""",
)
def _win13_unreachable(spark, sf_dir):
    """WIN13: a target no threshold meets, and the precise tie-break."""
    curve = th.sweep(cascaded(spark, sf_dir), ["fold"], "label", "stage2_candidate_score", grid=401, span="data")
    return th.recall_first(curve, ["fold"], 1.5, precise=True)


@plan(
    "win14_safe_f1_threshold",
    C
    + f""", {sweep_sql('cc', 'fold', 'stage2_candidate_score', grid=401, span='data')}, {chosen_sql('fold', SAFE_ORDER)}
SELECT fold, {SHOWN}, CASE WHEN false_positive_rate <= 0.01 THEN 'preferred_fpr' WHEN false_positive_rate <= 0.02
THEN 'allowed_fpr' ELSE 'unsafe' END AS safety_band FROM chosen""",
)
def _win14(spark, sf_dir):
    """WIN14: best F1 under the false-positive limits."""
    curve = th.sweep(cascaded(spark, sf_dir), ["fold"], "label", "stage2_candidate_score", grid=401, span="data")
    return th.safe_f1(curve, ["fold"])


CUT_SQL = """cut AS (SELECT fold, stage1_clip_score AS s, sum(sum(label)) OVER (PARTITION BY fold ORDER BY stage1_clip_score DESC) AS tp,
  sum(sum(label)) OVER (PARTITION BY fold) AS p FROM cc GROUP BY fold, stage1_clip_score),
cuts AS (SELECT fold, max(s) FILTER (WHERE tp / p::DOUBLE >= 0.9) AS threshold FROM cut GROUP BY fold)"""


@plan("win15_recall_cut", C + f", {CUT_SQL} SELECT fold, round(threshold, 6) AS threshold FROM cuts")
def _win15(spark, sf_dir):
    """WIN15: first score, descending, that reaches the recall target."""
    return th.recall_cut(cascaded(spark, sf_dir), ["fold"], "label", "stage1_clip_score", 0.9)


@plan(
    "agg23_threshold_audit",
    C
    + f""", {CUT_SQL}, {sweep_sql('cc', 'fold', 'stage1_clip_score')}, {chosen_sql('fold', RECALL_FIRST_ORDER.format(t=0.9))},
{chosen_sql('fold', RECALL_FIRST_ORDER.format(t=0.8), name='reported')}
SELECT fold, round(k.threshold, 6) AS stored_threshold, round(r.threshold, 6) AS metrics_threshold,
  round(c.threshold, 6) AS recomputed, abs(k.threshold - c.threshold) < 1e-9 AS matches_stored,
  abs(r.threshold - k.threshold) < 1e-9 AS matches_metrics
FROM cuts k JOIN reported r USING (fold) JOIN chosen c USING (fold)""",
)
def _agg23(spark, sf_dir):
    """AGG23: stored and reported thresholds against recomputed ones."""
    cc = cascaded(spark, sf_dir)
    curve = th.sweep(cc, ["fold"], "label", "stage1_clip_score")
    kept = th.recall_cut(cc, ["fold"], "label", "stage1_clip_score", 0.9).withColumnRenamed("threshold", "stored_threshold")
    reported = th.recall_first(curve, ["fold"], 0.8).select("fold", F.col("threshold").alias("metrics_threshold"))
    return th.threshold_audit(th.recall_first(curve, ["fold"], 0.9), kept.join(reported, "fold"), ["fold"])


# --- validation and test roles ---------------------------------------------------

FOLDS = 5


def roles(clips):
    """Each clip as test of its own fold and as dev of the fold before it."""
    previous = F.pmod(F.col("fold") + (FOLDS - 1), F.lit(FOLDS)).cast("int")
    options = F.array(
        F.struct(F.col("fold").alias("outer"), F.lit("test").alias("role")),
        F.struct(previous.alias("outer"), F.lit("dev").alias("role")),
    )
    rest = [c for c in clips.columns if c != "fold"]
    return clips.select(*rest, F.inline(options)).withColumnRenamed("outer", "fold")


def role_sql(src: str, cols: str) -> str:
    return f"(SELECT {cols}, fold, 'test' AS role FROM {src} UNION ALL SELECT {cols}, (fold + 4) % 5, 'dev' FROM {src})"


TARGETS = (0.85, 0.9, 0.95)


def both_variants(spark, sf_dir):
    """Window scores of both stage-2 variants in long form."""
    options = F.array(
        F.struct(F.lit("a").alias("variant"), F.col("stage2_score").alias("s2")),
        F.struct(F.lit("b").alias("variant"), F.col("stage2_score_b").alias("s2")),
    )
    cols = ["clip_id", "window_index", "label", "fold", "prompt_group", "stage1_score"]
    scored = windows(spark, sf_dir).where(F.col("event_type") != "error")
    w = cut(scored.select(*cols, "stage2_score", "stage2_score_b"))
    return w.select(*cols, F.inline(options)).withColumnRenamed("s2", "stage2_score")


VARIANTS_SQL = """vw AS (SELECT clip_id, window_index, label, fold, prompt_group, stage1_score, 'a' AS variant, stage2_score FROM w WHERE event_type <> 'error'
UNION ALL SELECT clip_id, window_index, label, fold, prompt_group, stage1_score, 'b', stage2_score_b FROM w WHERE event_type <> 'error'),
vr AS (SELECT *, row_number() OVER (PARTITION BY variant, clip_id ORDER BY stage1_score DESC, window_index) AS rank FROM vw WHERE stage1_score >= 0.4),
vc AS (SELECT variant, clip_id, any_value(label) AS label, any_value(fold) AS fold, any_value(prompt_group) AS prompt_group FROM vw GROUP BY ALL)"""


def variant_scores(spark, sf_dir):
    """Plain stage-2 clip score (depth 3) per variant with its roles."""
    found = cf.clip_candidates(both_variants(spark, sf_dir), 0.4, 3, ["variant", "clip_id"], ["label", "fold", "prompt_group"])
    keep = ["variant", "label", "fold", "prompt_group"]
    return roles(cf.configured_scores(found, [(3, 1.0, 0.0, False)], keep))


SCORES_SQL = f"""{VARIANTS_SQL},
vs AS (SELECT c.variant, c.label, c.fold, c.prompt_group, coalesce(m.score, -1e9)::DOUBLE AS score FROM vc c LEFT JOIN
  (SELECT variant, clip_id, max(stage2_score) AS score FROM vr WHERE rank <= 3 GROUP BY ALL) m USING (variant, clip_id)),
rs AS {role_sql('vs', 'variant, label, prompt_group, score')},
dev AS (SELECT * FROM rs WHERE role = 'dev'), test AS (SELECT * FROM rs WHERE role = 'test')"""


def operating_points(spark, sf_dir):
    scores = variant_scores(spark, sf_dir)
    keys = ["variant", "fold"]
    dev = scores.where(F.col("role") == "dev")
    curve = th.sweep(dev, keys, "label", "score", grid=401, span="data", floor=-1.0e8)
    goals = curve.withColumn("recall_target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))
    return scores, th.recall_first(goals, [*keys, "recall_target"], F.col("recall_target"), precise=True)


@plan(
    "win16_operating_points",
    W
    + f""", {SCORES_SQL}, {sweep_sql('dev', 'variant, fold', 'score', grid=401, span='data', floor='-1e8')},
goals AS (SELECT * FROM swept, (VALUES (0.85::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) t(recall_target)),
picked AS (SELECT * FROM goals QUALIFY row_number() OVER (PARTITION BY variant, fold, recall_target ORDER BY {PRECISE_ORDER.format(t='recall_target')}) = 1),
tested AS (SELECT p.variant, p.fold, p.recall_target, {counts_sql('t.label', 't.score >= p.threshold')}
  FROM picked p JOIN test t USING (variant, fold) GROUP BY ALL),
tm AS (SELECT variant, fold, recall_target, {metric_sql(only=BASE)} FROM tested)
SELECT p.variant, p.fold, recall_target, round(p.threshold, 6) AS threshold, round(p.recall, 6) AS dev_recall,
  round(p.false_positive_rate, 6) AS dev_false_positive_rate, round(p.f1, 6) AS dev_f1, t.recall AS test_recall,
  t.false_positive_rate AS test_false_positive_rate, t.precision AS test_precision, t.f1 AS test_f1
FROM picked p JOIN tm t USING (variant, fold, recall_target)""",
)
def _win16(spark, sf_dir):
    """WIN16: thresholds per (variant, fold, target) on dev, shown on test."""
    scores, chosen = operating_points(spark, sf_dir)
    keys = ["variant", "fold", "recall_target"]
    dev = {f"dev_{m}": F.col(m) for m in ("recall", "false_positive_rate", "f1")}
    picks = chosen.select(*keys, "threshold", *[c.alias(n) for n, c in dev.items()])
    histogram = mt.score_histogram(scores.where(F.col("role") == "test"), ["variant", "fold"], "label", "score")
    joined = histogram.join(picks, ["variant", "fold"])
    hit = F.col("score") >= F.col("threshold")
    cells = {"tp": (hit, "pos"), "tn": (~hit, "neg"), "fp": (hit, "neg"), "fn": (~hit, "pos")}
    counts = joined.groupBy(*keys, "threshold", *dev).agg(
        *[F.sum(F.when(c, F.col(v)).otherwise(0)).alias(f"test_{n}") for n, (c, v) in cells.items()]
    )
    shown = ("recall", "false_positive_rate", "precision", "f1")
    return mt.with_rates(counts, "test_", shown).drop(*[f"test_{c}" for c in mt.COUNTS])


def searched(spark, sf_dir):
    found = cf.clip_candidates(both_variants(spark, sf_dir), 0.4, 8, ["variant", "clip_id"], ["label", "fold"])
    return cf.search(found, cf.config_grid(), roles)


SEARCH_SQL = f"""{VARIANTS_SQL},
cfg AS (SELECT k AS top_k, 1.0::DOUBLE AS fusion_a, 0.0::DOUBLE AS fusion_b, false AS use_logit FROM (VALUES (1), (3), (5), (8)) t(k)
UNION ALL SELECT k, a, b, true FROM (VALUES (3), (5), (8)) t(k), (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) u(a), (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) v(b)),
lg AS (SELECT *, least(greatest(stage1_score, 1e-6), 1 - 1e-6) AS c1, least(greatest(stage2_score, 1e-6), 1 - 1e-6) AS c2 FROM vr WHERE rank <= 8),
ms AS (SELECT variant, clip_id, top_k, fusion_a, fusion_b, use_logit, max(CASE WHEN use_logit THEN fusion_a * ln(c2 / (1 - c2)) + fusion_b * ln(c1 / (1 - c1)) ELSE stage2_score END) AS score
  FROM lg JOIN cfg ON rank <= top_k GROUP BY ALL),
vs AS (SELECT c.variant, g.top_k, g.fusion_a, g.fusion_b, g.use_logit, c.label, c.fold, coalesce(m.score, -1e9)::DOUBLE AS score
  FROM vc c CROSS JOIN cfg g LEFT JOIN ms m USING (variant, clip_id, top_k, fusion_a, fusion_b, use_logit)),
rs AS {role_sql('vs', 'variant, top_k, fusion_a, fusion_b, use_logit, label, score')},
dev AS (SELECT * FROM rs WHERE role = 'dev'),
{sweep_sql('dev', 'variant, top_k, fusion_a, fusion_b, use_logit, fold', 'score', grid=401, span='data', floor='-1e8')},
{chosen_sql('variant, top_k, fusion_a, fusion_b, use_logit, fold', SAFE_ORDER)},
pooled AS (SELECT r.variant, r.top_k, r.fusion_a, r.fusion_b, r.use_logit,
  {counts_sql("role = 'dev' AND r.label", 'score >= coalesce(p.threshold, 0.5)', 'dev_').replace("role = 'dev' AND r.label = ", "role = 'dev' AND r.label = ")},
  {counts_sql("role = 'test' AND r.label", 'score >= coalesce(p.threshold, 0.5)', 'test_')}
  FROM rs r LEFT JOIN chosen p USING (variant, top_k, fusion_a, fusion_b, use_logit, fold) GROUP BY ALL),
found AS (SELECT variant, top_k, fusion_a, fusion_b, use_logit, {metric_sql('dev_', 17, BASE)}, {metric_sql('test_', 17, BASE)},
  coalesce(dev_fp / nullif(dev_fp + dev_tn, 0)::DOUBLE <= 0.01, false) AS safe_preferred,
  coalesce(dev_fp / nullif(dev_fp + dev_tn, 0)::DOUBLE <= 0.02, false) AS safe_allowed FROM pooled)"""


@plan(
    "win17_config_search",
    W
    + f""", {SEARCH_SQL} SELECT variant, top_k, fusion_a, fusion_b, use_logit, safe_preferred, safe_allowed, """
    + ", ".join(f"round({p}{m}, 6) AS {p}{m}" for p in ("dev_", "test_") for m in BASE)
    + " FROM found",
)
def _win17(spark, sf_dir):
    """WIN17 and JN15: all 104 configurations, thresholds per fold."""
    return searched(spark, sf_dir)


CFG = "variant, top_k, fusion_a, fusion_b, use_logit"
NAMED = "variant DESC, top_k DESC, fusion_a DESC, fusion_b DESC, use_logit DESC"


@plan(
    "win17_selected_modes",
    W
    + f""", {SEARCH_SQL}, modes AS (
(SELECT 'balanced' AS mode, * FROM found WHERE safe_allowed ORDER BY safe_preferred DESC, coalesce(dev_f1, -1) DESC, coalesce(dev_recall, -1) DESC,
  coalesce(dev_false_positive_rate, 1.0), coalesce(dev_precision, -1) DESC, {NAMED} LIMIT 1) UNION ALL
(SELECT 'safe', * FROM found ORDER BY coalesce(dev_false_positive_rate, 1.0), coalesce(dev_recall, -1) DESC, {NAMED} LIMIT 1) UNION ALL
(SELECT 'high_recall', * FROM found WHERE safe_allowed ORDER BY coalesce(dev_recall, -1) DESC, coalesce(dev_f1, -1) DESC,
  coalesce(dev_false_positive_rate, 1.0), {NAMED} LIMIT 1))
SELECT mode, {CFG}, """
    + ", ".join(
        f"round({m}, 6) AS {m}" for m in ("dev_recall", "dev_false_positive_rate", "dev_f1", "test_recall", "test_f1")
    )
    + " FROM modes",
)
def _win17_modes(spark, sf_dir):
    """WIN17: balanced, safe and high-recall configuration."""
    return cf.pick_modes(searched(spark, sf_dir))


# --- model choice -----------------------------------------------------------------

TEST_METRICS = f"""x AS (SELECT variant, fold, {counts_sql('label', 'score >= 0.3')} FROM dev GROUP BY ALL), y AS (SELECT variant, fold, {metric_sql(digits=17, only=BASE)} FROM x)"""


@plan(
    "srt4_variant_choice",
    W
    + f""", {SCORES_SQL}, {TEST_METRICS}
SELECT fold, variant, round(recall, 6) AS recall, round(precision, 6) AS precision, round(false_positive_rate, 6) AS false_positive_rate,
  round(f1, 6) AS f1, coalesce(recall, -1) >= 0.7 AS meets_recall FROM y
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN coalesce(recall, -1) >= 0.7 THEN 0 ELSE 1 END,
  CASE WHEN coalesce(recall, -1) >= 0.7 THEN 0 ELSE -coalesce(recall, -1) END, coalesce(false_positive_rate, 1.0), precision DESC, f1 DESC) = 1""",
)
def _srt4(spark, sf_dir):
    """SRT4: lexicographic choice of the variant per fold on dev metrics."""
    dev = variant_scores(spark, sf_dir).where(F.col("role") == "dev")
    rated = mt.confusion(dev, ["variant", "fold"], "label", F.col("score") >= 0.3)
    shown = rated.select("fold", "variant", "recall", "precision", "false_positive_rate", "f1")
    return sl.choose_variant(shown, ["fold"], recall_target=0.7)


# --- out-of-fold thresholds ---------------------------------------------------------


def out_of_fold(rows):
    """Every row as development data of the four folds it is not tested in."""
    outer = F.explode(F.array(*[F.lit(i) for i in range(FOLDS)]))
    rest = [c for c in rows.columns if c != "fold"]
    return rows.withColumn("outer", outer).where(F.col("outer") != F.col("fold")).select(*rest, "outer")


OOF_SQL = f"""oof AS (SELECT label, stage1_score, stage2_score, CAST(o AS INT) AS outer_fold FROM s1 JOIN s2 USING (clip_id, window_index), range(5) r(o) WHERE o <> fold),
{sweep_sql('oof', 'outer_fold', 'stage1_score', tag='1')}, {chosen_sql('outer_fold', RECALL_FIRST_ORDER.format(t=0.95), tag='1', name='theta1')},
{sweep_sql('oof', 'outer_fold', 'stage2_score', tag='2')}, {chosen_sql('outer_fold', RECALL_FIRST_ORDER.format(t=0.9), tag='2', name='theta2')},
ths AS (SELECT outer_fold AS fold, a.threshold AS t1, b.threshold AS t2 FROM theta1 a JOIN theta2 b USING (outer_fold)),
oc AS (SELECT s1.*, t1, t2, row_number() OVER (PARTITION BY clip_id ORDER BY stage1_score DESC, window_index) AS rank
  FROM s1 JOIN ths USING (fold) WHERE stage1_score >= t1 QUALIFY rank <= 3),
ot AS (SELECT clip_id, bool_or(coalesce(stage2_score >= t2, false)) AS trig FROM oc LEFT JOIN s2 USING (clip_id, window_index) GROUP BY clip_id),
oz AS (SELECT c.fold, c.label, coalesce(o.trig, false) AS trig FROM clips c LEFT JOIN ot o USING (clip_id)),
om AS (SELECT fold, count(*) AS n, {counts_sql('label', 'trig')} FROM oz GROUP BY fold)"""


def outer_test(spark, sf_dir):
    """Thresholds from out-of-fold rows, applied to each outer test fold."""
    w = window_table(spark, sf_dir)
    pooled = out_of_fold(stage1(w).join(stage2(w), ["clip_id", "window_index"]).select("label", "fold", "stage1_score", "stage2_score"))
    one = th.recall_first(th.sweep(pooled, ["outer"], "label", "stage1_score"), ["outer"], 0.95)
    two = th.recall_first(th.sweep(pooled, ["outer"], "label", "stage2_score"), ["outer"], 0.9)
    thetas = one.select(F.col("outer").alias("fold"), F.col("threshold").alias("theta1")).join(
        two.select(F.col("outer").alias("fold"), F.col("threshold").alias("theta2")), "fold"
    )
    placed = stage1(w).join(thetas, "fold")
    cc = cs.clip_cascade(placed, stage2(w), F.col("theta1"), F.col("theta2"), keep=["label", "fold"])
    return thetas, mt.confusion(cc, ["fold"], "label", F.col("final_trigger"))


@plan(
    "cv7_outer_test_report",
    C
    + f""", {OOF_SQL} SELECT fold, round(t1, 6) AS theta1, round(t2, 6) AS theta2, n, tp, tn, fp, fn, {metric_sql(only=BASE)}
FROM om JOIN ths USING (fold)""",
)
def _cv7(spark, sf_dir):
    """CV7: out-of-fold thresholds and the outer-test report per fold."""
    thetas, report = outer_test(spark, sf_dir)
    cols = ["fold", "theta1", "theta2", "n", "tp", "tn", "fp", "fn", *BASE]
    return report.join(thetas, "fold").select(*cols)


@plan(
    "cv7_outer_summary",
    C
    + f""", {OOF_SQL}, ov AS (SELECT {metric_sql(digits=17, only=BASE)} FROM om) SELECT """
    + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in BASE)
    + " FROM ov",
)
def _cv7_summary(spark, sf_dir):
    """CV7 with AGG6: mean and deviation over the outer folds."""
    return mt.mean_std(outer_test(spark, sf_dir)[1], [], list(BASE))


@plan(
    "set1_pooled_out_of_fold",
    W
    + """, p AS (SELECT 0 AS src, label, stage1_score FROM w WHERE split = 'val' UNION ALL SELECT 1, label, stage1_score FROM w WHERE split = 'test')
SELECT src, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(max(stage1_score), 6) AS top FROM p GROUP BY src""",
)
def _set1(spark, sf_dir):
    """SET1: pooled union of split rows."""
    w = windows(spark, sf_dir).select("split", "label", "stage1_score")
    parts = [w.where(F.col("split") == s).withColumn("src", F.lit(i)) for i, s in enumerate(("val", "test"))]
    pooled = parts[0].unionByName(parts[1])
    return pooled.groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"), F.max("stage1_score").alias("top")
    )
