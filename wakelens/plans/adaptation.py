"""Few-shot plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import fewshot as fs
from ..operators import sampling as sm
from ..operators import selection as sl
from ..session import cut
from .bindings import FEWSHOT_SQL, VECTOR_WINDOWS_SQL, WINDOWS_SQL, fewshot_clips, table, vector_windows, windows, with_ctes
from .registry import counts_sql, plan

SEED_ROWS = ", ".join(f"({s})" for s in fs.SEEDS)
SUPPORT_SQL = f"""seeds AS (SELECT CAST(s AS INT) AS seed FROM (VALUES {SEED_ROWS}) v(s)),
ok AS (SELECT target, CAST(shot AS INT) AS shot, count(*) FILTER (WHERE lab = 1) AS pos, count(*) FILTER (WHERE lab = 0) AS neg FROM fcd, (VALUES (3), (5)) h(shot) GROUP BY ALL),
fit AS (SELECT target, shot FROM ok WHERE pos >= shot + 1 AND neg >= 1),
p1 AS (SELECT fcd.*, seed, sha256(seed || ':' || target || ':' || prompt_group || ':' || clip_id) AS k FROM fcd, seeds WHERE lab = 1),
p2 AS (SELECT *, row_number() OVER (PARTITION BY target, seed, prompt_group ORDER BY k, clip_id) AS ip FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY target, seed ORDER BY CASE WHEN ip = 1 THEN 0 ELSE 1 END, CASE WHEN ip = 1 THEN prompt_group END, k, clip_id) AS support_rank FROM p2),
sup AS (SELECT p3.*, shot FROM p3 JOIN fit USING (target) WHERE support_rank <= shot),
qry AS (SELECT fcd.*, shot, seed FROM fcd JOIN fit USING (target), seeds
  WHERE NOT EXISTS (SELECT 1 FROM sup s WHERE s.target = fcd.target AND s.shot = fit.shot AND s.seed = seeds.seed AND s.clip_id = fcd.clip_id))"""
FS = with_ctes(FEWSHOT_SQL, SUPPORT_SQL)


def sets(spark, sf_dir):
    clips = fewshot_clips(spark, sf_dir)
    support = fs.supports(clips)
    return clips, support, fs.query_rows(clips, support)


@plan(
    "src5_vector_health",
    """WITH v AS (SELECT label, len(embedding) AS n, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS q FROM embeddings)
SELECT label, CAST(n AS INT) AS dimension, count(*) AS vectors, count(*) FILTER (WHERE isnan(q) OR isinf(q)) AS non_finite, count(*) FILTER (WHERE abs(sqrt(q) - 1) <= 1e-4) AS unit_norm FROM v GROUP BY ALL""",
)
def _src5(spark, sf_dir):
    """SRC5: dimension, finiteness and norm of stored vectors."""
    from ..sources.readers import vector_health

    return vector_health(table(spark, sf_dir, "embeddings"), "embedding", ["label"])


@plan(
    "win9_positive_support",
    FS + "SELECT target, seed, clip_id, prompt_group, CAST(support_rank AS INT) AS support_rank FROM p3 WHERE support_rank <= 5",
)
def _win9(spark, sf_dir):
    """WIN9: five support positives per target and seed."""
    out = sm.support_ranking(fewshot_clips(spark, sf_dir), "target", fs.SEEDS, 5)
    return out.select("target", "seed", "clip_id", "prompt_group", "support_rank")


@plan("win10_nested_supports", FS + "SELECT target, shot, seed, clip_id FROM sup")
def _win10(spark, sf_dir):
    """WIN10: nested three- and five-shot supports of eligible targets."""
    return fs.supports(fewshot_clips(spark, sf_dir)).select("target", "shot", "seed", "clip_id")


@plan(
    "win10_eligibility",
    FS + "SELECT target, shot, pos AS positive_clips, neg AS negative_clips, pos >= shot + 1 AND neg >= 1 AS eligible, neg >= 5 AS stable_fpr FROM ok",
)
def _win10_eligible(spark, sf_dir):
    """WIN10: eligibility per target and shot."""
    return sm.eligibility(fewshot_clips(spark, sf_dir), "target", fs.SHOTS)


@plan(
    "jn9_support_query_checks",
    FS
    + """SELECT s.shot, count(*) AS support_rows, count(*) FILTER (WHERE lab <> 1) AS negatives, coalesce(any_value(shared), 0) AS shared_content, 0::BIGINT AS shared_clips
FROM sup s LEFT JOIN (SELECT q.shot, count(*) AS shared FROM qry q WHERE EXISTS (SELECT 1 FROM sup x WHERE x.target = q.target AND x.shot = q.shot AND x.seed = q.seed
  AND x.stage1_clip_score = q.stage1_clip_score) GROUP BY q.shot) z ON z.shot = s.shot GROUP BY s.shot""",
)
def _jn9(spark, sf_dir):
    """JN9: support and query sets with their overlap checks."""
    _, support, query = sets(spark, sf_dir)
    return fs.support_checks(support, query, "stage1_clip_score")


REPLAY_SQL = """tg AS (SELECT DISTINCT target FROM fcd),
rp AS (SELECT tg.target, f.target AS owner, f.clip_id, f.lab, seed, f.prompt_group LIKE 'P4%' AS hard, sha256(seed || ':' || clip_id) AS k FROM tg, fcd f, seeds WHERE f.target <> tg.target),
rh AS (SELECT *, bool_or(hard AND lab = 0) OVER (PARTITION BY target, seed) AS any_hard FROM rp),
rq AS (SELECT * FROM rh WHERE lab = 1 OR NOT any_hard OR hard),
rr AS (SELECT *, row_number() OVER (PARTITION BY target, seed, lab ORDER BY k, clip_id) AS i FROM rq),
replay AS (SELECT * FROM rr WHERE i <= CASE WHEN lab = 1 THEN 24 ELSE 48 END)"""


@plan("jn10_source_replay", FS.rstrip() + f", {REPLAY_SQL} SELECT target, seed, owner, clip_id, lab AS label FROM replay")
def _jn10(spark, sf_dir):
    """JN10: capped replay rows of other participants per target."""
    out = fs.source_replay(fewshot_clips(spark, sf_dir))
    return out.select("target", "seed", "owner", "clip_id", "label")


@plan(
    "jn11_replay_classes",
    with_ctes(WINDOWS_SQL)
    + """SELECT CASE WHEN label = 1 THEN 'source_positive' WHEN phrase_id IN ('error', 'view') THEN 'source_hard_negative' ELSE 'source_general_negative' END AS replay_class,
  count(*) AS windows, count(DISTINCT speaker) AS speakers FROM w WHERE fold IN (2, 3, 4) GROUP BY 1""",
)
def _jn11(spark, sf_dir):
    """JN11: replay classes of the development participants."""
    w = windows(spark, sf_dir)
    development = w.where(F.col("fold").isin(2, 3, 4)).select("speaker").distinct()
    rows = fs.replay_classes(w, development, "speaker", ("error", "view"), F.col("phrase_id"))
    return rows.groupBy("replay_class").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("speaker").alias("speakers"))


@plan(
    "fs0_clip_records",
    with_ctes(WINDOWS_SQL)
    + """, j AS (SELECT s1.*, stage2_score FROM s1 JOIN s2 USING (clip_id, window_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY stage1_score DESC, window_index) AS rank, stage1_score >= 0.4 AS cand,
  least(greatest(stage2_score, 1e-6), 1 - 1e-6) AS c FROM j),
p AS (SELECT * FROM r WHERE (cand AND rank <= 3) OR rank = 1)
SELECT clip_id, any_value(label) AS label, bool_or(cand) AS stage1_candidate, round(coalesce(max(stage2_score) FILTER (WHERE cand), 0.0), 6)::DOUBLE AS base_score,
  round(coalesce(max(ln(c / (1 - c))) FILTER (WHERE cand), -20.0), 6)::DOUBLE AS base_logit,
  bool_or(cand) AND coalesce(max(stage2_score) FILTER (WHERE cand), 0.0) >= 0.25 AS base_decision,
  CAST(max_by(k, stage2_score * 1000000 - rank) AS INT) AS best_k FROM p GROUP BY clip_id""",
)
def _fs0(spark, sf_dir):
    """FS0: clip records with the chosen window's embedding."""
    w = windows(spark, sf_dir).where(F.col("event_type") != "error")
    vector = F.array(F.col("k").cast("double"), F.col("stage1_score"), F.col("stage2_score"))
    out = fs.clip_records(w.withColumn("embedding", vector), 0.4, 0.25, 3, ["label"])
    return out.withColumn("best_k", F.col("embedding")[0].cast("int")).drop("embedding")


PROTO_SQL = """un AS (SELECT target, shot, seed, clip_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM sup),
ui AS (SELECT target, shot, seed, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM un),
um AS (SELECT target, shot, seed, i, avg(x) AS x FROM ui GROUP BY ALL),
uv AS (SELECT target, shot, seed, list(x ORDER BY i) AS m FROM um GROUP BY ALL),
pr AS (SELECT target, shot, seed, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS prototype FROM uv)"""


@plan(
    "fs1_prototypes",
    FS.rstrip()
    + f", {PROTO_SQL} SELECT target, shot, seed, CAST(len(prototype) AS INT) AS dimension, round(prototype[1], 6) AS head, round(prototype[-1], 6) AS tail, round(list_sum(prototype), 6) AS total FROM pr",
)
def _fs1(spark, sf_dir):
    """FS1: support prototypes."""
    p = fs.prototypes(fs.supports(fewshot_clips(spark, sf_dir)), fs.RECORD)
    total = F.aggregate("prototype", F.lit(0.0), lambda a, x: a + x)
    return p.select(
        *fs.RECORD,
        F.size("prototype").alias("dimension"),
        F.element_at("prototype", 1).alias("head"),
        F.element_at("prototype", -1).alias("tail"),
        total.alias("total"),
    )


SIM_SQL = f"""{PROTO_SQL},
st AS (SELECT target, shot, seed, min(base_logit) AS q_min, quantile_cont(base_logit, 0.2) AS q_q20, median(base_logit) AS q_median,
  list(base_logit ORDER BY base_logit)[count(*) // 2 + 1] AS q_upper, median(stage1_clip_score) AS stage1_median FROM sup GROUP BY ALL),
fx AS (SELECT q.*, q_min, q_q20, q_median, list_dot_product(CAST(embedding AS DOUBLE[]), prototype) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS similarity
  FROM qry q JOIN st USING (target, shot, seed) JOIN pr USING (target, shot, seed))"""


@plan("fs2_cosine_to_prototype", FS.rstrip() + f", {SIM_SQL} SELECT target, shot, seed, clip_id, round(similarity, 6) AS similarity FROM fx")
def _fs2(spark, sf_dir):
    """FS2: similarity of query rows to their prototype."""
    _, support, query = sets(spark, sf_dir)
    return fs.with_support_facts(query, support).select(*fs.RECORD, "clip_id", "similarity")


@plan(
    "fs3_support_cohesion",
    FS.rstrip()
    + f""", {PROTO_SQL}, pp AS (SELECT a.target, a.shot, a.seed, list_dot_product(a.u, b.u) AS s FROM un a JOIN un b ON a.target = b.target AND a.shot = b.shot AND a.seed = b.seed AND a.clip_id < b.clip_id)
SELECT target, shot, seed, shot AS support_count, round(avg(s), 6) AS pairwise_mean, round(min(s), 6) AS pairwise_min FROM pp GROUP BY ALL""",
)
def _fs3(spark, sf_dir):
    """FS3: pairwise similarity inside support sets."""
    return fs.cohesion(fs.supports(fewshot_clips(spark, sf_dir)), fs.RECORD)


@plan(
    "fs4_bounded_bias",
    FS.rstrip()
    + f""", {SIM_SQL} SELECT target, shot, seed, round(q_min, 6) AS q_min, round(q_q20, 6) AS q_q20, round(q_median, 6) AS q_median, round(q_upper, 6) AS q_upper,
  round(least(1.0, greatest(0.0, 0.25 - q_min)), 6)::DOUBLE AS bias_min, round(least(1.0, greatest(0.0, 0.25 - q_q20)), 6)::DOUBLE AS bias_q20,
  round(least(1.0, greatest(0.0, 0.02 - q_upper)), 6)::DOUBLE AS bias_upper FROM st""",
)
def _fs4(spark, sf_dir):
    """FS4: bounded positive bias from support quantiles."""
    st = fs.support_statistics(fs.supports(fewshot_clips(spark, sf_dir)), fs.RECORD)
    theta = F.col("theta2_logit")
    return st.select(
        *fs.RECORD,
        "q_min",
        "q_q20",
        "q_median",
        "q_upper",
        fs.bounded_bias(theta, F.col("q_min"), 1.0, 0.25).alias("bias_min"),
        fs.bounded_bias(theta, F.col("q_q20"), 1.0, 0.25).alias("bias_q20"),
        fs.bounded_bias(theta, F.col("q_upper"), 1.0, 0.02).alias("bias_upper"),
    )


@plan(
    "fs5_calibrated_thresholds",
    FS.rstrip()
    + f""", {SIM_SQL}, sg AS (SELECT target, shot, seed, median(1 / (1 + exp(-base_logit))) AS m2 FROM sup GROUP BY ALL)
SELECT target, shot, seed, round(greatest(0.5 - 0.2, least(0.5, m2 - 0.05)), 6)::DOUBLE AS theta2, round(greatest(0.2 - 0.1, least(0.2, stage1_median - 0.02)), 6)::DOUBLE AS theta1
FROM sg JOIN st USING (target, shot, seed)""",
)
def _fs5(spark, sf_dir):
    """FS5: thresholds lowered towards the support by a bounded drop."""
    support = fs.supports(fewshot_clips(spark, sf_dir))
    st = support.groupBy(*fs.RECORD).agg(
        F.percentile(nm.sigmoid(F.col("base_logit")), 0.5).alias("m2"),
        F.percentile("stage1_clip_score", 0.5).alias("m1"),
        F.max("theta1").alias("t1"),
    )
    return st.select(
        *fs.RECORD,
        fs.calibrated_threshold(F.lit(0.5), F.col("m2"), 0.05, 0.2).alias("theta2"),
        fs.calibrated_threshold(F.col("t1"), F.col("m1"), 0.02, 0.1).alias("theta1"),
    )


@plan(
    "fs6_prototype_fusion",
    FS.rstrip()
    + f""", {SIM_SQL}, z AS (SELECT *, 1 / (1 + exp(-base_logit)) AS s FROM fx)
SELECT target, shot, seed, clip_id, round(base_logit + 2.0 * (similarity - 0.25), 6) AS logit_fused, round(s + 0.5 * (similarity - 0.25), 6) AS score_fused,
  round(s * 0.7 + similarity * 0.3, 6) AS blended, s >= 0.5 OR similarity >= 0.7 AS either FROM z""",
)
def _fs6(spark, sf_dir):
    """FS6: the fusion variants on every query row."""
    _, support, query = sets(spark, sf_dir)
    facts = fs.with_support_facts(query, support)
    score, sim = nm.sigmoid(F.col("base_logit")), F.col("similarity")
    return facts.select(
        *fs.RECORD,
        "clip_id",
        (F.col("base_logit") + 2.0 * (sim - 0.25)).alias("logit_fused"),
        (score + 0.5 * (sim - 0.25)).alias("score_fused"),
        fs.weighted_blend(score, sim, 0.3).alias("blended"),
        fs.prototype_or(score, F.lit(0.5), sim, 0.7).alias("either"),
    )


@plan(
    "fs7_keyword_or_cascade",
    FS
    + """, o AS (SELECT target, lab, stage1_clip_score >= 0.9 OR base_decision AS d FROM fcd)
SELECT target, """
    + counts_sql("lab", "d")
    + " FROM o GROUP BY target",
)
def _fs7(spark, sf_dir):
    """FS7: keyword match or cascade."""
    from ..operators.metrics import count_aggs

    either = (F.col("stage1_clip_score") >= 0.9) | F.col("base_decision")
    return fewshot_clips(spark, sf_dir).groupBy("target").agg(*count_aggs(F.col("label"), either))


CELLS_SQL = f"""{counts_sql('lab', 'base_decision', 'zero_')}, {counts_sql('lab', 'adapted_decision', 'new_')}, count(*) FILTER (WHERE base_decision <> adapted_decision) AS changed,
  count(*) FILTER (WHERE lab = 1 AND NOT stage1_candidate) AS stage1_misses, count(*) FILTER (WHERE lab = 1 AND stage1_candidate AND base_logit < 0) AS stage2_rejects,
  count(*) FILTER (WHERE lab = 0 AND adapted_decision) AS final_false_accepts"""


def fitted(spark, sf_dir):
    clips, support, query = sets(spark, sf_dir)
    return query, support, cut(fs.record_fits(support, fs.source_replay(clips)))


FIT_ROWS = ", ".join(f"({len(fs.recipe_grid()) + i}, '{r}', '{m}', {n}, {rate}::DOUBLE)" for i, (r, m, n, rate) in enumerate(fs.finetune_grid()))
RATE_ROWS = ", ".join(f"({r}::DOUBLE)" for r in fs.FINETUNE_RATES)
FIT_SQL = f"""{REPLAY_SQL}, lf AS (SELECT clip_id, base_logit AS b2, greatest(least(stage1_clip_score, 1 - 1e-6), 1e-6) AS c1, stage1_clip_score - 0.2 AS m, CAST(embedding AS DOUBLE[]) AS v FROM fcd),
tr AS (SELECT target, shot, seed, clip_id, lab, 'support' AS part FROM sup UNION ALL
  SELECT r.target, fit.shot, r.seed, r.clip_id, r.lab, CASE WHEN r.lab = 1 THEN 'positive' ELSE 'negative' END FROM replay r JOIN fit ON fit.target = r.target),
tx AS (SELECT target, shot, seed, clip_id, lab::DOUBLE AS y, part, b2, ln(c1 / (1 - c1)) AS b1, m, v FROM tr JOIN lf USING (clip_id)),
dx AS (SELECT target, shot, seed, clip_id, y, 'stage2_finetune_bias_only' AS method, {fs.BIAS_RIDGE}::DOUBLE AS ridge, {max(fs.BIAS_STEPS)} AS stop, b2 AS base, [1.0::DOUBLE] AS x FROM tx UNION ALL
  SELECT target, shot, seed, clip_id, y, 'stage2_finetune_head', {fs.HEAD_RIDGE}::DOUBLE, {max(fs.HEAD_STEPS)}, b2, list_append(v, 1.0::DOUBLE) FROM tx UNION ALL
  SELECT target, shot, seed, clip_id, y, 'stage1_finetune_bias_only', {fs.BIAS_RIDGE}::DOUBLE, {max(fs.BIAS_STEPS)}, b1, [1.0::DOUBLE] FROM tx WHERE part <> 'positive' UNION ALL
  SELECT target, shot, seed, clip_id, y, 'stage1_finetune_head', {fs.HEAD_RIDGE}::DOUBLE, {max(fs.HEAD_STEPS)}, b1, [m, 1.0::DOUBLE] FROM tx WHERE part <> 'positive'),
dl AS (SELECT target, shot, seed, method, any_value(ridge) AS ridge, any_value(stop) AS stop, list(struct_pack(base := base, y := y, x := x) ORDER BY clip_id) AS rs FROM dx GROUP BY ALL),
dz AS MATERIALIZED (SELECT *, list_transform(range(1, len(rs[1].x) + 1), lambda i: list_transform(rs, lambda r: r.x[i])) AS cs FROM dl),
gd AS (SELECT target, shot, seed, method, rate, 0 AS step, list_transform(cs, lambda c: 0.0::DOUBLE) AS th FROM dz, (VALUES {RATE_ROWS}) q(rate) UNION ALL
  SELECT target, shot, seed, method, rate, step + 1, list_transform(range(1, len(th) + 1), lambda i: th[i] - rate * (list_dot_product(cs[i], e) / len(e) + ridge * th[i])) FROM (
    SELECT gd.*, dz.cs, dz.ridge, list_transform(dz.rs, lambda r: 1 / (1 + exp(-(r.base + list_dot_product(r.x, gd.th)))) - r.y) AS e
    FROM gd JOIN dz ON dz.target = gd.target AND dz.shot = gd.shot AND dz.seed = gd.seed AND dz.method = gd.method WHERE gd.step < dz.stop) z),
fr(recipe_index, recipe, method, step, rate) AS (VALUES {FIT_ROWS}),
ft AS MATERIALIZED (SELECT target, shot, seed, recipe_index, recipe, method, th[1:len(th) - 1] AS weights, th[len(th)] AS bias FROM gd JOIN fr USING (method, step, rate)),
fl AS (SELECT q.target, q.shot, q.seed, clip_id, lab, stage1_candidate, base_logit, base_decision, recipe_index, recipe, method, bias + CASE method WHEN 'stage2_finetune_head' THEN list_dot_product(CAST(embedding AS DOUBLE[]), weights)
  WHEN 'stage1_finetune_head' THEN weights[1] * (stage1_clip_score - 0.2) ELSE 0 END AS shift, greatest(least(stage1_clip_score, 1 - 1e-6), 1e-6) AS c1 FROM qry q JOIN ft ON ft.target = q.target AND ft.shot = q.shot AND ft.seed = q.seed),
fd AS (SELECT * EXCLUDE (shift, c1), CASE WHEN method LIKE 'stage2%' THEN stage1_candidate AND round(base_logit + shift, 9) >= 0
  ELSE round(ln(c1 / (1 - c1)) + shift, 9) >= round(ln(0.2::DOUBLE / (1 - 0.2::DOUBLE)), 9) AND base_logit >= 0 END AS adapted_decision FROM fl)"""


@plan("fs8_fitted_recipes", FS.rstrip() + f", {FIT_SQL} SELECT target, shot, seed, recipe, method, round(bias, 6) AS bias, CAST(len(weights) AS INT) AS dimension, round(coalesce(list_sum(list_transform(weights, lambda w: abs(w))), 0), 6)::DOUBLE AS weight_mass FROM ft")
def _fs8(spark, sf_dir):
    """FS8 and UDF3: bias and linear fits per record."""
    _, _, fits = fitted(spark, sf_dir)
    mass = F.aggregate("weights", F.lit(0.0), lambda total, w: total + F.abs(w))
    return fits.select(*fs.RECORD, F.inline("fits")).select(*fs.RECORD, "recipe", "method", "bias", F.size("weights").alias("dimension"), mass.alias("weight_mass"))


@plan("fs8_fitted_decisions", FS.rstrip() + f", {FIT_SQL} SELECT shot, method, recipe, {CELLS_SQL} FROM fd GROUP BY ALL")
def _fs8_applied(spark, sf_dir):
    """FS8: confusion cells of the fitted recipes on their query rows."""
    query, _, fits = fitted(spark, sf_dir)
    return fs.recipe_counts(fs.apply_fits(query, fits), ["shot", "method", "recipe"])


@plan(
    "fs9_records",
    FS.rstrip()
    + f""", {REPLAY_SQL} SELECT target, shot, seed, 'support' AS role, count(*) AS n FROM sup GROUP BY ALL UNION ALL
SELECT target, shot, seed, 'query', count(*) FROM qry GROUP BY ALL UNION ALL
SELECT target, shot, seed, CASE WHEN lab = 1 THEN 'replay_positive' ELSE 'replay_negative' END, count(*) FROM replay JOIN fit USING (target) GROUP BY ALL""",
)
def _fs9(spark, sf_dir):
    """FS9: sizes of support, query and replay per record."""
    clips, support, query = sets(spark, sf_dir)
    fit = sm.eligibility(clips, "target", fs.SHOTS).where("eligible").select("target", "shot")
    part = F.when(F.col("label") == 1, "replay_positive").otherwise("replay_negative")
    drawn = fs.source_replay(clips).groupBy("target", "seed", part.alias("role")).agg(F.count(F.lit(1)).alias("n")).join(fit, "target")
    cols = [*fs.RECORD, "role", "n"]
    out = drawn.select(*cols)
    for name, rows in (("support", support), ("query", query)):
        out = out.unionByName(rows.groupBy(*fs.RECORD).agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit(name)).select(*cols))
    return out


DECISION_SQL = "target, shot, seed, clip_id, lab, stage1_candidate, base_logit, base_decision, recipe_index, recipe, method, adapted_decision"
GRID_ROWS = ", ".join(
    f"({i}, '{r}', '{m}', {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE, {g}::DOUBLE, '{q}')" for i, r, m, a, b, w, g, q in fs.recipe_grid()
)
ADAPTED_SQL = f"""{SIM_SQL}, {FIT_SQL}, rc(recipe_index, recipe, method, alpha, beta, max_bias, margin, quantile) AS (VALUES {GRID_ROWS}),
ac AS (SELECT fx.*, rc.*, CASE WHEN method = 'zero_shot' THEN base_decision ELSE stage1_candidate AND round(CASE WHEN method = 'stage2_cosine_prototype'
  THEN base_logit + alpha * (similarity - beta) ELSE base_logit + least(max_bias, greatest(0.0, 0.0 - CASE quantile WHEN 'min' THEN q_min WHEN 'q20' THEN q_q20 ELSE q_median END + margin)) END, 9) >= 0 END AS adapted_decision FROM fx, rc),
ad AS MATERIALIZED (SELECT {DECISION_SQL} FROM ac UNION ALL SELECT {DECISION_SQL} FROM fd)"""
def evaluated(spark, sf_dir):
    """Every query row under all recipes, closed-form and fitted."""
    query, support, fits = fitted(spark, sf_dir)
    return fs.all_decisions(query, support, fits)


@plan(
    "fs10_recipe_grids",
    FS
    + f""", g(method, n) AS (VALUES """
    + ", ".join(f"('{k}', {v})" for k, v in {"ablation": len(fs.recipe_grid()), "finetune": len(fs.finetune_grid()), "real": len(fs.real_grid()), "target": len(fs.target_grid()), "onboarding": len(fs.onboarding_grid())}.items())
    + """) SELECT method AS grid, shot, CAST(n AS BIGINT) AS recipes, n * (SELECT count(*) FROM qry q WHERE q.shot = h.shot) AS evaluations FROM g, (VALUES (3), (5)) h(shot)""",
)
def _fs10(spark, sf_dir):
    """FS10: the recipe grids and the evaluations they ask for."""
    _, _, query = sets(spark, sf_dir)
    grids = {"ablation": fs.recipe_grid(), "finetune": fs.finetune_grid(), "real": fs.real_grid(), "target": fs.target_grid(), "onboarding": fs.onboarding_grid()}
    sizes = F.array(*[F.struct(F.lit(k).alias("grid"), F.lit(len(v)).cast("long").alias("recipes")) for k, v in grids.items()])
    rows = query.groupBy("shot").agg(F.count(F.lit(1)).alias("q"))
    return rows.select("shot", "q", F.inline(sizes)).select("grid", "shot", "recipes", (F.col("recipes") * F.col("q")).alias("evaluations"))


@plan(
    "jn15_recipe_grid",
    FS.rstrip()
    + f""", rc(recipe_index, recipe, method, alpha, beta, max_bias, margin, quantile) AS (VALUES {GRID_ROWS})
SELECT shot, method, recipe, count(*) AS evaluations, count(DISTINCT target) AS targets FROM qry, rc GROUP BY ALL""",
)
def _jn15(spark, sf_dir):
    """JN15: recipe grid times query records."""
    query = sets(spark, sf_dir)[2].select("target", "shot")
    per_target = fs.with_recipes(query).groupBy("target", "shot", "method", "recipe").agg(F.count(F.lit(1)).alias("_n"))
    return per_target.groupBy("shot", "method", "recipe").agg(
        F.sum("_n").alias("evaluations"), F.count(F.lit(1)).alias("targets")
    )


@plan(
    "fs11_adapted_metrics",
    FS.rstrip() + f", {ADAPTED_SQL} SELECT target, shot, seed, recipe, {CELLS_SQL} FROM ad GROUP BY ALL",
)
def _fs11(spark, sf_dir):
    """FS11 and JN15: paired cells of every record and recipe."""
    return fs.recipe_counts(evaluated(spark, sf_dir), [*fs.RECORD, "recipe"])


def _rate(p: str, kind: str) -> str:
    tp, fp, fn, tn = (f"{p}_{c}" for c in ("tp", "fp", "fn", "tn"))
    if kind == "f1":
        pr, rc = f"({tp} / nullif({tp} + {fp}, 0)::DOUBLE)", f"({tp} / nullif({tp} + {fn}, 0)::DOUBLE)"
        return f"(2 * {pr} * {rc} / nullif({pr} + {rc}, 0))"
    return f"({tp} / nullif({tp} + {fn}, 0)::DOUBLE)" if kind == "recall" else f"({fp} / nullif({fp} + {tn}, 0)::DOUBLE)"


def _delta(kind: str) -> str:
    return f"(coalesce({_rate('new', kind)}, 0) - coalesce({_rate('zero', kind)}, 0))"


SAFE_SQL = f"({_delta('fpr')} <= 0.02 + 1e-12 AND coalesce({_rate('new', 'fpr')}, 0) <= 0.03 + 1e-12)"
ALL_CELLS = [*fs.CELLS, *fs.COUNTERS]
ADD_CELLS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ALL_CELLS)


@plan(
    "fs12_safety_gate",
    FS.rstrip()
    + f""", {ADAPTED_SQL}, x AS (SELECT shot, recipe, {CELLS_SQL} FROM ad GROUP BY ALL)
SELECT shot, recipe, round({_rate('zero', 'fpr')}, 6) AS zero_fpr, round({_rate('new', 'fpr')}, 6) AS new_fpr, round({_delta('fpr')}, 6) AS delta_fpr, {SAFE_SQL} AS safe FROM x""",
)
def _fs12(spark, sf_dir):
    """FS12: false-positive safety gate per recipe."""
    rated = fs.with_deltas(fs.recipe_counts(evaluated(spark, sf_dir), ["shot", "recipe"]))
    return rated.select("shot", "recipe", "zero_fpr", "new_fpr", "delta_fpr", "safe")


PER_TARGET_SQL = f"pt AS (SELECT target, shot, method, recipe, recipe_index, {CELLS_SQL} FROM ad GROUP BY ALL)"
CHOSEN_SQL = f"""{PER_TARGET_SQL}, tt AS (SELECT shot, recipe, {ADD_CELLS} FROM pt GROUP BY ALL),
dv AS (SELECT pt.target, pt.shot, pt.method, pt.recipe, pt.recipe_index, {', '.join(f'tt.{c} - pt.{c} AS {c}' for c in ALL_CELLS)} FROM pt JOIN tt USING (shot, recipe)),
dr AS (SELECT *, {SAFE_SQL} AS safe, {_delta('f1')} AS delta_f1, {_delta('recall')} AS delta_recall, {_rate('new', 'fpr')} AS new_fpr FROM dv),
chosen AS (SELECT target, shot, method, CASE WHEN safe THEN recipe ELSE 'zero_shot' END AS recipe, safe AS selection_safe, delta_f1, delta_recall, new_fpr FROM dr
QUALIFY row_number() OVER (PARTITION BY target, shot, method ORDER BY safe DESC, round(delta_f1, 9) DESC, round(delta_recall, 9) DESC, changed > 0 DESC, recipe_index) = 1)"""


@plan(
    "fs13_recipe_selection",
    FS.rstrip()
    + f", {ADAPTED_SQL}, {CHOSEN_SQL} SELECT target, shot, method, recipe, selection_safe, round(delta_f1, 6) AS delta_f1, round(delta_recall, 6) AS delta_recall, round(new_fpr, 6) AS new_fpr FROM chosen",
)
def _fs13(spark, sf_dir):
    """FS13: leave-one-target-out recipe choice."""
    counts = fs.recipe_counts(evaluated(spark, sf_dir), ["target", "shot", "method", "recipe", "recipe_index"])
    return fs.select_recipes(cut(counts))


PICKED_SQL = f"""{CHOSEN_SQL}, ps0 AS MATERIALIZED (SELECT ad.* EXCLUDE (method), c.method FROM ad JOIN chosen c ON c.target = ad.target AND c.shot = ad.shot AND c.recipe = ad.recipe),
cb AS (SELECT two.* EXCLUDE (method, adapted_decision), one.recipe AS stage1_recipe, '{fs.COMBINED}' AS method,
  (one.adapted_decision OR (one.base_decision AND one.lab = 1 AND one.stage1_candidate AND one.base_logit < 0)) AND two.adapted_decision AS adapted_decision
  FROM ps0 one JOIN ps0 two ON two.target = one.target AND two.shot = one.shot AND two.seed = one.seed AND two.clip_id = one.clip_id WHERE one.method = '{fs.STAGE1_METHOD}' AND two.method = '{fs.STAGE2_METHOD}'),
pk AS (SELECT {DECISION_SQL} FROM ps0 UNION ALL SELECT {DECISION_SQL} FROM cb)"""


def selected(spark, sf_dir):
    """(decisions, cells per seed and recipe, chosen recipe per target, shot and method)."""
    decisions = evaluated(spark, sf_dir)
    per_seed = cut(fs.recipe_counts(decisions, [*fs.RECORD, "method", "recipe", "recipe_index"]))
    per_target = per_seed.groupBy("target", "shot", "method", "recipe", "recipe_index").agg(*[F.sum(c).alias(c) for c in ALL_CELLS])
    return decisions, per_seed, cut(fs.select_recipes(per_target))


def picked(spark, sf_dir):
    """Per-seed cells of each target's chosen recipe by method, the combined method included."""
    decisions, per_seed, chosen = selected(spark, sf_dir)
    own = per_seed.drop("method").join(chosen.select("target", "shot", "recipe", "method"), ["target", "shot", "recipe"])
    both = fs.recipe_counts(fs.combined_decisions(decisions, chosen), [*fs.RECORD, "method"])
    cols = [*fs.RECORD, "method", *ALL_CELLS]
    return own.select(*cols).unionByName(both.select(*cols))


SUMMARY_SQL = f"""ps AS (SELECT target, shot, seed, method, {CELLS_SQL} FROM pk GROUP BY ALL),
sm AS (SELECT 'seed' AS level, target, shot, seed, method, {ADD_CELLS} FROM ps GROUP BY ALL UNION ALL
SELECT 'target', target, shot, NULL, method, {ADD_CELLS} FROM ps GROUP BY ALL UNION ALL SELECT 'method', NULL, shot, NULL, method, {ADD_CELLS} FROM ps GROUP BY ALL),
sd AS (SELECT *, {_delta('f1')} AS delta_f1, {_rate('new', 'f1')} AS new_f1, {SAFE_SQL} AS safe, CASE WHEN {_delta('f1')} > 1e-12 THEN 'improved' WHEN {_delta('f1')} < -1e-12 THEN 'degraded' ELSE 'unchanged' END AS change_label FROM sm)"""


@plan(
    "fs14_summaries",
    FS.rstrip()
    + f""", {ADAPTED_SQL}, {PICKED_SQL}, {SUMMARY_SQL} SELECT level, target, shot, seed, method, new_tp, new_tn, new_fp, new_fn, round(new_f1, 6) AS new_f1, round(delta_f1, 6) AS delta_f1, safe, change_label, new_tn + new_fp < 5 AS fpr_unstable, stage1_misses, stage2_rejects, final_false_accepts FROM sd""",
)
def _fs14(spark, sf_dir):
    """FS14: per-seed, per-target and per-method summaries."""
    out = fs.summaries(picked(spark, sf_dir))
    cols = ["level", *fs.RECORD, "method", "new_tp", "new_tn", "new_fp", "new_fn", "new_f1", "delta_f1", "safe", "change_label", "fpr_unstable"]
    return out.select(*cols, "stage1_misses", "stage2_rejects", "final_false_accepts")


@plan(
    "fs14_method_overview",
    FS.rstrip()
    + f""", {ADAPTED_SQL}, {PICKED_SQL}, {SUMMARY_SQL} SELECT shot, method, count(*) AS targets, round(avg(new_f1), 6) AS macro_f1, round(avg(delta_f1), 6) AS mean_delta_f1,
  round(median(round(delta_f1, 9)), 6) AS median_delta_f1, count(*) FILTER (WHERE change_label = 'improved') AS improved, count(*) FILTER (WHERE change_label = 'degraded') AS degraded,
  count(*) FILTER (WHERE change_label = 'unchanged') AS unchanged, round(avg(CASE WHEN safe THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS safety_pass_rate FROM sd WHERE level = 'target' GROUP BY shot, method""",
)
def _fs14_overview(spark, sf_dir):
    """FS14: macro F1, paired changes and safety rate per method."""
    return fs.method_overview(cut(fs.summaries(picked(spark, sf_dir))))


@plan(
    "fs15_combined_stages",
    FS.rstrip() + f", {ADAPTED_SQL}, {PICKED_SQL} SELECT target, shot, stage1_recipe, recipe AS stage2_recipe, {CELLS_SQL} FROM cb GROUP BY ALL",
)
def _fs15(spark, sf_dir):
    """FS15: the chosen stage-1 and stage-2 recipes of each target combined."""
    decisions, _, chosen = selected(spark, sf_dir)
    cells = fs.recipe_counts(fs.combined_decisions(decisions, chosen), ["target", "shot", F.col("recipe").alias("stage2_recipe")])
    names = chosen.where(F.col("method") == fs.STAGE1_METHOD).select("target", "shot", F.col("recipe").alias("stage1_recipe"))
    return cells.join(names, ["target", "shot"])


@plan(
    "srt5_safe_recipe_choice",
    FS.rstrip()
    + f""", {ADAPTED_SQL}, pm AS (SELECT shot, recipe, target, {CELLS_SQL} FROM ad GROUP BY ALL),
pc AS (SELECT shot, recipe, {ADD_CELLS}, avg({_rate('new', 'recall')}) AS mr, avg({_rate('new', 'f1')}) AS mf FROM pm GROUP BY shot, recipe),
best AS (SELECT shot, recipe FROM pc WHERE coalesce({_rate('new', 'fpr')}, 0) <= 0.4 AND {_delta('fpr')} <= 0.02
  QUALIFY row_number() OVER (PARTITION BY shot ORDER BY round(mr, 9) DESC, round(mf, 9) DESC, recipe DESC) = 1)
SELECT s.shot, coalesce(recipe, 'no_adaptation_zero_shot_fallback') AS selected_recipe, CASE WHEN recipe IS NULL THEN 'no_safe_candidate' ELSE 'best_safe_candidate' END AS reason
FROM (SELECT DISTINCT shot FROM ad) s LEFT JOIN best b ON b.shot = s.shot""",
)
def _srt5(spark, sf_dir):
    """SRT5: safe recipe of every shot by macro recall and F1, else the fallback."""
    counts = fs.recipe_counts(evaluated(spark, sf_dir), ["shot", "recipe", "target"])
    rated = fs.with_deltas(counts)
    pooled = rated.groupBy("shot", "recipe").agg(
        *[F.sum(c).alias(c) for c in ALL_CELLS], F.round(F.avg("new_recall"), 9).alias("mr"), F.round(F.avg("new_f1"), 9).alias("mf")
    )
    gate = fs.with_deltas(pooled).withColumn("passed", fs.safety_gate(F.col("zero_fpr"), F.col("new_fpr"), 0.4, 0.02, 0.0))
    ready = gate.withColumn("latency", F.lit(None).cast("double"))
    return sl.choose_safe_recipe(ready, "recipe", "passed", "mr", "mf", "latency", "no_adaptation_zero_shot_fallback", ("shot",))


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)


STUDY_ROWS = ", ".join("(" + ", ".join(map(_value, row)) + ")" for row in fs.study_recipes())
STUDY_SQL = f"""{SIM_SQL}, sl AS (SELECT target, shot, seed, min(1 / (1 + exp(-base_logit))) AS s_min, quantile_cont(1 / (1 + exp(-base_logit)), 0.2) AS s_q20, median(1 / (1 + exp(-base_logit))) AS s_median FROM sup GROUP BY ALL),
sg({', '.join(fs.STUDY)}) AS (VALUES {STUDY_ROWS}),
sf AS (SELECT fx.*, sl.s_min, sl.s_q20, sl.s_median, st.stage1_median, 1 / (1 + exp(-fx.base_logit)) AS score FROM fx JOIN sl USING (target, shot, seed) JOIN st USING (target, shot, seed)),
sq AS (SELECT sf.*, sg.*, CASE quantile WHEN 'min' THEN s_min WHEN 'q20' THEN s_q20 ELSE s_median END AS sv, CASE quantile WHEN 'min' THEN q_min WHEN 'q20' THEN q_q20 ELSE q_median END AS qv FROM sf, sg),
sd AS (SELECT *, CASE method WHEN 'no_adaptation' THEN base_decision
  WHEN 'support_threshold_calibration' THEN stage1_candidate AND round(score, 9) >= round(least(0.5, greatest(0.5 - width, sv - margin)), 9)
  WHEN 'positive_bias_adaptation' THEN stage1_candidate AND round(base_logit + least(width, greatest(0.0, 0.0 - qv + margin)), 9) >= 0
  WHEN 'prototype_fusion' THEN stage1_candidate AND round(score + alpha * (similarity - beta), 9) >= round(threshold, 9)
  WHEN 'keyword_or_two_stage' THEN base_decision OR stage1_clip_score >= 0.9
  WHEN 'target_threshold_calibration' THEN stage1_candidate AND round(score, 9) >= round(greatest(0.5 - width, least(0.5, s_median - margin)), 9)
  WHEN 'stage1_threshold_calibration' THEN round(stage1_clip_score, 9) >= round(greatest(0.2 - width, least(0.2, stage1_median - margin)), 9) AND round(score, 9) >= 0.5
  WHEN 'positive_bias' THEN stage1_candidate AND round(1 / (1 + exp(-(ln(greatest(least(score, 1 - 1e-6), 1e-6) / (1 - greatest(least(score, 1 - 1e-6), 1e-6))) + width))), 9) >= 0.5
  WHEN 'target_prototype_fusion' THEN stage1_candidate AND (round(score, 9) >= 0.5 OR round(similarity, 9) >= round(threshold, 9)) END AS adapted_decision FROM sq)"""


def study(spark, sf_dir):
    _, support, query = sets(spark, sf_dir)
    return fs.study_decisions(fs.study_facts(query, support), F.col("stage1_clip_score") >= 0.9)


@plan("fs10_study_metrics", FS.rstrip() + f", {STUDY_SQL} SELECT study, shot, method, recipe, {CELLS_SQL} FROM sd GROUP BY ALL")
def _fs10_studies(spark, sf_dir):
    """FS10: the onboarding study's and the target-level study's grids on every query row."""
    return fs.recipe_counts(study(spark, sf_dir), ["study", "shot", "method", "recipe"])


REAL_SQL = f"""rp0 AS (SELECT method, recipe, recipe_index, {CELLS_SQL} FROM sd WHERE study = 'real' GROUP BY ALL),
rp1 AS (SELECT *, {_delta('f1')} AS delta_f1, coalesce({_rate('new', 'recall')}, 0) AS rec, coalesce({_rate('new', 'fpr')}, 0) AS fpr, {SAFE_SQL} AS safe,
  changed > 0 AND method <> 'keyword_or_two_stage' AND {_rate('zero', 'f1')} IS NOT NULL AND {_rate('new', 'f1')} IS NOT NULL AND round({_delta('f1')}, 9) > 0 AS gains FROM rp0),
rp2 AS (SELECT recipe, delta_f1 FROM rp1 WHERE safe AND gains ORDER BY round(delta_f1, 9) DESC, round(rec, 9) DESC, round(fpr, 9), recipe_index LIMIT 1)"""


@plan(
    "fs10_real_choice",
    FS.rstrip()
    + f""", {STUDY_SQL}, {REAL_SQL} SELECT coalesce((SELECT recipe FROM rp2), '{fs.NO_RECIPE}') AS recipe, round((SELECT delta_f1 FROM rp2), 6) AS delta_f1,
  count(*) FILTER (WHERE safe) AS safe_recipes, count(*) FILTER (WHERE safe AND gains) AS selectable FROM rp1""",
)
def _fs10_real(spark, sf_dir):
    """FS10, FS13: the recipe the onboarding study would take, over all shots and seeds."""
    rows = study(spark, sf_dir).where(F.col("study") == "real")
    return fs.choose_real_recipe(fs.recipe_counts(rows, ["method", "recipe", "recipe_index"]))


@plan(
    "fs10_target_choice",
    FS.rstrip()
    + f""", {STUDY_SQL}, tp AS (SELECT target, shot, recipe, recipe_index, {CELLS_SQL} FROM sd WHERE study = 'target' GROUP BY ALL),
tt AS (SELECT shot, recipe, {ADD_CELLS} FROM tp GROUP BY ALL),
dv AS (SELECT tp.target, tp.shot, tp.recipe, tp.recipe_index, {', '.join(f'tt.{c} - tp.{c} AS {c}' for c in ALL_CELLS)} FROM tp JOIN tt USING (shot, recipe)),
dr AS (SELECT *, {SAFE_SQL} AS safe, {_delta('f1')} AS delta_f1, coalesce({_rate('new', 'f1')}, 0) AS nf, coalesce({_rate('new', 'fpr')}, 0) AS fpr FROM dv)
SELECT target, shot, CASE WHEN safe AND round(delta_f1, 9) > 1e-12 THEN recipe ELSE 'no_adaptation' END AS recipe, safe, round(round(delta_f1, 9), 6) AS delta_f1 FROM dr
QUALIFY row_number() OVER (PARTITION BY target, shot ORDER BY safe DESC, round(delta_f1, 9) DESC, round(nf, 9) DESC, round(fpr, 9), recipe_index) = 1""",
)
def _fs10_target(spark, sf_dir):
    """FS10, FS13: the target-level study's recipe per held-out target and shot."""
    rows = study(spark, sf_dir).where(F.col("study") == "target")
    return fs.choose_target_recipe(cut(fs.recipe_counts(rows, ["target", "shot", "recipe", "recipe_index"])))


ONBOARD_ROWS = ", ".join(f"({i}, '{m}:{k}:{a}:{t}', '{m}', {k}, {a}::DOUBLE, {t}::DOUBLE)" for i, (m, k, a, t) in enumerate(fs.onboarding_grid()))
ONBOARD_FS = with_ctes(VECTOR_WINDOWS_SQL, SUPPORT_SQL)
ONBOARD_SQL = f"""{PROTO_SQL}, og(recipe_index, recipe, method, k, alpha, threshold) AS (VALUES {ONBOARD_ROWS}),
ow AS (SELECT q.target, q.shot, q.seed, q.clip_id, w.rank, w.s2, list_dot_product(w.v, pr.prototype) / sqrt(list_dot_product(w.v, w.v)) AS c FROM qry q JOIN vr w USING (clip_id)
  JOIN pr ON pr.target = q.target AND pr.shot = q.shot AND pr.seed = q.seed WHERE w.rank <= 3 AND w.s1 >= 0.3),
ob AS (SELECT target, shot, seed, clip_id, method, k, alpha, max(CASE WHEN method = 'prototype_only' THEN c ELSE s2 + alpha * c END) AS b FROM ow JOIN (SELECT DISTINCT method, k, alpha FROM og) g ON rank <= k GROUP BY ALL),
ad AS (SELECT q.target, q.shot, q.seed, q.clip_id, q.lab, q.stage1_candidate, q.base_logit, q.base_decision, og.recipe_index, og.recipe, og.method, coalesce(round(b, 9) >= threshold, false) AS adapted_decision
  FROM qry q CROSS JOIN og LEFT JOIN ob ON ob.target = q.target AND ob.shot = q.shot AND ob.seed = q.seed AND ob.clip_id = q.clip_id AND ob.method = og.method AND ob.k = og.k AND ob.alpha = og.alpha)"""


def onboarded(spark, sf_dir):
    clips = fs.onboarding_clips(vector_windows(spark, sf_dir), 0.3, 0.5, 3, ["target", "label", "prompt_group"])
    clips = clips.withColumns({"base_logit": F.lit(0.0), "theta2_logit": F.lit(0.0)})
    support = fs.supports(clips)
    return fs.onboarding_decisions(fs.query_rows(clips, support), support)


@plan("fs10_onboarding_metrics", ONBOARD_FS.rstrip() + f", {ONBOARD_SQL} SELECT shot, method, recipe, {CELLS_SQL} FROM ad GROUP BY ALL")
def _fs10_onboarding(spark, sf_dir):
    """FS10: the window-level onboarding grid on every query clip."""
    return fs.recipe_counts(onboarded(spark, sf_dir), ["shot", "method", "recipe"])


@plan(
    "fs10_onboarding_choice",
    ONBOARD_FS.rstrip()
    + f""", {ONBOARD_SQL}, ot AS (SELECT target, recipe, recipe_index, {CELLS_SQL} FROM ad GROUP BY ALL),
op AS (SELECT recipe, recipe_index, {ADD_CELLS}, avg({_rate('new', 'recall')}) AS mr, avg({_rate('new', 'f1')}) AS mf FROM ot GROUP BY recipe, recipe_index),
og2 AS (SELECT *, {_delta('fpr')} <= 0.02 + 1e-12 AND coalesce({_rate('new', 'fpr')}, 0) <= 0.02 + 1e-12 AS passed, coalesce({_rate('new', 'fpr')}, 0) AS fpr FROM op)
SELECT coalesce((SELECT recipe FROM og2 WHERE passed ORDER BY round(coalesce(mr, 0), 9) DESC, round(coalesce(mf, 0), 9) DESC, round(fpr, 9), recipe_index LIMIT 1), '{fs.NO_RECIPE}') AS recipe,
  count(*) FILTER (WHERE passed) AS safe_recipes, count(*) AS recipes FROM og2""",
)
def _fs10_onboarding_choice(spark, sf_dir):
    """FS10, FS13: the safe onboarding recipe by macro recall and F1."""
    return fs.choose_onboarding_recipe(cut(fs.recipe_counts(onboarded(spark, sf_dir), ["target", "recipe", "recipe_index"])))
