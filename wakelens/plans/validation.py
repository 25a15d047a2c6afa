"""Manifest, split, cap and cross-validation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..operators import crossval as cv
from ..operators import manifest as mf
from ..operators import metrics as mt
from ..operators import sampling as sm
from ..operators import splits as sp
from ..session import cut
from .bindings import CASCADE_SQL, GROUPS, STAR_SQL, WINDOWS_SQL, clips, owned_clips, participants, table, window_table, windows, with_ctes
from .registry import counts_sql, metric_sql, plan
from .scoring import W, cascaded

S = with_ctes(STAR_SQL)
GROUP_CASES = ", ".join(f"count(*) FILTER (WHERE prompt_group = '{g}') AS {n}_windows" for n, g in GROUPS.items())


@plan(
    "agg10_split_counters",
    W
    + f""", ww AS (SELECT split, count(*) FILTER (WHERE label = 1) AS positive_windows, count(*) FILTER (WHERE label = 0) AS negative_windows, {GROUP_CASES},
  count(DISTINCT speaker) AS speakers, count(DISTINCT d) AS sessions FROM w GROUP BY split),
c AS (SELECT split, clip_id, arg_min(label, window_index) AS label, arg_min(prompt_group, window_index) AS prompt_group, count(*) AS n FROM w GROUP BY ALL),
cc AS (SELECT split, count(*) AS clips, CAST(sum(n) AS BIGINT) AS windows, count(*) FILTER (WHERE label = 1) AS positive_clips,
  count(*) FILTER (WHERE label = 0) AS negative_clips, {GROUP_CASES.replace('_windows', '_clips')} FROM c GROUP BY split),
h AS (SELECT split, content_hash, count(DISTINCT clip_id) AS n FROM w GROUP BY ALL HAVING n > 1),
hh AS (SELECT split, count(*) AS duplicate_groups, CAST(sum(n) AS BIGINT) AS duplicate_clips FROM h GROUP BY split)
SELECT * FROM cc JOIN ww USING (split) JOIN hh USING (split)""",
)
def _agg10(spark, sf_dir):
    """AGG10: dataset counters per split."""
    return mf.split_counters(
        windows(spark, sf_dir), split="split", speaker="speaker", session="d", content="content_hash", groups=GROUPS
    )


ONE_ROW_SQL = """oc AS (SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingest) = 1),
oo AS (SELECT oc.*, o_custkey AS alias FROM oc JOIN orders ON o_orderkey = session_id)"""


@plan(
    "agg11_participant_statistics",
    S
    + f""", {ONE_ROW_SQL}, h AS (SELECT alias, content_hash, count(*) - 1 AS extra FROM oo GROUP BY ALL), hh AS (SELECT alias, CAST(sum(extra) AS BIGINT) AS duplicate_hash_count FROM h GROUP BY alias)
SELECT alias, count(*) AS total_unique_clips, count(*) AS total_windows, count(*) FILTER (WHERE label = 1) AS positive_clips,
  count(*) FILTER (WHERE label = 0) AS negative_clips, {GROUP_CASES.replace('_windows', '_clips')}, round(sum(duration_sec), 3) AS audio_duration_sec,
  any_value(duplicate_hash_count) AS duplicate_hash_count, count(*) FILTER (WHERE prompt_group = '') AS invalid_metadata, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (WHERE label = 1) >= 4 AND count(*) FILTER (WHERE label = 0) >= 1 AS eligible_3_shot,
  count(*) FILTER (WHERE label = 1) >= 6 AND count(*) FILTER (WHERE label = 0) >= 1 AS eligible_5_shot,
  count(*) FILTER (WHERE label = 1) >= 1 AND count(*) FILTER (WHERE label = 0) >= 1 AS both_query_kinds
FROM oo JOIN hh USING (alias) GROUP BY alias""",
)
def _agg11(spark, sf_dir):
    """AGG11: participant statistics."""
    rows = owned_clips(spark, sf_dir, "clip_id", "session_id", "label", "prompt_group", "content", "duration_sec")
    return mf.participant_statistics(rows, "alias", content="content", session="session_id", groups=GROUPS)


@plan(
    "agg11_phrase_counts",
    S + f", {ONE_ROW_SQL} SELECT alias, phrase_id, count(*) AS n FROM oo WHERE prompt_group = 'P4_negative' GROUP BY ALL",
)
def _agg11_phrases(spark, sf_dir):
    """AGG11: hard-negative phrase counters in long form."""
    return mf.phrase_counts(owned_clips(spark, sf_dir, "prompt_group", "phrase_id"), "alias", "prompt_group", GROUPS["P4"], "phrase_id")


@plan(
    "agg14_leakage",
    W
    + " UNION ALL ".join(
        f"""SELECT '{k}' AS key, CAST({k} AS VARCHAR) AS value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM w GROUP BY {k} HAVING count(DISTINCT split) > 1"""
        for k in ("speaker", "d", "content_hash")
    ),
)
def _agg14(spark, sf_dir):
    """AGG14: key values seen in more than one split."""
    found = mf.leakage(windows(spark, sf_dir), ["speaker", "d", "content_hash"])
    return found.withColumn("splits", F.array_join("splits", ","))


@plan(
    "agg14_leakage_summary",
    W
    + ", x AS ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS key, count(*) AS leaked_values FROM (SELECT {k} FROM w GROUP BY {k} HAVING count(DISTINCT split) > 1)"
        for k in ("speaker", "d", "content_hash")
    )
    + ") SELECT key, leaked_values, leaked_values = 0 AS no_leakage FROM x",
)
def _agg14_summary(spark, sf_dir):
    """AGG14: the leakage verdict per key."""
    return mf.leakage_summary(windows(spark, sf_dir), ["speaker", "d", "content_hash"])


@plan(
    "agg15_clip_consistency",
    S
    + """SELECT clip_id, count(DISTINCT phrase_id) > 1 AS inconsistent_phrase_id, count(DISTINCT auto_qc_status) > 1 AS inconsistent_auto_qc_status,
  count(DISTINCT label) > 1 AS inconsistent_label FROM clips GROUP BY clip_id HAVING count(DISTINCT phrase_id) > 1 OR count(DISTINCT auto_qc_status) > 1 OR count(DISTINCT label) > 1""",
)
def _agg15(spark, sf_dir):
    """AGG15: clips whose rows disagree."""
    return mf.clip_consistency(clips(spark, sf_dir), ["phrase_id", "auto_qc_status", "label"])


@plan("agg15_duplicate_keys", S + "SELECT clip_id, session_id, count(*) AS copies FROM clips GROUP BY ALL HAVING count(*) > 1")
def _agg15_keys(spark, sf_dir):
    """AGG15: repeated manifest keys."""
    return mf.duplicate_keys(clips(spark, sf_dir), ["clip_id", "session_id"])


@plan(
    "agg15_manifest_equality",
    W
    + """, a AS (SELECT split, content_hash, count(*) AS n FROM w WHERE split <> 'val' GROUP BY ALL), b AS (SELECT split, content_hash, count(*) AS n FROM w WHERE event_type <> 'error' GROUP BY ALL)
SELECT split, content_hash, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b USING (split, content_hash) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def _agg15_equal(spark, sf_dir):
    """AGG15: multiset difference of two manifests."""
    w = windows(spark, sf_dir)
    a, b = w.where(F.col("split") != "val"), w.where(F.col("event_type") != "error")
    return mf.same_rows(a, b, ["split", "content_hash"])


@plan(
    "agg25_dataset_fingerprint",
    W
    + f""", c AS (SELECT CAST('0x' || left(sha256(concat_ws(',', {", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("clip_id", "window_index", "label", "content_hash"))})), 15) AS BIGINT) AS h FROM w)
SELECT count(*) AS rows, sha256(concat_ws('|', bit_xor(h), CAST(sum(h) AS HUGEINT), count(*), '{{"window_seconds":2.0}}')) AS fingerprint FROM c""",
)
def _agg25(spark, sf_dir):
    """AGG25: order-free fingerprint of the window table and its config."""
    w = windows(spark, sf_dir).select("clip_id", "window_index", "label", "content_hash")
    return mf.fingerprint(w, '{"window_seconds":2.0}')


@plan(
    "agg25_counts_agree",
    W
    + """, e AS (SELECT split, count(*) AS n FROM w GROUP BY split), a AS (SELECT split, count(*) AS n FROM s2 JOIN w USING (clip_id, window_index) GROUP BY split)
SELECT split, e.n AS expected, a.n AS actual, abs(coalesce(e.n, 0) - coalesce(a.n, 0)) <= 2000 AS agrees FROM e FULL JOIN a USING (split)""",
)
def _agg25_counts(spark, sf_dir):
    """AGG25: counts within the expected distance."""
    w = windows(spark, sf_dir)
    count = F.count(F.lit(1)).alias("n")
    return mf.counts_agree(w.groupBy("split").agg(count), w.where(F.col("event_type") != "error").groupBy("split").agg(count), "split", 2000)


@plan(
    "win6_alias_map",
    """WITH s AS (SELECT DISTINCT 'spk_' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) AS speaker_id FROM events)
SELECT speaker_id, 'P' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INT), '0') AS participant_alias FROM (SELECT *, row_number() OVER (ORDER BY speaker_id) AS i FROM s)""",
)
def _win6(spark, sf_dir):
    """WIN6: aliases by sorted speaker id."""
    rows = table(spark, sf_dir, "events").select(hs.speaker_pseudonym(F.col("user_id")).alias("speaker_id"))
    return mf.alias_map(rows, "speaker_id")


@plan(
    "win7_sequential_ids",
    """WITH t AS (SELECT coalesce(max(CAST(substr(c_name, 10) AS BIGINT)), 0) AS m, count(*) AS n FROM customer)
SELECT s_suppkey, 'Customer#' || lpad(CAST(CASE WHEN m > 0 THEN m ELSE n END + row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS VARCHAR), 9, '0') AS new_id FROM supplier, t""",
)
def _win7(spark, sf_dir):
    """WIN7: ids for a batch after the highest stored number."""
    stored = table(spark, sf_dir, "customer").select("c_name")
    batch = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    order = [F.col("s_acctbal"), F.col("s_suppkey")]
    out = mf.next_ids(stored, "c_name", batch, order, F.floor(F.col("s_acctbal") / 100), "Customer#", 9)
    return out.select("s_suppkey", "new_id")


@plan(
    "win18_hash_split",
    S
    + """SELECT participant_id, CASE WHEN CAST('0x' || substr(sha1(coalesce(user_email, CAST(participant_id AS VARCHAR))), 1, 8) AS BIGINT) % 5 = 0
  THEN 'eval' ELSE 'train' END AS split FROM participants""",
)
def _win18(spark, sf_dir):
    """WIN18: hash split by account or participant identity."""
    p = participants(spark, sf_dir)
    identity = F.coalesce("user_email", F.col("participant_id").cast("string"))
    return p.select("participant_id", hs.eval_split(identity).alias("split"))


RANKED_SQL = """r AS (SELECT speaker, row_number() OVER (ORDER BY sha256('20260620:' || speaker), speaker) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT speaker FROM w)),
v AS (SELECT *, greatest(1, round_even(n * 0.7, 0)) AS a, greatest(1, round_even(n * 0.15, 0)) AS b FROM r),
sp AS (SELECT speaker, CASE WHEN i <= a THEN 'train' WHEN i <= CASE WHEN a + b >= n THEN n - 1 ELSE a + b END THEN 'val' ELSE 'test' END AS role FROM v),
ws AS (SELECT w.* EXCLUDE (split), role AS split FROM w JOIN sp USING (speaker))"""


def with_splits(spark, sf_dir):
    return sp.assign_splits(window_table(spark, sf_dir).drop("split"))


@plan(
    "win19_speaker_splits",
    W + f", {RANKED_SQL} SELECT speaker, split, 'speaker_disjoint' AS split_mode, count(*) AS windows FROM ws GROUP BY ALL",
)
def _win19(spark, sf_dir):
    """WIN19: speaker-disjoint train, val and test."""
    return with_splits(spark, sf_dir).groupBy("speaker", "split", "split_mode").agg(F.count(F.lit(1)).alias("windows"))


SETTLED_SQL = """ts AS (SELECT content_hash, max(list_position(['train', 'val', 'test'], split)) AS p FROM ws GROUP BY content_hash),
st AS (SELECT ws.* EXCLUDE (split), ['train', 'val', 'test'][p] AS split, split AS before FROM ws JOIN ts USING (content_hash))"""


@plan(
    "win20_duplicate_reconciliation",
    W + f", {RANKED_SQL}, {SETTLED_SQL} SELECT before, split, count(*) AS windows, count(DISTINCT speaker) AS speakers FROM st GROUP BY ALL",
)
def _win20(spark, sf_dir):
    """WIN20: copies move to the strictest split among them."""
    rows = with_splits(spark, sf_dir).withColumn("before", F.col("split"))
    settled = sp.reconcile_duplicates(rows, "content_hash")
    return settled.groupBy("before", "split").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("speaker").alias("speakers")
    )


@plan(
    "win20_strict_mode",
    W
    + f""", {RANKED_SQL}, {SETTLED_SQL}, q AS (SELECT speaker, max(list_position(['train', 'val', 'test'], split)) AS p FROM st GROUP BY speaker)
SELECT st.speaker, split, list_position(['train', 'val', 'test'], split) < p AS conflict, count(*) AS windows FROM st JOIN q ON q.speaker = st.speaker GROUP BY ALL""",
)
def _win20_strict(spark, sf_dir):
    """WIN20: strict mode re-checks speakers after reconciliation and flags conflicts."""
    settled = sp.reconcile_duplicates(with_splits(spark, sf_dir), "content_hash")
    return sp.flag_conflicting(settled, "speaker").groupBy("speaker", "split", "conflict").agg(F.count(F.lit(1)).alias("windows"))


# --- caps and the capped population ----------------------------------------------

CAP = 40


def cap_sql(src: str, unit: str, clip: str, cap: int = CAP, cols: str = "") -> str:
    """CTEs ending in ``capped``: the largest-remainder closed form."""
    return f"""
cs AS (SELECT {unit}, prompt_group, phrase_id, count(*) AS c FROM {src} GROUP BY ALL),
c1 AS (SELECT *, CAST(sum(c) OVER u AS BIGINT) AS n, {cap} * c // CAST(sum(c) OVER u AS BIGINT) AS f, {cap} * c % CAST(sum(c) OVER u AS BIGINT) AS r FROM cs WINDOW u AS (PARTITION BY {unit})),
c2 AS (SELECT *, {cap} - sum(f) OVER (PARTITION BY {unit}) AS slack, row_number() OVER (PARTITION BY {unit} ORDER BY f > 0, prompt_group, phrase_id) AS z FROM c1),
c3 AS (SELECT *, CASE WHEN f = 0 AND z <= slack THEN 1 ELSE f END AS al FROM c2),
c4 AS (SELECT *, {cap} - sum(al) OVER (PARTITION BY {unit}) AS lf, row_number() OVER (PARTITION BY {unit} ORDER BY al < c DESC, r DESC, c DESC, prompt_group || '||' || phrase_id DESC) AS turn FROM c3),
c5 AS (SELECT {unit}, prompt_group, phrase_id, CASE WHEN n <= {cap} THEN c ELSE al + CASE WHEN al < c AND turn <= lf THEN 1 ELSE 0 END END AS quota FROM c4),
rk AS (SELECT *, row_number() OVER (PARTITION BY {unit}, prompt_group, phrase_id ORDER BY sha256('20260620:' || {unit} || ':' || prompt_group || ':' || phrase_id || ':' || {clip}), {clip}) AS i FROM {src}),
capped AS (SELECT rk.* FROM rk JOIN c5 USING ({unit}, prompt_group, phrase_id) WHERE i <= quota)"""


@plan("win8_stratified_cap", S + f", {ONE_ROW_SQL}, {cap_sql('oo', 'alias', 'clip_id')} SELECT alias, clip_id, prompt_group, phrase_id FROM capped")
def _win8(spark, sf_dir):
    """WIN8: stratified cap per participant."""
    rows = cut(owned_clips(spark, sf_dir, "clip_id", "prompt_group", "phrase_id"))
    out = sm.stratified_cap(rows, "alias", "prompt_group", "phrase_id", "clip_id", cap=CAP)
    return out.select("alias", "clip_id", "prompt_group", "phrase_id")


@plan(
    "win8_cap_report",
    S
    + f""", {ONE_ROW_SQL}, {cap_sql('oo', 'alias', 'clip_id')}, a AS (SELECT alias, count(*) AS n FROM oo GROUP BY alias),
b AS (SELECT alias, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM capped GROUP BY alias)
SELECT alias, a.n AS clips_before, b.n AS clips_after, b.p AS positive_after, b.q AS negative_after, a.n - b.n AS clips_removed FROM a JOIN b USING (alias)""",
)
def _win8_report(spark, sf_dir):
    """WIN8: clips before and after the cap."""
    rows = cut(owned_clips(spark, sf_dir, "clip_id", "prompt_group", "phrase_id", "label"))
    after = sm.stratified_cap(rows, "alias", "prompt_group", "phrase_id", "clip_id", cap=CAP)
    return sm.cap_report(rows, after, "alias")


@plan(
    "agg28_capped_versus_full",
    with_ctes(WINDOWS_SQL, CASCADE_SQL)
    + f""", {cap_sql('cc', 'speaker', 'clip_id', 15)}, x AS (SELECT 'full' AS population, label, speaker, final_trigger FROM cc UNION ALL SELECT 'capped', label, speaker, final_trigger FROM capped),
u AS (SELECT population, speaker, {counts_sql('label', 'final_trigger')} FROM x GROUP BY ALL), v AS (SELECT *, {metric_sql(digits=17)} FROM u),
p AS (SELECT population, count(*) AS participants, """
    + ", ".join(f"round(avg({m}), 6) AS macro_{m}" for m in ("precision", "recall", "false_positive_rate", "f1"))
    + f""", CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM v GROUP BY population)
SELECT *, {metric_sql(only=('precision', 'recall', 'false_positive_rate', 'f1'))} FROM p""",
)
def _agg28(spark, sf_dir):
    """AGG28: the same metrics on the capped and the full population."""
    cc = cascaded(spark, sf_dir)
    capped = sm.stratified_cap(cc, "speaker", "prompt_group", "phrase_id", "clip_id", cap=15)
    cols = ["label", "speaker", "final_trigger"]
    both = cc.select(*cols, F.lit("full").alias("population")).unionByName(capped.select(*cols, F.lit("capped").alias("population")))
    return mt.pooled_and_macro(both, ["population"], "speaker", "label", F.col("final_trigger"))


# --- folds --------------------------------------------------------------------------

VECTORS_SQL = """pv AS (SELECT alias, 1::BIGINT AS participants, count(*) AS clips, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative,
  count(*) FILTER (WHERE prompt_group = 'P1') AS P1, count(*) FILTER (WHERE prompt_group = 'P2') AS P2, count(*) FILTER (WHERE prompt_group = 'P3') AS P3,
  count(*) FILTER (WHERE prompt_group = 'P4_negative') AS P4 FROM oo GROUP BY alias)"""
SNAKE_SQL = """rr AS (SELECT *, row_number() OVER (ORDER BY clips DESC, positive DESC, sha256('20260620:' || alias), alias) AS i FROM pv),
sf AS (SELECT *, CAST(CASE WHEN (i - 1) // 5 % 2 = 0 THEN (i - 1) % 5 ELSE 4 - (i - 1) % 5 END AS INT) AS fold FROM rr)"""
MEASURES = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in cv.WEIGHTS)


def vectors(spark, sf_dir):
    return cv.participant_vectors(owned_clips(spark, sf_dir, "label", "prompt_group"), "alias", GROUPS)


@plan("cv1_participant_vectors", S + f", {ONE_ROW_SQL}, {VECTORS_SQL} SELECT * FROM pv")
def _cv1(spark, sf_dir):
    """CV1: eight counts per participant."""
    return vectors(spark, sf_dir)


@plan(
    "cv2_fold_objective",
    S
    + f""", {ONE_ROW_SQL}, {VECTORS_SQL}, {SNAKE_SQL}, g AS (SELECT fold, {MEASURES} FROM sf GROUP BY fold)
SELECT round("""
    + " + ".join(f"{w} * sum(pow(({m} - (SELECT avg({m}) FROM g)) / (SELECT avg({m}) FROM g), 2))" for m, w in cv.WEIGHTS.items())
    + ", 6) AS objective FROM g",
)
def _cv2(spark, sf_dir):
    """CV2: imbalance of the serpentine folds."""
    placed = cv.serpentine_folds(cut(vectors(spark, sf_dir)), "alias")
    return cv.fold_objective(cv.fold_statistics(placed), 5)


@plan("cv3_serpentine_folds", S + f", {ONE_ROW_SQL}, {VECTORS_SQL}, {SNAKE_SQL} SELECT alias, clips, positive, fold FROM sf")
def _cv3(spark, sf_dir):
    """CV3: fast fold assignment by size."""
    return cv.serpentine_folds(cut(vectors(spark, sf_dir)), "alias").select("alias", "clips", "positive", "fold")


STARTS = 20
OBJECTIVE_SQL = " + ".join(f"{w} * 5 * (5 * sum({m}::DOUBLE * {m}) / pow(sum({m}::DOUBLE), 2) - 1)" for m, w in cv.WEIGHTS.items())


@plan(
    "cv3_multistart_folds",
    S
    + f""", {ONE_ROW_SQL}, {VECTORS_SQL}, tr AS (SELECT pv.*, s.i AS start FROM pv, range({STARTS}) s(i)),
rs AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY clips DESC, positive DESC, sha256('20260620:' || start || ':' || alias), alias) AS i FROM tr),
ps AS (SELECT *, CAST(CASE WHEN (i - 1) // 5 % 2 = 0 THEN (i - 1) % 5 ELSE 4 - (i - 1) % 5 END AS INT) AS fold FROM rs),
gs AS (SELECT start, fold, {MEASURES} FROM ps GROUP BY start, fold), os AS (SELECT start, {OBJECTIVE_SQL} AS objective FROM gs GROUP BY start)
SELECT fold, {", ".join(cv.WEIGHTS)} FROM gs WHERE start = (SELECT start FROM os ORDER BY round(objective, 9), start LIMIT 1)""",
)
def _cv3_multistart(spark, sf_dir):
    """CV3: best of 20 seeded snakes, summed per fold; the greedy placement is udf4_greedy_folds."""
    return cv.fold_statistics(cv.multistart_folds(cut(vectors(spark, sf_dir)), "alias", starts=STARTS))


MN = list(cv.WEIGHTS)
OVERLAP = " + ".join(f"w.x[{m + 1}] * w.c[{m + 1}] * w.v[f * 8 + {m + 1}]" for m in range(8))
GREEDY_SQL = f"""{ONE_ROW_SQL}, {VECTORS_SQL}, co AS MATERIALIZED (SELECT [{", ".join(f"coalesce({w} * 25 / nullif(CAST(sum({m}) * sum({m}) AS DOUBLE), 0), 0.0)::DOUBLE" for m, w in cv.WEIGHTS.items())}] AS c FROM pv),
cl AS MATERIALIZED (SELECT {", ".join(MN)}, concat_ws('-', {", ".join(MN)}) AS class, count(*) // 5 AS every, count(*) % 5 AS rest FROM pv GROUP BY {", ".join(MN)}),
it AS MATERIALIZED (SELECT s.i AS start, class, k.i AS copy, [{", ".join(MN)}] AS x, row_number() OVER (PARTITION BY s.i ORDER BY clips DESC, positive DESC, sha256('20260620:' || s.i || ':' || class), class, k.i) AS i
  FROM cl, range(200) s(i), range(4) k(i) WHERE k.i < rest),
gr AS (SELECT start, 0::BIGINT AS i, list_transform(range(40), lambda k: 0::BIGINT) AS v, 0::BIGINT AS fold FROM (SELECT DISTINCT start FROM it)
  UNION ALL SELECT start, i, list_transform(range(40), lambda k: v[k + 1] + CASE WHEN k // 8 = fold THEN x[k % 8 + 1] ELSE 0 END), fold
  FROM (SELECT w.start, w.i, w.v, w.x, list_min(list_transform(range(5), lambda f: {{'s': {OVERLAP}, 'n': w.v[f * 8 + 1], 'f': f}})).f AS fold
    FROM (SELECT it.start, it.i, it.x, gr.v, co.c FROM gr JOIN it ON it.start = gr.start AND it.i = gr.i + 1, co) w)),
ge AS (SELECT gr.start, list_sum(list_transform(range(8), lambda m: c[m + 1] * list_sum(list_transform(range(5), lambda f: pow(v[f * 8 + m + 1] - list_sum(list_transform(range(5), lambda g: v[g * 8 + m + 1])) / 5.0, 2))))) AS objective
  FROM gr JOIN (SELECT start, max(i) AS i FROM it GROUP BY start) USING (start, i), co)"""


@plan("udf4_start_objectives", S + f", {GREEDY_SQL} SELECT CAST(start AS INT) AS start, round(objective * 1e6, 6) AS objective_ppm FROM ge")
def _udf4_objectives(spark, sf_dir):
    """UDF4: what 200 greedy fold placements reach, in millionths."""
    rows = cv.start_objectives(cut(vectors(spark, sf_dir)))
    return rows.select("start", (F.col("objective") * 1e6).alias("objective_ppm"))


@plan(
    "udf4_greedy_folds",
    S
    + f""", {GREEDY_SQL}, gb AS (SELECT gr.fold, it.class, it.copy FROM gr JOIN it USING (start, i) WHERE start = (SELECT start FROM ge ORDER BY round(objective, 12), start LIMIT 1)),
pr AS (SELECT pv.*, class, every, row_number() OVER (PARTITION BY class ORDER BY sha256('20260620:' || alias), alias) AS r FROM pv JOIN cl USING ({", ".join(MN)}))
SELECT alias, clips, positive, CAST(CASE WHEN r <= 5 * every THEN (r - 1) % 5 ELSE gb.fold END AS INT) AS fold FROM pr LEFT JOIN gb ON gb.class = pr.class AND gb.copy = r - 1 - 5 * every""",
)
def _udf4(spark, sf_dir):
    """CV3 and UDF4: folds of the best of 200 greedy starts over all eight measures."""
    return cv.greedy_folds(vectors(spark, sf_dir), "alias").select("alias", "clips", "positive", "fold")


@plan(
    "cv4_fold_protocol",
    S
    + f""", {ONE_ROW_SQL}, {VECTORS_SQL}, {SNAKE_SQL}, cf AS (SELECT oo.*, fold FROM oo JOIN sf USING (alias))
SELECT 'alias' AS key, count(*) AS leaked_values, count(*) = 0 AS no_leakage FROM (SELECT alias FROM cf GROUP BY alias HAVING count(DISTINCT fold) > 1) UNION ALL
SELECT 'content_hash', count(*), count(*) = 0 FROM (SELECT content_hash FROM cf GROUP BY content_hash HAVING count(DISTINCT fold) > 1)""",
)
def _cv4(spark, sf_dir):
    """CV4: unique membership and contents that cross folds."""
    rows = cut(owned_clips(spark, sf_dir, "label", "prompt_group", "content").withColumnRenamed("content", "content_hash"))
    placed = cv.serpentine_folds(cut(cv.participant_vectors(rows, "alias", GROUPS)), "alias").select("alias", "fold")
    return mf.leakage_summary(rows.join(placed, "alias"), ["alias", "content_hash"], "fold")


NESTED_SQL = """np AS (SELECT o.i AS outer_, n.i AS inner_, f.i AS fold, CASE WHEN f.i = o.i THEN 'outer_test' WHEN f.i = n.i THEN 'inner_validation' ELSE 'inner_train' END AS role
FROM range(5) o(i), range(5) n(i), range(5) f(i) WHERE o.i <> n.i)"""


@plan(
    "cv5_nested_plan",
    W
    + f""", {NESTED_SQL}, c AS (SELECT fold, count(DISTINCT clip_id) AS clips, count(DISTINCT speaker) AS speakers FROM w GROUP BY fold)
SELECT CAST(outer_ AS INT) AS outer, CAST(inner_ AS INT) AS inner, role, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(speakers) AS BIGINT) AS speakers FROM np JOIN c USING (fold) GROUP BY ALL""",
)
def _cv5(spark, sf_dir):
    """CV5: clips and speakers of every nested role."""
    w = windows(spark, sf_dir).select("fold", "clip_id", "speaker")
    per_clip = w.distinct().groupBy("fold", "speaker").agg(F.count(F.lit(1)).alias("_c"))
    sizes = per_clip.groupBy("fold").agg(F.sum("_c").alias("clips"), F.count(F.lit(1)).alias("speakers"))
    return (
        cv.nested_plan(spark)
        .join(sizes, "fold")
        .groupBy("outer", "inner", "role")
        .agg(F.sum("clips").alias("clips"), F.sum("speakers").alias("speakers"))
    )


@plan(
    "cv5_inner_coverage",
    W
    + f""", {NESTED_SQL}, c AS (SELECT fold, count(*) AS windows FROM w GROUP BY fold)
SELECT CAST(outer_ AS INT) AS outer, CAST(fold AS INT) AS fold, windows, count(*) FILTER (WHERE role = 'inner_validation') AS validated, count(*) FILTER (WHERE role = 'inner_train') AS trained
FROM np JOIN c USING (fold) WHERE role <> 'outer_test' GROUP BY ALL""",
)
def _cv5_coverage(spark, sf_dir):
    """CV5: every development fold is validated exactly once."""
    sizes = windows(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("windows"))
    return cv.inner_coverage(cv.nested_plan(spark)).join(sizes, "fold")


@plan(
    "cv6_role_access",
    W
    + """, x(step, context, role, lo) AS (VALUES (0, 'inner_selection', 'inner_train', [0, 3, 4]), (1, 'inner_selection', 'inner_validation', [1]),
(2, 'refit', 'refit_train', [0, 1, 3, 4]), (3, 'final_evaluation', 'outer_test', [2]))
SELECT step, context, role, count(*) AS rows, count(DISTINCT speaker) AS participants FROM x JOIN w ON list_contains(lo, fold) GROUP BY ALL""",
)
def _cv6(spark, sf_dir):
    """CV6: role-separated reads of outer fold 2 and their access log."""
    data = cv.RoleSeparated(windows(spark, sf_dir).select("fold", "speaker"), outer=2)
    data.inner_train(1, "inner_selection")
    data.inner_validation(1, "inner_selection")
    data.refit_train("refit")
    data.outer_test("final_evaluation")
    return data.access_counts("speaker")


@plan(
    "cv8_single_validation_roles",
    W
    + """SELECT CAST(o AS INT) AS outer, CASE WHEN fold = o THEN 'test' WHEN fold = CASE WHEN o = 0 THEN 1 ELSE 0 END THEN 'val' ELSE 'train' END AS role,
  count(*) AS windows, count(DISTINCT clip_id) AS clips FROM w, range(5) r(o) GROUP BY ALL""",
)
def _cv8(spark, sf_dir):
    """CV8: one validation fold per outer fold."""
    per_fold = windows(spark, sf_dir).groupBy("fold", "clip_id").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per_fold.groupBy("fold").agg(F.sum("_n").alias("windows"), F.count(F.lit(1)).alias("clips"))
    each = sizes.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(4))))
    role = cv.single_validation_role(F.col("fold"), F.col("outer"))
    return each.groupBy("outer", role.alias("role")).agg(F.sum("windows").alias("windows"), F.sum("clips").alias("clips"))


@plan(
    "cv8_leave_one_target_out",
    """SELECT t.label AS target, CASE WHEN e.label = t.label THEN 'test' ELSE 'train' END AS role, CAST(sum(e.n) AS BIGINT) AS clips
FROM (SELECT DISTINCT label FROM embeddings) t, (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e GROUP BY ALL""",
)
def _cv8_loto(spark, sf_dir):
    """CV8: leave one target out, from counts per target."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    both = sizes.crossJoin(F.broadcast(total))
    rows = F.array(
        F.struct(cv.leave_one_out_role(F.col("label"), F.col("label")).alias("role"), F.col("n").alias("clips")),
        F.struct(F.lit("train").alias("role"), (F.col("all") - F.col("n")).alias("clips")),
    )
    return both.select(F.col("label").alias("target"), F.inline(rows))


@plan(
    "set3_role_overlap",
    W
    + """, x AS (SELECT content_hash, CASE fold WHEN 0 THEN 'outer_test' WHEN 1 THEN 'inner_validation' ELSE 'inner_train' END AS role FROM w)
SELECT array_to_string(roles, ',') AS roles, count(*) AS contents FROM (SELECT content_hash, list_sort(list(DISTINCT role)) AS roles FROM x GROUP BY content_hash HAVING count(DISTINCT role) > 1) GROUP BY 1""",
)
def _set3(spark, sf_dir):
    """SET3: contents held by more than one role."""
    role = F.when(F.col("fold") == 0, "outer_test").when(F.col("fold") == 1, "inner_validation").otherwise("inner_train")
    rows = windows(spark, sf_dir).select("content_hash", role.alias("role"))
    found = mf.role_overlap(rows, "content_hash", "role")
    return found.groupBy(F.array_join("roles", ",").alias("roles")).agg(F.count(F.lit(1)).alias("contents"))
