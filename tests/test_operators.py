"""Operators on small fixtures with known or brute-force results."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelens.functions import text as tx
from wakelens.functions.alignment import word_edits
from wakelens.functions.transcripts import extract_transcript
from wakelens.operators import asr, cascade, crossval, fewshot, labels, manifest, metrics, ranking, sampling, splits, thresholds
from wakelens.sources import readers
from wakelens.streaming import triggers


def one(df):
    return df.collect()[0].asDict()


# --- text and recognition ----------------------------------------------------------


@pytest.mark.parametrize("raw,want", [("TWENTY-ONE", "twenty one"), ("'HELLO'", "hello"), ("rock'n'roll", "rock'n'roll"), ("Ｆｕｌｌ", "full")])
def test_scoring_form(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert one(df.select(tx.scoring_form(F.col("t")).alias("x")))["x"] == want


def test_word_errors(spark):
    df = spark.createDataFrame([("hello world", "hello"), ("twenty one", "twenty two")], "reference string, hypothesis string")
    got = one(asr.corpus_word_errors(asr.aligned(df), []))
    assert (got["substitutions"], got["deletions"], got["insertions"], got["wer"], got["exact_match_rate"]) == (1, 1, 0, 0.5, 0.0)
    more = spark.createDataFrame([("hello", "well hello there")], "reference string, hypothesis string")
    got = one(asr.corpus_word_errors(asr.aligned(more), []))
    assert (got["insertions"], got["wer"]) == (2, 2.0)
    none = spark.createDataFrame([("", "x")], "reference string, hypothesis string")
    assert one(asr.corpus_word_errors(asr.aligned(none), []))["wer"] is None


def test_character_errors(spark):
    df = spark.createDataFrame([("abc", "axc"), ("de", "d")], "reference string, hypothesis string")
    assert one(asr.character_errors(df, []))["cer"] == pytest.approx(0.4)


def brute_alignment(ref, hyp):
    best = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            options = []
            if i and j:
                d, n, m, s = best[i - 1, j - 1]
                options.append((d, n, m, s) if ref[i - 1] == hyp[j - 1] else (d + 1, n, m, s + 1))
            if i:
                d, n, m, s = best[i - 1, j]
                options.append((d + 1, n, m + 1, s))
            if j:
                d, n, m, s = best[i, j - 1]
                options.append((d + 1, n + 1, m, s))
            if options:
                best[i, j] = min(options)
    d, n, m, s = best[len(ref), len(hyp)]
    return [s, m, n]


def test_alignment_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(14))], [rng.choice("abc") for _ in range(rng.randrange(14))]) for _ in range(300)]
    rows = [(k, " ".join(r), " ".join(h)) for k, (r, h) in enumerate(pairs)] + [(300, None, "a b"), (301, "a", None), (302, None, None)]
    df = spark.createDataFrame(rows, "k int, r string, h string").select("k", word_edits(F.col("r"), F.col("h")).alias("e"))
    got = [list(r.e) for r in df.orderBy("k").collect()]
    assert got == [brute_alignment(*p) for p in pairs] + [[0, 0, 2], [0, 1, 0], [0, 0, 0]]


def test_run_comparison(spark):
    cols = "id string, status string, err int"
    base = spark.createDataFrame([("a", "success", 1), ("b", "success", 1), ("z", "failed", 0)], cols)
    cand = spark.createDataFrame([("a", "success", 1), ("b", "success", 2), ("c", "success", 0)], cols)
    got = one(asr.comparison_summary(asr.paired_runs(base, cand, ["err"]), "base_err", "cand_err"))
    assert (got["common_successes"], got["candidate_only"], got["degraded"], got["comparison_mode"]) == (2, 1, 1, "intersection_only")


def test_nested_transcripts(spark):
    rows = ['{"text":" hi "}', '[{"nothing":1},{"transcript":"yo"}]', '{"output":{"prediction":"deep"}}', '{"text":"<A object at 0x1f>","hypothesis":"ok"}', '{"x":1}', "{", '{"text":{"text":"in"}}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    got = [(r.text, r.extraction_error) for r in extract_transcript(df, "j").orderBy("i").collect()]
    assert got == [("hi", None), ("yo", None), ("deep", None), ("ok", None), (None, "unsupported"), (None, "invalid_json"), ("in", None)]


# --- cascade and metrics --------------------------------------------------------------


def scored(spark, rows):
    df = spark.createDataFrame(rows, "clip_id string, window_index long, label int, stage1_score double")
    return df.withColumns({"window_start_sec": F.lit(0.0), "window_end_sec": F.lit(2.0)})


def test_cascade_needs_both_thresholds_on_one_window(spark):
    one_clip = scored(spark, [("c", 0, 1, 0.9), ("c", 1, 1, 0.8)])
    two = spark.createDataFrame([("c", 0, 0.1), ("c", 1, 0.7)], "clip_id string, window_index long, stage2_score double")
    first = one(cascade.clip_cascade(one_clip, two, 0.5, 0.6, top_k=1, keep=["label"]))
    second = one(cascade.clip_cascade(one_clip, two, 0.5, 0.6, top_k=2, keep=["label"]))
    assert not first["final_trigger"]
    assert second["final_trigger"] and second["winning_window_index"] == 1


def test_missing_stage_two_rejects_or_drops(spark):
    rows = scored(spark, [("c", 0, 1, 0.9), ("c", 1, 1, 0.8)])
    two = spark.createDataFrame([("c", 1, 0.7)], "clip_id string, window_index long, stage2_score double")
    assert not one(cascade.clip_cascade(rows, two, 0.5, 0.6, top_k=1, keep=["label"]))["final_trigger"]
    assert one(cascade.clip_cascade(rows, two, 0.5, 0.6, top_k=1, keep=["label"], missing="drop"))["final_trigger"]


def test_rates_are_null_on_empty_denominators(spark):
    df = spark.createDataFrame([(0, False)], "label int, d boolean")
    got = one(metrics.confusion(df, [], "label", F.col("d")))
    assert got["recall"] is None and got["f1"] is None and got["false_positive_rate"] == 0.0


def test_threshold_special_cases(spark):
    no_positive = spark.createDataFrame([("k", 0, 0.3), ("k", 0, 1.5)], "k string, label int, score double")
    got = one(thresholds.recall_first(thresholds.sweep(no_positive, ["k"], "label", "score"), ["k"], 0.9))
    assert got["reason"] == "no_validation_positives" and got["threshold"] == pytest.approx(1.5 + 1e-6)


def test_perfect_rate_of_zero_is_not_taken_for_missing(spark):
    from wakelens.operators.selection import choose_variant

    rows = [("a", 0.95, 0.0, 0.5, 0.6), ("b", 0.95, 0.4, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "variant string, recall double, false_positive_rate double, precision double, f1 double")
    assert one(choose_variant(df, []))["variant"] == "a"


# --- scale primitives -------------------------------------------------------------------


def test_running_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 5}", rng.randrange(1000), i, rng.randrange(-5, 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    order = [F.col("t"), F.col("i")]
    out = ranking.running(df, ["k"], order, F.floor(F.col("t") / 50), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, totals_as="all_")
    got = {(r.k, r.i): (r.s, r.m, r.all_s) for r in out.collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        total = sum(r[3] for r in mine)
        for n, r in enumerate(mine):
            seen = [x[3] for x in mine[: n + 1]]
            assert got[k, r[2]] == (sum(seen), max(seen), total)


def test_sorted_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 9).alias("k"), F.col("id").alias("t"))
        task = lambda c: {"k": c["k"][:1], "n": np.array([len(c["t"])]), "top": c["t"][-1:]}
        out = ranking.map_sorted_groups(df, ["k"], ["t"], task, "k long, n long, top long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: (r.n, r.top) for r in out} == {k: (len(range(k, 500, 9)), max(range(k, 500, 9))) for k in range(9)}


def greedy(times, cooldown):
    last, out = None, []
    for t, tie in sorted(times):
        if last is None or t - last >= cooldown:
            out.append((t, tie))
            last = t
    return out


@pytest.mark.parametrize("cooldown,chunk,span", [(5, 10, 60), (5, 40, 400), (50, 100, 3000)])
def test_cooldown_against_greedy(spark, cooldown, chunk, span):
    rng = random.Random(cooldown + span)
    rows = [(f"s{0 if rng.random() < 0.6 else rng.randrange(4)}", rng.randrange(span), i) for i in range(600)]
    df = spark.createDataFrame(rows, "session string, t long, tie long")
    out = triggers.accepted_triggers(df, session="session", t="t", tie="tie", trigger=F.lit(True), cooldown=cooldown, chunk=chunk)
    got = sorted((r.session, r.t, r.tie) for r in out.collect())
    want = sorted((s, *p) for s in {r[0] for r in rows} for p in greedy([(r[1], r[2]) for r in rows if r[0] == s], cooldown))
    assert got == want


def test_trigger_cooldown_states(spark):
    rows = [("s", 10, 0, True, True), ("s", 12, 1, True, True), ("s", 16, 2, True, False)]
    df = spark.createDataFrame(rows, "session string, t long, id long, candidate boolean, trigger boolean")
    out = triggers.trigger_states(df, session="session", t="t", tie="id", trigger="trigger", candidate="candidate", cooldown=5, chunk=10, keyword="word")
    got = [(r.trigger_accepted, r.cooldown_active, r.assistant_state) for r in out.orderBy("t").collect()]
    assert got == [(True, False, "ASSISTANT_STATE"), (False, True, "LISTENING"), (False, False, "WORD_CANDIDATE")]


def test_rolling_transcript_over_cuts(spark):
    rng = random.Random(9)
    turns = [("c", i, "".join(rng.choice("ab ") for _ in range(rng.randrange(30)))) for i in range(200)]
    df = spark.createDataFrame(turns, "c string, i int, x string")
    out = triggers.rolling_transcript(df, "c", ["i"], "x", bucket=F.floor(F.col("i") / 16), keep=40, span=128)
    got = {r.i: r.rolling_transcript for r in out.collect()}
    said = ""
    for _, i, x in turns:
        both = " ".join(p for p in (said.strip(), x.strip()) if p)
        said = both if len(both) <= 40 else both[-40:].lstrip()
        assert got[i].rstrip() == said.rstrip()
    assert len(got) == len(turns)


# --- datasets -----------------------------------------------------------------------------


def test_label_mapping(spark):
    groups = labels.default_groups("word")
    rows = [
        ("a", groups.only, "anything", None),
        ("b", groups.before, "say word now", True),
        ("c", groups.before, "say nothing", True),
        ("d", groups.negative, "a word here", None),
        ("e", "mystery", "word", None),
        ("f", groups.negative, "wordy", False),
        ("g", groups.after, "", None),
    ]
    df = spark.createDataFrame(rows, "clip_id string, prompt_group string, transcript string, wake_intent boolean")
    got = {r.clip_id: (r.mapped_group, r.label, r.reasons) for r in labels.map_labels(df, "word", groups, ["wordy"]).collect()}
    assert got["a"] == (groups.only, 1, []) and got["b"] == (groups.before, 1, [])
    assert got["c"][2] == ["positive_prompt_missing_exact_keyword"]
    assert got["d"][2] == ["negative_prompt_contains_exact_keyword"]
    assert got["e"] == ("legacy", 1, []) and got["f"] == (groups.negative, 0, [])
    assert got["g"][2] == ["missing_transcript", "positive_prompt_missing_exact_keyword"]


def allocate(counts, cap):
    total = sum(counts.values())
    if total <= cap:
        return dict(counts)
    share = {k: cap * c // total for k, c in counts.items()}
    slack = cap - sum(share.values())
    for k in sorted(counts):
        if share[k] == 0 and slack > 0:
            share[k], slack = 1, slack - 1
    left = cap - sum(share.values())
    for k in sorted(counts, key=lambda k: (cap * counts[k] % total, counts[k], "||".join(k)), reverse=True):
        if left and share[k] < counts[k]:
            share[k], left = share[k] + 1, left - 1
    return share


def test_allocation_against_brute_force(spark):
    rng = random.Random(11)
    want, rows = {}, []
    for u in range(60):
        counts = {(f"P{rng.randrange(1, 5)}", f"x{rng.randrange(4)}"): rng.choice((1, 1, 2, 5, 30, 90)) for _ in range(rng.randrange(1, 9))}
        want.update({(u, *k): v for k, v in allocate(counts, 20).items()})
        rows += [(u, *k, c) for k, c in counts.items()]
    df = spark.createDataFrame(rows, "u int, p string, x string, c long")
    got = {(r.u, r.p, r.x): r.quota for r in sampling.stratum_allocation(df, "u", "p", "x", 20).collect()}
    assert got == want


def test_cap_keeps_small_units_whole(spark):
    rows = [("big", "P1", "x", f"c{i}", 1) for i in range(300)] + [("small", "P1", "x", f"d{i}", 1) for i in range(7)]
    df = spark.createDataFrame(rows, "alias string, prompt_group string, phrase_id string, clip_id string, label int")
    out = sampling.stratified_cap(df, "alias", "prompt_group", "phrase_id", "clip_id", cap=100)
    assert {r.alias: r["count"] for r in out.groupBy("alias").count().collect()} == {"big": 100, "small": 7}


@pytest.mark.parametrize("speakers,mode,parts", [(1, "SMOKE_ONLY_NO_SPEAKER_GENERALIZATION", 3), (2, "speaker_disjoint_test_only", 3), (4, "speaker_disjoint", 3), (5, "speaker_disjoint", 3), (12, "speaker_disjoint", 3)])
def test_speaker_splits(spark, speakers, mode, parts):
    rows = [(f"s{i % speakers}", f"c{i}") for i in range(speakers * 10)]
    out = splits.assign_splits(spark.createDataFrame(rows, "speaker string, clip_id string")).collect()
    assert {r.split_mode for r in out} == {mode} and len({r.split for r in out}) == parts and len(out) == len(rows)
    if speakers >= 3 and speakers != 5:
        assert all(len({r.split for r in out if r.speaker == s}) == 1 for s in {r.speaker for r in out})


def test_leakage_and_reconciliation(spark):
    rows = [("a", "train", "h1"), ("b", "test", "h1"), ("c", "val", None), ("d", "train", "h2")]
    df = spark.createDataFrame(rows, "clip_id string, split string, h string")
    assert [(r.value, r.splits) for r in manifest.leakage(df, ["h"]).collect()] == [("h1", ["test", "train"])]
    settled = {r.clip_id: r.split for r in splits.reconcile_duplicates(df, "h").collect()}
    assert settled == {"a": "test", "b": "test", "c": "val", "d": "train"}


def test_leakage_summary_of_numbered_splits_keeps_no_sets(spark):
    rows = [(1, "x", 0), (1, "y", 0), (2, "x", 4), (3, "", 1), (3, "", 2), (None, "z", 1), (4, "z", None), (5, "z", 1)]
    df = spark.createDataFrame(rows, "u long, h string, fold int")
    out = manifest.leakage_summary(df, ["u", "h"], "fold")
    assert sorted((r.key, r.leaked_values, r.no_leakage) for r in out.collect()) == [("h", 1, False), ("u", 1, False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_participant_statistics_tell_contents_apart_without_measures(spark):
    rng = random.Random(3)
    rows = [(None if i == 9 else f"c{i}", rng.choice([1, 2, None]), rng.choice([0, 1, 2, None]), rng.choice(["P1", "P4", "", None]), rng.choice("xyz") if i % 5 else None, rng.choice([10, 11, None]), rng.choice([0.1, 2.5, None])) for i in range(90)]
    df = spark.createDataFrame(rows, "clip_id string, u long, label int, prompt_group string, content string, s long, duration_sec double")
    out = manifest.participant_statistics(df, "u", content="content", session="s", groups={"P1": "P1", "P4": "P4"})
    got = {r.u: r.asDict() for r in out.collect()}
    assert set(got) == {1, 2}
    for u, r in got.items():
        own = [x for x in rows if x[1] == u]
        pos, neg = (sum(x[2] == y for x in own) for y in (1, 0))
        assert (r["total_unique_clips"], r["total_windows"], r["positive_clips"], r["negative_clips"]) == (len(own), len(own), pos, neg)
        assert (r["P1_clips"], r["P4_clips"]) == tuple(sum(x[3] == g for x in own) for g in ("P1", "P4"))
        assert r["audio_duration_sec"] == pytest.approx(sum(x[6] or 0.0 for x in own))
        assert r["duplicate_hash_count"] == len(own) - len({x[4] for x in own}) and r["sessions"] == len({x[5] for x in own} - {None})
        assert r["invalid_metadata"] == sum(x[0] is None or x[2] not in (0, 1) or not x[3] for x in own)
        assert (r["eligible_3_shot"], r["eligible_5_shot"], r["both_query_kinds"]) == (pos >= 4 and neg >= 1, pos >= 6 and neg >= 1, pos >= 1 and neg >= 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "clip_id" not in plan and not any("_content" in line and "sum(" in line for line in plan.splitlines())


def test_duplicate_policy(spark):
    rows = [("a", "u1", "h1"), ("b", "u1", "h1"), ("c", "u1", "h2"), ("d", "u2", "h2"), ("e", "u2", None)]
    df = spark.createDataFrame(rows, "clip_id string, u string, h string")
    assert sorted(r.clip_id for r in manifest.drop_duplicates_by_policy(df, "h", "u").collect()) == ["a", "e"]


def test_roles_are_guarded(spark):
    data = crossval.RoleSeparated(spark.range(10).select((F.col("id") % 5).cast("int").alias("fold")), outer=0)
    with pytest.raises(crossval.LeakageError):
        data.outer_test("inner_selection")
    with pytest.raises(crossval.LeakageError):
        data.inner_validation(0, "inner_selection")
    assert {r.fold for r in data.inner_train(1, "inner_selection").collect()} == {2, 3, 4}


def test_multistart_folds_cover_everybody_once(spark):
    rows = [(i, 1, 5 + i % 7, 3, 2 + i % 7, 1, 1, 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "u long, participants long, clips long, positive long, negative long, P1 long, P2 long, P3 long, P4 long")
    out = crossval.multistart_folds(df, "u", starts=6)
    assert sorted(r.u for r in out.collect()) == list(range(60))
    cost = one(crossval.fold_objective(crossval.fold_statistics(out), 5))["objective"]
    assert cost < 1.0 and cost <= one(crossval.fold_objective(crossval.fold_statistics(crossval.multistart_folds(df, "u", starts=1)), 5))["objective"]


@pytest.mark.parametrize("together", [50_000, 10])
def test_multistart_folds_multiply_behind_the_shuffle(spark, monkeypatch, together):
    monkeypatch.setattr(crossval, "_TOGETHER", together)
    rng = random.Random(11)
    sizes = [(i, rng.choice([5, 6, 6, 9]), rng.choice([2, 3])) for i in range(130)]
    df = spark.createDataFrame([(i, 1, c, p, c - p, 1, rng.choice([0, 7]), 1, 2) for i, c, p in sizes], VECTORS)
    want = {}
    for start in range(3):
        ranked = sorted(sizes, key=lambda r: (-r[1], -r[2], hashlib.sha256(f"7:{start}:{r[0]}".encode()).hexdigest(), r[0]))
        want |= {(start, r[0]): (k % 5 if k // 5 % 2 == 0 else 4 - k % 5) for k, r in enumerate(ranked)}
    out = crossval._snakes(df, "u", range(3), 5, 7)
    assert {(r.start, r.u): r.fold for r in out.collect()} == want
    cost = {s: one(crossval.fold_objective(crossval.fold_statistics(out.where(F.col("start") == s)), 5))["objective"] for s in range(3)}
    best = min(cost, key=lambda s: (round(cost[s], 9), s))
    chosen = crossval.multistart_folds(df, "u", starts=3, seed=7)
    assert {r.u: r.fold for r in chosen.collect()} == {u: f for (s, u), f in want.items() if s == best}
    assert "hashpartitioning(start" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert crossval.multistart_folds(df.limit(0), "u", starts=3).count() == 0


VECTORS = "u long, participants long, clips long, positive long, negative long, P1 long, P2 long, P3 long, P4 long"


def test_greedy_folds_against_the_whole_objective(spark):
    """Every placement is the one that a full evaluation of all folds would choose."""
    rng = random.Random(5)
    rows = []
    for i in range(83):
        parts = [rng.choice([0, 0, 1, 2, 9 if i % 11 == 0 else 1]) for _ in range(4)]
        rows.append((i, 1, sum(parts), sum(parts[:3]), parts[3], *parts))
    df = spark.createDataFrame(rows, VECTORS)
    names = list(crossval.WEIGHTS)
    means = {m: sum(r[k + 1] for r in rows) / 5 for k, m in enumerate(names)}

    def objective(folds):
        return sum(w * sum((f[k] / means[m] - sum(x[k] for x in folds) / 5 / means[m]) ** 2 for f in folds) for k, (m, w) in enumerate(crossval.WEIGHTS.items()))

    sizes = {}
    for r in rows:
        sizes[r[1:]] = sizes.get(r[1:], 0) + 1
    want = {}
    for start in range(4):
        key = lambda v: hashlib.sha256(f"7:{start}:{'-'.join(map(str, v))}".encode()).hexdigest()
        folds = [[0] * 8 for _ in range(5)]
        for v in sorted(sizes, key=lambda v: (-v[1], -v[2], key(v))):
            for _ in range(sizes[v] % 5):
                tried = [objective([[a + b for a, b in zip(f, v)] if i == k else f for i, f in enumerate(folds)]) for k in range(5)]
                best = min(range(5), key=lambda k: (round(tried[k], 9), folds[k][0], k))
                folds[best] = [a + b for a, b in zip(folds[best], v)]
        want[start] = objective(folds)
    got = {r.start: r.objective for r in crossval.start_objectives(df, starts=4, seed=7).collect()}
    assert got == pytest.approx(want)
    placed = crossval.greedy_folds(df, "u", starts=4, seed=7).cache()
    assert sorted(r.u for r in placed.collect()) == list(range(83)) and placed.where("fold is null or fold < 0 or fold > 4").count() == 0
    assert one(crossval.fold_objective(crossval.fold_statistics(placed), 5))["objective"] == pytest.approx(min(want.values()))


def test_greedy_folds_of_equal_participants_and_of_none(spark):
    df = spark.createDataFrame([(i, 1, 5, 3, 2, 1, 1, 1, 2) for i in range(60)], VECTORS)
    assert {r.n for r in crossval.greedy_folds(df, "u").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} == {12}
    assert crossval.greedy_folds(df.limit(0), "u").count() == 0


def test_replay_against_brute_force(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(i, rng.randrange(4) if rng.random() < 0.5 else 0, int(rng.random() < 0.5), rng.choice(["P4_negative", "legacy"])) for i in range(200)]
    df = spark.createDataFrame(rows, "clip_id long, target int, label int, prompt_group string")
    got = {(r.target, r.seed, r.clip_id) for r in fewshot.source_replay(df, seeds=(7, 8), positives=6, negatives=9).select("target", "seed", "clip_id").collect()}
    want = set()
    for target in {r[1] for r in rows}:
        for seed in (7, 8):
            others = sorted((hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r) for r in rows if r[1] != target)
            hard = [r for _, r in others if r[2] == 0 and r[3].startswith("P4")]
            negatives = hard or [r for _, r in others if r[2] == 0]
            picked = [r for _, r in others if r[2] == 1][:6] + negatives[:9]
            want |= {(target, seed, r[0]) for r in picked}
    assert got == want
    plan = fewshot.source_replay(df, seeds=(7, 8))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_combined_stages_take_the_chosen_recipes(spark):
    rows = [
        ("t", 3, 1, 1, 1, True, -1.0, 0.0, False, 0, "zero_shot", "zero_shot", False),
        ("t", 3, 1, 1, 1, True, -1.0, 0.0, False, 9, "one", fewshot.STAGE1_METHOD, True),
        ("t", 3, 1, 1, 1, True, -1.0, 0.0, False, 5, "two", fewshot.STAGE2_METHOD, True),
        ("t", 3, 1, 1, 1, True, -1.0, 0.0, False, 6, "other", fewshot.STAGE2_METHOD, False),
        ("t", 3, 1, 2, 0, True, 1.0, 0.0, True, 0, "zero_shot", "zero_shot", True),
        ("t", 3, 1, 2, 0, True, 1.0, 0.0, True, 9, "one", fewshot.STAGE1_METHOD, False),
        ("t", 3, 1, 2, 0, True, 1.0, 0.0, True, 5, "two", fewshot.STAGE2_METHOD, True),
        ("t", 3, 1, 2, 0, True, 1.0, 0.0, True, 6, "other", fewshot.STAGE2_METHOD, True),
    ]
    kinds = "target string, shot int, seed int, clip_id int, label int, stage1_candidate boolean, base_logit double, theta2_logit double, base_decision boolean, recipe_index int, recipe string, method string, adapted_decision boolean"
    decisions = spark.createDataFrame(rows, kinds)

    def combined(one, two):
        chosen = spark.createDataFrame([("t", 3, fewshot.STAGE1_METHOD, one), ("t", 3, fewshot.STAGE2_METHOD, two)], "target string, shot int, method string, recipe string")
        return {r.clip_id: r.adapted_decision for r in fewshot.combined_decisions(decisions, chosen).collect()}

    assert combined("one", "two") == {1: True, 2: False}
    assert combined("one", "other") == {1: False, 2: False}
    assert combined("zero_shot", "two") == {1: False, 2: True}


def test_transcript_lines(spark):
    df = spark.createDataFrame([("1-2-3 some text",), ("1-2 bad",), ("1-2-4",), ("",)], "value string")
    got = sorted((r.id, r.problem) for r in readers.parse_transcripts(df).collect())
    assert got == [("1-2", "malformed_id"), ("1-2-3", None), ("1-2-4", "empty_text")]


def test_file_listing(spark, tmp_path):
    (tmp_path / "audio_raw").mkdir()
    (tmp_path / "audio_raw" / "c1.webm").write_bytes(b"12345")
    rows = readers.list_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].length == 5 and rows[0].path.endswith("audio_raw/c1.webm")


def test_strict_reader_fails(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"id": "a"}\n{"id": \n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType())])
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), schema, strict=True).collect()
    assert one(readers.prediction_state(readers.read_jsonl(spark, str(path), schema).withColumn("status", F.lit("success")), "id"))["corrupt"] == 1


def test_hot_keys_are_limited_before_the_shuffle(spark):
    df = spark.range(100000).select((F.col("id") % 3).alias("k"), F.col("id"))
    plan = ranking.first_rows(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fitted_recipes_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [("t", 3, 1, i % 2, float(rng.normal()), float(rng.random()), 0.2, [float(x) for x in rng.normal(size=3)]) for i in range(3)]
    cols = "target string, shot int, seed int, label int, base_logit double, stage1_clip_score double, theta1 double, embedding array<double>"
    extra = [("t", 1, i % 2, float(rng.normal()), float(rng.random()), 0.2, [float(x) for x in rng.normal(size=3)], "positive" if i % 2 else "hard") for i in range(8)]
    replay = spark.createDataFrame(extra, "target string, seed int, label int, base_logit double, stage1_clip_score double, theta1 double, embedding array<double>, pool string")
    got = {r.recipe: r for r in fewshot.fit_recipes(spark.createDataFrame(rows, cols), replay).collect()}
    assert len(got) == len(fewshot.finetune_grid())
    data = [(r[3], r[4], r[7]) for r in rows] + [(e[2], e[3], e[6]) for e in extra]
    bias = 0.0
    for _ in range(50):
        grad = sum(1 / (1 + np.exp(-(x + bias))) - y for y, x, _ in data) / len(data)
        bias -= 1e-3 * (grad + bias)
    assert got["stage2_finetune_bias_only:50:0.001"].bias == pytest.approx(bias, abs=1e-12)
    w, b = [0.0] * 3, 0.0
    for _ in range(25):
        errs = [1 / (1 + np.exp(-(x + sum(p * q for p, q in zip(v, w)) + b))) - y for y, x, v in data]
        slopes = [sum(e * v[k] for e, (_, _, v) in zip(errs, data)) / len(data) for k in range(3)]
        w, b = [w[k] - 1e-3 * (slopes[k] + 10.0 * w[k]) for k in range(3)], b - 1e-3 * (sum(errs) / len(errs) + 10.0 * b)
    head = got["stage2_finetune_head:25:0.001"]
    assert head.bias == pytest.approx(b, abs=1e-12) and head.weights == pytest.approx(w, abs=1e-12)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(i, f"v{i % 3}") for i in range(50)]
    make = lambda data: one(manifest.fingerprint(spark.createDataFrame(data, "a int, b string"), "{}"))["fingerprint"]
    assert make(rows) == make(rows[::-1])
    assert make(rows) != make(rows[:-1] + [(49, "other")]) and make(rows) != make(rows + rows[:2])


def test_session_stream_control_events(spark, tmp_path):
    from wakelens.streaming import intake

    schema = "session string, event_id long, t long, kind string, text string, candidate boolean, trigger boolean"
    rows = [
        ("s", 0, 0, "start", None, False, False),
        ("s", 1, 10, "chunk", "one", True, True),
        ("s", 2, 12, "chunk", "two", True, True),
        ("s", 3, 13, "reset", None, False, False),
        ("s", 4, 14, "chunk", "three", True, True),
        ("s", 5, 15, "stop", None, False, False),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = intake.ended(intake.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), session="", event_id=-1, t=10**15, kind="end")
    out = intake.drain(triggers.assistant_stream(stream, cooldown=5, keyword="word")).orderBy("event_id").collect()
    assert [r.trigger_accepted for r in out] == [False, True, False, False, True, False]
    assert [r.assistant_state for r in out] == ["LISTENING", "ASSISTANT_STATE", "LISTENING", "IDLE", "ASSISTANT_STATE", "IDLE"]
    assert out[2].rolling_transcript == "one two" and out[4].rolling_transcript == "three"
    assert out[-1].chunks == 3 and not out[-1].active


def test_session_windows_equal_on_table_and_stream(spark, tmp_path):
    from wakelens.streaming import intake
    from wakelens.streaming import windows as sw

    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.8 else "k", 1_700_000_000 + rng.randrange(40_000), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "session string, s long, score double").select("session", F.timestamp_seconds("s").alias("ts"), "score")
    df.write.parquet(str(tmp_path / "in"))
    stream = intake.file_stream(spark, str(tmp_path / "in"), df.schema)
    table = sw.sessions(df, ts="ts", gap_seconds=60, theta=0.5).select("session", "window_start", "window_end", "chunks", "candidates")
    live = intake.drain(sw.sessions(stream, ts="ts", gap_seconds=60, theta=0.5, delay="0 seconds")).select(*table.columns)
    last = max(r.window_end for r in table.collect())
    closed = {tuple(r) for r in live.collect()}
    assert closed <= {tuple(r) for r in table.collect()} and len(closed) > 5
    assert {tuple(r) for r in table.collect() if r.window_end < last} >= closed


def test_intermediates_lie_in_the_shared_folder(spark):
    from wakelens.session import cut, shared_folder

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(root)
    assert all(root in f for f in cut(spark.range(3)).inputFiles())


def test_bad_vectors_fail_their_prototype(spark):
    rows = [(1, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [1.0, 0.0, 0.0]), (3, [3.0, 4.0]), (4, [float("nan"), 1.0]), (4, [1.0, 1.0])]
    got = {r.t: r.prototype for r in fewshot.prototypes(spark.createDataFrame(rows, "t int, embedding array<double>"), ["t"]).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and got[3] == pytest.approx([0.6, 0.8])


def test_onboarding_scores_of_clips(spark):
    windows = [(c, w, "t", int(c < 6), "P1" if c < 6 else "P4_negative", s1, s2, v) for c, w, s1, s2, v in [
        *[(c, 0, 0.9, 0.6, [1.0, 0.0]) for c in range(4)],
        (4, 0, 0.9, 0.1, [0.0, 1.0]), (4, 1, 0.8, 0.4, [0.6, 0.8]), (4, 2, 0.7, 0.2, [1.0, 0.0]),
        (5, 0, 0.1, 0.9, [1.0, 0.0]),
        (6, 0, 0.4, 0.45, [0.0, 2.0]),
    ]]
    df = spark.createDataFrame(windows, "clip_id int, window_index int, target string, label int, prompt_group string, stage1_score double, stage2_score double, embedding array<double>")
    clips = fewshot.onboarding_clips(df, 0.3, 0.5, 3, ["target", "label", "prompt_group"])
    assert {r.clip_id: r.base_decision for r in clips.collect()} == {**dict.fromkeys(range(4), True), 4: False, 5: False, 6: False}
    support = clips.where("clip_id < 3").withColumns({"shot": F.lit(3), "seed": F.lit(1)})
    query = clips.where("clip_id >= 3").withColumns({"shot": F.lit(3), "seed": F.lit(1)})
    got = {(r.clip_id, r.recipe): r.adapted_decision for r in fewshot.onboarding_decisions(query, support).collect()}
    assert len(got) == 4 * len(fewshot.onboarding_grid())
    assert not any(got[5, r] for _, r in got)  # its only window is no candidate
    assert [got[4, f"prototype_only:{k}:0.0:0.95"] for k in (1, 3)] == [False, True]
    assert [got[4, f"base_plus_prototype:{k}:1.0:0.95"] for k in (1, 3)] == [False, True]
    assert got[6, "base_plus_prototype:1:2.0:0.5"] is False and got[3, "base_plus_prototype:1:0.5:1.1"] is True


def test_real_recipe_choice_needs_a_gain(spark):
    cells = [*fewshot.CELLS, *fewshot.COUNTERS]

    def row(i, name, tp, fp, method="prototype_fusion"):
        new = {"zero_tp": 5, "zero_tn": 100, "zero_fp": 0, "zero_fn": 5, "new_tp": tp, "new_tn": 100 - fp, "new_fp": fp, "new_fn": 10 - tp, "changed": abs(tp - 5) + fp}
        return (method, name, i, *[new.get(c, 0) for c in cells])

    kinds = "method string, recipe string, recipe_index int, " + ", ".join(f"{c} long" for c in cells)

    def chosen(*rows):
        return one(fewshot.choose_real_recipe(spark.createDataFrame(list(rows), kinds)))["recipe"]

    assert chosen(row(0, "a", 7, 0), row(1, "b", 8, 1), row(2, "unsafe", 10, 9), row(3, "keyword", 10, 0, "keyword_or_two_stage")) == "b"
    assert chosen(row(0, "a", 5, 0), row(1, "worse", 4, 0)) == fewshot.NO_RECIPE
