"""Distances of text pairs by the batch, and steps that must not read their input again."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from wakelens.functions import text as tx
from wakelens.functions.alignment import char_distance
from wakelens.operators import sampling as sm


def by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, row[j - 1] + (x != y), new[-1] + 1))
        row = new
    return row[-1]


def test_character_distance_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 9, 63, 64, 65, 128, 129, 190])))
    pairs = [(text(s), text(s)) for s in ("ab ", "aé😀ÿþ") for _ in range(60)] + [("x" * 1100, "x" * 1030 + "y")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)] + [(-1, None, "a"), (-2, "a", None)], "k int, r string, h string").coalesce(2)
    found = df.select("k", char_distance(F.col("r"), F.col("h")).alias("d"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()
    got = dict(found.collect())
    assert got.pop(-1) is None and got.pop(-2) is None
    assert got == {k: by_hand(*p) for k, p in enumerate(pairs)}


def test_smoke_subset_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def visit(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("speaker"), (F.col("id") % 50 / 4.0).alias("duration_sec"))
    rows = rows.mapInPandas(visit, rows.schema)
    assert len(sm.smoke_subset(rows, "speaker", "duration_sec", "id", count=20).collect()) == 20
    assert seen.value == 300


def test_owned_clips_carry_only_what_is_asked_for(spark):
    from wakelens.plans import bindings

    plan = lambda *names: bindings.owned_clips(spark, "/root/testdata/sf0.001", *names)._jdf.queryExecution().executedPlan().toString()
    counted = plan("label", "prompt_group")
    assert not any(c in counted for c in ("l_shipdate", "l_extendedprice", "sha2", "concat_ws"))
    assert "l_suppkey" in plan("phrase_id") and "l_quantity" not in plan("phrase_id")


def test_owned_clips_are_told_apart_by_one_sort(spark, tmp_path, monkeypatch):
    from wakelens.plans import bindings

    monkeypatch.setattr(bindings, "SORTED_LINES", 0.5)  # two tasks a line
    lines = "1 1, 1 1, 1 2, 2 1, 2 1, 2 1, 3 9".split(", ")
    lines = [tuple(map(int, x.split())) for x in lines]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 8), (4, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = bindings.owned_clips(spark, str(tmp_path), "label", "prompt_group")
    assert sorted((r.alias, r.label, r.prompt_group) for r in out.collect()) == [(7, 1, "P1"), (7, 1, "P2"), (8, 1, "P1")]
    # Two hash tables of a whole partition, one for each half of an aggregate, would come before the join's sort.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "l_orderkey" in plan and ", 14), REPARTITION_BY_NUM" in plan


def test_scoring_forms_search_no_negated_class(spark):
    rng = random.Random(7)
    letters = [chr(i) for i in range(128)] + list("aaabz09''  \u00e4\u00df\u00a0\u0085\u2003\u4e2d\U0001f600")
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 7, 200]))) for _ in range(300)] + ["", " ", "''", "a", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tx.parity_form(F.col("t")).alias("p"), tx.scoring_form(F.col("t"), normalise=False).alias("s"))
    assert "[^a-z0-9']" not in df._jdf.queryExecution().toString()
    for k, parity, scoring in df.collect():
        lowered = "".join(c.lower() if c.isascii() else c for c in texts[k] or "")
        assert parity == re.sub("[^a-z0-9']+", " ", lowered).strip(" "), k
        inner = re.sub("'(?:(?![a-z0-9])|(?<![a-z0-9]'))", " ", lowered.replace("`", "'"))
        assert scoring == re.sub("[^a-z0-9']+", " ", inner).strip(" "), k


def test_config_search_scores_clips_with_the_same_windows_once(spark):
    from wakelens.operators import config_search as cf

    clips = [("a", k % 2, k % 5, [(1, 0.9, 0.5, 0.3), (2, 0.4, 0.1, 0.9)][: k % 3] or None) for k in range(600)]
    schema = "variant string, label int, fold int, tried array<struct<rank:int,stage2_score:double,l1:double,l2:double>>"
    found = spark.createDataFrame(clips, schema)
    seen = spark.sparkContext.accumulator(0)
    coded, plain = cf.coded_scores, {}

    def counting(candidates, grid, keep):
        seen.add(candidates.count())
        plain["rows"] = coded(candidates, grid, keep).groupBy("config", "label", "fold", "score").agg(F.sum("clips").alias("n")).collect()
        return coded(candidates, grid, keep)

    cf.coded_scores = counting
    try:
        roles = lambda df: df.withColumn("role", F.explode(F.array(F.lit("dev"), F.lit("test"))))
        out = cf.search(found, cf.config_grid(), roles).collect()
    finally:
        cf.coded_scores = coded
    assert len(out) == 52 and seen.value == 30
    grid = cf.config_grid()
    for code, (k, a, b, g) in enumerate(grid):
        want = {}
        for _, label, fold, tried in clips:
            score = max(((a * t[3] + b * t[2]) if g else t[1] for t in (tried or [])[:k]), default=-1e9)
            want[label, fold, score] = want.get((label, fold, score), 0) + 1
        assert {(r.label, r.fold, r.score): r.n for r in plain["rows"] if r.config == code} == want


def test_config_search_counts_exact_scores_in_few_bins_only(spark):
    from pyspark.sql import DataFrame

    from wakelens.operators import config_search as cf
    from wakelens.operators.thresholds import safe_f1, sweep_histogram

    rng = random.Random(5)
    rows = []
    for k in range(4000):
        label, fold = rng.randrange(2), rng.randrange(4)
        # Folds: separable, mixed, without negatives, and (in part) without windows.
        lift = (3.0 * label, 0.3 * label, 0.0, 1.0 * label)[fold]
        tried = [(r + 1, rng.random(), rng.gauss(0, 2), rng.gauss(lift, 1)) for r in range(rng.randrange(4))]
        rows.append(("ab"[k % 2], 1 if fold == 2 else label, fold, tried if fold < 3 or k % 2 else []))
    schema = "variant string, label int, fold int, tried array<struct<rank:int,stage2_score:double,l1:double,l2:double>>"
    found = spark.createDataFrame(rows, schema)
    grid = cf.config_grid()[:9]
    roles = lambda df: df.withColumn("role", F.explode(F.array(F.lit("dev"), F.lit("test"))))
    written, cut = [], cf.cut

    def counting(df: DataFrame) -> DataFrame:
        out = cut(df)
        written.append((df.columns, out.count()))
        return out

    cf.cut = counting
    try:
        out = cf.search(found, grid, roles).collect()
    finally:
        cf.cut = cut
    kinds = found.withColumn("clips", F.lit(1))
    scores = cf.coded_scores(kinds, grid, ["variant", "label", "fold", "clips"]).withColumns({"pos": F.col("label").cast("long"), "neg": 1 - F.col("label").cast("long")})
    histogram = cut(scores.groupBy("variant", "config", "fold", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    assert sum(n for columns, n in written if "score" in columns) < histogram.count() / 4
    keys = ["variant", "config", "fold"]
    best = safe_f1(sweep_histogram(histogram, keys, grid=401, span="data", bucket=F.floor("score"), floor=-1.0e8), keys)
    hits = histogram.join(best.select(*keys, "threshold"), keys, "left").withColumn("hit", F.col("score") >= F.coalesce("threshold", F.lit(0.5)))
    totals = hits.groupBy("variant", "config").agg(*[F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0)).alias(c) for c in ("pos", "neg")], F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    want = {(r.variant, *grid[r.config]): (r.pos / r.p, r.neg / r.n) for r in totals.collect()}
    assert {tuple(r[c] for c in cf.CONFIG): (r.dev_recall, r.test_false_positive_rate) for r in out} == want and len(want) == 18


def test_fits_need_no_install_on_executors():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from wakelens.operators import fewshot as fs

    sent = cloudpickle.dumps(fs._fit(fs.finetune_grid()))
    load = "import pickle, sys; pickle.load(sys.stdin.buffer)"
    done = subprocess.run([sys.executable, "-I", "-c", load], input=sent, capture_output=True, cwd="/")
    assert done.returncode == 0, done.stderr.decode()
