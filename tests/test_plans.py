"""Named plans against their SQL on DuckDB."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

QUICK = """jn3_enriched_predictions win4_clip_cascade win5_fused_scores agg2_ranking_metrics agg3_metric_breakdowns agg5_paired_delta
win14_safe_f1_threshold win16_operating_points cv7_outer_test_report prj3_label_mapping prj4_canonical_samples prj7_effective_flags
prj10_scoring_normalisers prj14_privacy_scan agg12_duplicate_members agg13_duplicate_policy agg10_split_counters agg14_leakage win7_sequential_ids
win19_speaker_splits win20_duplicate_reconciliation win8_stratified_cap cv2_fold_objective cv6_role_access prj11_nested_transcripts
agg8_latency_summary agg19_character_errors jn7_run_comparison win11_smoke_subset win12_systematic_sample win10_nested_supports jn10_source_replay
fs3_support_cohesion fs11_adapted_metrics fs13_recipe_selection agg17_account_rollup jn14_erasure_kept snk4_export_warnings src1_jsonl_state
src3_canonical_files snk2_keyword_rows str1_trigger_states str1_trigger_stream str2_rolling_transcript str5_sliding_stream win21_window_placement
win24_segments agg22_training_history""".split()


@pytest.fixture(scope="module")
def duck():
    import compare

    return compare.duck(SF_DIR)


def _names():
    import __spark_entry__ as entry

    return list(entry.queries())


def pytest_generate_tests(metafunc):
    if "plan_name" in metafunc.fixturenames:
        every = metafunc.config.getoption("--all-plans")
        metafunc.parametrize("plan_name", _names() if every else QUICK)


def test_plan_matches_sql(spark, duck, plan_name):
    import compare
    import __spark_entry__ as entry

    state, _, _, note = compare.check(spark, duck, SF_DIR, plan_name, entry.queries()[plan_name], entry.oracle_sql().get(plan_name))
    assert state in ("ok", "rows-only"), note


def test_every_sql_has_a_plan():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
