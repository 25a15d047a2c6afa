"""Recognition scoring, comparison and subset plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.alignment import char_distance
from ..functions.transcripts import extract_transcript
from ..operators import asr
from ..operators import manifest as mf
from ..operators import metrics as mt
from ..operators import sampling as sm
from ..session import cut, spread
from .bindings import GROUPS, RUN_A, RUN_B, UTTERANCES_SQL, WINDOWS_SQL, recognised, table, utterances, windows, with_ctes
from .registry import plan

U = with_ctes(UTTERANCES_SQL)


def one_run(spark, sf_dir):
    return recognised(utterances(spark, sf_dir), RUN_A)


def runs(spark, sf_dir):
    """Two runs over one set of utterances, normalised and written once."""
    utts = spread(cut(utterances(spark, sf_dir)))
    return recognised(utts, RUN_A), recognised(utts, RUN_B)


RESULT_SQL = """CASE WHEN status = 'failed' THEN 'bad' WHEN chapter % 5 = 0 THEN 'flat' WHEN chapter % 5 = 1 THEN 'listed'
  WHEN chapter % 5 = 2 THEN 'nested' WHEN chapter % 5 = 3 THEN 'repr' ELSE 'deep' END"""


def results(run):
    """Recogniser results of several shapes as JSON text."""
    hyp = F.col("hypothesis")
    flat = F.to_json(F.struct(hyp.alias("text"), F.lit("en").alias("language")))
    listed = F.to_json(F.array(F.struct(hyp.alias("transcript"))))
    nested = F.to_json(F.struct(F.struct(hyp.alias("prediction")).alias("output")))
    shown = F.to_json(F.struct(F.lit("<Result object at 0x7f3a>").alias("text"), hyp.alias("hypothesis")))
    deep = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(hyp.alias("text"))).alias("prediction"))).alias("output")))
    chapter = F.col("chapter") % 5
    shape = F.when(chapter == 0, flat).when(chapter == 1, listed).when(chapter == 2, nested).when(chapter == 3, shown)
    bad = F.to_json(F.struct(F.lit(" ").alias("text")))
    return run.withColumn("result", F.when(F.col("status") == "failed", bad).otherwise(shape.otherwise(deep)))


def parity_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9'']+', ' ', 'g'))"


INS, DEL, SUB = (1 << 42) + (1 << 21), (1 << 42) + 1, 1 << 42
FIELD = (1 << 21) - 1


def edits_sql(run: str, name: str, reference: str = "reference", hypothesis: str = "hypothesis", where: str = "status = 'success'") -> str:
    """CTE ``name``: least packed edits of every row of ``run``, by recursion over the reference's words."""
    lists = f"""{name}_p AS MATERIALIZED (SELECT *, list_filter(string_split({reference}, ' '), lambda x: x <> '') AS rw, list_filter(string_split({hypothesis}, ' '), lambda x: x <> '') AS hw, row_number() OVER () AS pair FROM {run} WHERE {where})"""
    cell = f"least(c[e[1] + 1] + {DEL}, c[e[1]] + CASE WHEN hw[e[1]] = rw[i + 1] THEN 0 ELSE {SUB} END, acc[e[1]] + {INS})"
    walk = f"""{name}_w AS (SELECT pair, 0::BIGINT AS i, rw, hw, list_transform(range(0, len(hw) + 1), lambda j: j * {INS}) AS c FROM {name}_p WHERE rw <> hw
  UNION ALL SELECT pair, i + 1, rw, hw, list_reduce(list_prepend([c[1] + {DEL}], list_transform(range(1, len(hw) + 1), lambda j: [j])), lambda acc, e: list_append(acc, {cell})) FROM {name}_w WHERE i < len(rw))"""
    out = f"""{name} AS (SELECT p.*, coalesce(c[len(p.hw) + 1], 0) AS packed, packed >> 42 AS edits, (packed >> 21) & {FIELD} AS insertions, packed & {FIELD} AS deletions,
  edits - insertions - deletions AS substitutions, len(p.rw)::BIGINT AS reference_words
  FROM {name}_p p LEFT JOIN {name}_w w ON w.pair = p.pair AND w.i = len(w.rw))"""
    return f"{lists},\n{walk},\n{out}"


@plan(
    "prj11_nested_transcripts",
    U
    + f""", k AS (SELECT *, {RESULT_SQL} AS kind FROM run_a)
SELECT id, CASE WHEN kind = 'bad' THEN NULL ELSE hypothesis END AS text, CASE kind WHEN 'flat' THEN '$[''text'']' WHEN 'bad' THEN '$[''text'']'
  WHEN 'listed' THEN '$[0][''transcript'']' WHEN 'nested' THEN '$[''output''][''prediction'']' WHEN 'repr' THEN '$[''hypothesis'']'
  ELSE '$[''output''][0][''prediction''][0][''text'']' END AS extraction_path, CASE WHEN kind = 'bad' THEN 'empty' END AS extraction_error FROM k""",
)
def _prj11(spark, sf_dir):
    """PRJ11: transcript and extraction path from nested results."""
    out = extract_transcript(results(one_run(spark, sf_dir)), "result")
    return out.select("id", "text", "extraction_path", "extraction_error")


@plan(
    "prj12_malformed_hypotheses",
    U
    + f""", k AS (SELECT *, {RESULT_SQL} AS kind FROM run_a)
SELECT kind IN ('repr', 'deep') AS malformed, count(*) AS n, count(DISTINCT speaker) AS speakers FROM k GROUP BY 1""",
)
def _prj12(spark, sf_dir):
    """PRJ12: hypotheses that hold a stringified object."""
    run = one_run(spark, sf_dir)
    chapter = F.col("chapter") % 5
    shown = (
        F.when((chapter == 3) & (F.col("status") != "failed"), F.concat(F.lit("<Result object at 0x7f3a> "), "hypothesis"))
        .when((chapter == 4) & (F.col("status") != "failed"), F.concat(F.lit("ASRTranscription(text="), "hypothesis"))
        .otherwise(F.col("hypothesis"))
    )
    flagged = run.select("speaker", tx.looks_like_repr(shown).alias("malformed"))
    return flagged.groupBy("malformed").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("speaker").alias("speakers")
    )


@plan(
    "agg18_word_errors",
    U
    + ", "
    + edits_sql("run_a", "ea")
    + """, x AS (SELECT split, speaker, CAST(sum(substitutions) AS BIGINT) AS substitutions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(insertions) AS BIGINT) AS insertions,
  CAST(sum(reference_words) AS BIGINT) AS reference_words, count(*) FILTER (WHERE edits > 0) AS sentence_errors, count(*) AS total_sentences FROM ea GROUP BY ROLLUP (split, speaker))
SELECT *, round((substitutions + deletions + insertions) / nullif(reference_words, 0)::DOUBLE, 6) AS wer, round(sentence_errors / total_sentences::DOUBLE, 6) AS sentence_error_rate,
  round((total_sentences - sentence_errors) / total_sentences::DOUBLE, 6) AS exact_match_rate FROM x""",
)
def _agg18(spark, sf_dir):
    """AGG18 and UDF1: corpus word errors pooled, per split and speaker."""
    run = asr.successes(one_run(spark, sf_dir))
    return asr.corpus_word_errors(asr.aligned(run), ["split", "speaker"])


@plan(
    "agg18_sentence_rates",
    U
    + """, x AS (SELECT split, speaker, count(*) AS total_sentences, count(*) FILTER (WHERE reference <> hypothesis) AS sentence_errors,
  CAST(sum(len(string_split(reference, ' '))) AS BIGINT) AS reference_words FROM run_a WHERE status = 'success' GROUP BY ROLLUP (split, speaker))
SELECT *, round((total_sentences - sentence_errors) / total_sentences::DOUBLE, 6) AS exact_match_rate FROM x""",
)
def _agg18_rates(spark, sf_dir):
    """AGG18: sentence rates and reference words."""
    return asr.exact_rates(asr.successes(one_run(spark, sf_dir)), ["split", "speaker"])


@plan(
    "agg19_character_errors",
    U
    + """, x AS (SELECT split, CAST(sum(levenshtein(reference, hypothesis)) AS BIGINT) AS character_edits,
  CAST(sum(length(reference)) AS BIGINT) AS reference_characters FROM run_a WHERE status = 'success' GROUP BY ROLLUP (split))
SELECT *, round(character_edits / reference_characters::DOUBLE, 6) AS cer FROM x""",
)
def _agg19(spark, sf_dir):
    """AGG19: corpus character errors."""
    return asr.character_errors(asr.successes(one_run(spark, sf_dir)), ["split"])


@plan(
    "agg20_run_health",
    U
    + """, k AS (SELECT *, chapter % 5 = 3 AND status <> 'failed' AS bad FROM run_a UNION ALL SELECT *, false FROM run_b WHERE status = 'failed'),
i AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE status <> 'success') AS f, count(*) FILTER (WHERE bad) AS b FROM k GROUP BY id),
m AS (SELECT id FROM run_b WHERE status = 'success')
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(f) AS BIGINT) AS failures, CAST(sum(b) AS BIGINT) AS malformed,
  count(*) FILTER (WHERE n > 1) AS repeated_ids, count(*) FILTER (WHERE n IS NULL) AS missing_ids,
  count(*) FILTER (WHERE m.id IS NULL) AS unknown_ids, 'invalid_or_incomplete' AS status, CAST(2 AS BIGINT) AS paths
FROM i FULL JOIN m ON i.id = m.id""",
)
def _agg20(spark, sf_dir):
    """AGG20: health of a run that repeats and misses ids."""
    a, b = runs(spark, sf_dir)
    bad = (F.col("chapter") % 5 == 3) & (F.col("status") != "failed")
    shown = F.when(bad, F.lit("<Result object at 0x7f3a>")).otherwise(F.col("hypothesis"))
    run = a.withColumn("hypothesis", shown).withColumn("path", F.lit("$['text']"))
    run = run.unionByName(b.where(F.col("status") == "failed").withColumn("path", F.lit("$")))
    return asr.run_health(run, asr.successes(b), "id", "hypothesis", "path")


@plan(
    "agg20_extraction_paths",
    U
    + """SELECT '$[''text'']' AS path, speaker, count(*) AS rows, count(*) FILTER (WHERE status <> 'success') AS failures FROM run_a GROUP BY speaker
UNION ALL SELECT '$', speaker, count(*), count(*) FROM run_b WHERE status = 'failed' GROUP BY speaker""",
)
def _agg20_paths(spark, sf_dir):
    """AGG20: the paths transcripts were taken from, with rows and failures per speaker."""
    a, b = runs(spark, sf_dir)
    run = a.withColumn("path", F.lit("$['text']")).unionByName(b.where(F.col("status") == "failed").withColumn("path", F.lit("$")))
    return asr.extraction_paths(run, "path", ["speaker"])


@plan(
    "agg24_transcript_parity",
    U
    + """SELECT count(*) AS n, count(*) FILTER (WHERE a.hypothesis = b.hypothesis) AS exact_matches,
  count(*) FILTER (WHERE a.hypothesis = b.hypothesis) AS normalised_matches FROM run_a a JOIN run_b b USING (id)""",
)
def _agg24_text(spark, sf_dir):
    """AGG24: exact and normalised transcript matches of two runs."""
    a, b = runs(spark, sf_dir)
    left, right = a.select("id", F.col("hypothesis").alias("x")), b.select("id", F.col("hypothesis").alias("y"))
    return left.join(right, "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x") == F.col("y")).alias("exact_matches"),
        F.count_if(tx.parity_form(F.col("x")) == tx.parity_form(F.col("y"))).alias("normalised_matches"),
    )


@plan(
    "agg24_transcript_distance",
    U
    + f""", ab AS (SELECT a.id, a.hypothesis AS a, b.hypothesis AS b, {parity_sql('a.hypothesis')} AS na, {parity_sql('b.hypothesis')} AS nb FROM run_a a JOIN run_b b USING (id)),
"""
    + edits_sql("ab", "ed", "coalesce(na, '')", "coalesce(nb, '')", "true")
    + """ SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS exact_matches, count(*) FILTER (WHERE na = nb) AS normalised_matches,
  CAST(sum(edits) AS BIGINT) AS word_edit_distance, max(edits) AS max_word_edit_distance FROM ed""",
)
def _agg24_distance(spark, sf_dir):
    """AGG24: word distance between the transcripts of two runs."""
    a, b = runs(spark, sf_dir)
    return asr.transcript_parity(a, b, "id", "hypothesis")


@plan(
    "agg27_manifest_summary",
    U
    + """SELECT count(*) AS utterances, count(DISTINCT speaker) AS speakers, count(DISTINCT (speaker, chapter)) AS chapters,
  round(sum(duration_sec) / 3600.0, 6) AS duration_hours, round(min(duration_sec), 6) AS min_duration_sec,
  round(max(duration_sec), 6) AS max_duration_sec FROM utts""",
)
def _agg27(spark, sf_dir):
    """AGG27: manifest summary."""
    return asr.manifest_summary(utterances(spark, sf_dir))


@plan(
    "agg8_latency_summary",
    U
    + """, o AS (SELECT split, latency_sec AS v, row_number() OVER (PARTITION BY split ORDER BY latency_sec) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM run_a)
SELECT split, max(n) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
  round(max(v) FILTER (WHERE i = round_even((n - 1) * 0.9::DOUBLE, 0)), 6) AS p90,
  round(max(v) FILTER (WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)), 6) AS p95, round(max(v), 6) AS max,
  round(stddev_samp(v), 6) AS std FROM o GROUP BY split""",
)
def _agg8(spark, sf_dir):
    """AGG8: exact latency statistics."""
    return mt.latency_summary(one_run(spark, sf_dir), ["split"], "latency_sec")


@plan(
    "agg8_real_time_factor",
    U
    + """SELECT split, round(avg(latency_sec / duration_sec), 6) AS mean_rtf, round(max(latency_sec / duration_sec), 6) AS max_rtf,
  round(sum(latency_sec) / sum(duration_sec), 6) AS aggregate_rtf FROM run_a GROUP BY split""",
)
def _agg8_rtf(spark, sf_dir):
    """AGG8: real-time factors."""
    rtf = F.col("latency_sec") / F.col("duration_sec")
    return (
        one_run(spark, sf_dir)
        .groupBy("split")
        .agg(
            F.avg(rtf).alias("mean_rtf"),
            F.max(rtf).alias("max_rtf"),
            (F.sum("latency_sec") / F.sum("duration_sec")).alias("aggregate_rtf"),
        )
    )


@plan(
    "jn7_run_comparison",
    U
    + """, x AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib,
  levenshtein(a.reference, a.hypothesis) AS ea, levenshtein(b.reference, b.hypothesis) AS eb
  FROM (SELECT * FROM run_a WHERE status = 'success') a FULL JOIN (SELECT * FROM run_b WHERE status = 'success') b ON a.id = b.id)
SELECT count(*) FILTER (WHERE ia AND ib) AS common_successes, count(*) FILTER (WHERE ia AND NOT ib) AS baseline_only,
  count(*) FILTER (WHERE ib AND NOT ia) AS candidate_only, count(*) FILTER (WHERE ia AND ib AND eb < ea) AS improved,
  count(*) FILTER (WHERE ia AND ib AND eb > ea) AS degraded, count(*) FILTER (WHERE ia AND ib AND eb = ea) AS unchanged,
  CAST(sum(ea) FILTER (WHERE ia AND ib) AS BIGINT) AS baseline_errors, CAST(sum(eb) FILTER (WHERE ia AND ib) AS BIGINT) AS candidate_errors,
  'intersection_only' AS comparison_mode FROM x""",
)
def _jn7(spark, sf_dir):
    """JN7: two runs compared by character edits on shared ids."""
    a, b = (r.withColumn("err", char_distance(F.col("reference"), F.col("hypothesis"))) for r in runs(spark, sf_dir))
    return asr.comparison_summary(asr.paired_runs(a, b, ["err"]), "base_err", "cand_err")


@plan(
    "jn7_word_error_change",
    U
    + ", "
    + edits_sql("run_a", "ea")
    + ",\n"
    + edits_sql("run_b", "eb")
    + """, x AS (SELECT a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib, a.edits AS ea, b.edits AS eb FROM ea a FULL JOIN eb b ON a.id = b.id)
SELECT count(*) FILTER (WHERE ia AND ib) AS common_successes, count(*) FILTER (WHERE ia AND NOT ib) AS baseline_only,
  count(*) FILTER (WHERE ib AND NOT ia) AS candidate_only, count(*) FILTER (WHERE ia AND ib AND eb < ea) AS improved,
  count(*) FILTER (WHERE ia AND ib AND eb > ea) AS degraded, count(*) FILTER (WHERE ia AND ib AND eb = ea) AS unchanged,
  CAST(sum(ea) FILTER (WHERE ia AND ib) AS BIGINT) AS baseline_errors, CAST(sum(eb) FILTER (WHERE ia AND ib) AS BIGINT) AS candidate_errors,
  'intersection_only' AS comparison_mode FROM x""",
)
def _jn7_words(spark, sf_dir):
    """JN7: the same comparison by word edits."""
    edits = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    a, b = (asr.aligned(asr.successes(r)).withColumn("err", edits) for r in runs(spark, sf_dir))
    return asr.comparison_summary(asr.paired_runs(a, b, ["err"]), "base_err", "cand_err")


@plan(
    "jn8_two_way_missing",
    U
    + """, t AS (SELECT id FROM run_a WHERE status = 'success'), a AS (SELECT id FROM run_b WHERE hypothesis NOT LIKE '%zz%')
SELECT coalesce(t.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing_audio' ELSE 'missing_transcript' END AS problem
FROM t FULL JOIN a ON t.id = a.id WHERE a.id IS NULL OR t.id IS NULL""",
)
def _jn8(spark, sf_dir):
    """JN8: transcripts without audio and audio without transcript."""
    a, b = runs(spark, sf_dir)
    return asr.two_way_missing(asr.successes(a), b.where(~F.col("hypothesis").contains("zz")), "id")


@plan(
    "jn12_pending_work",
    U
    + """, p AS (SELECT * FROM run_a WHERE split = 'clean')
SELECT 'once' AS mode, count(*) AS n FROM utts WHERE id NOT IN (SELECT id FROM p) UNION ALL
SELECT 'retry_failed', count(*) FROM utts WHERE id NOT IN (SELECT id FROM p WHERE status = 'success')""",
)
def _jn12(spark, sf_dir):
    """JN12: manifest rows still to do, with and without retries."""
    utts = utterances(spark, sf_dir)
    done = recognised(utts, RUN_A).where(F.col("split") == "clean")
    parts = [
        asr.pending(utts, done, "id", retry_failed=retry).agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
        for mode, retry in (("once", False), ("retry_failed", True))
    ]
    return parts[0].unionByName(parts[1]).select("mode", "n")


@plan(
    "jn13_known_participants",
    """SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'fr'""",
)
def _jn13(spark, sf_dir):
    """JN13: participants a blind export must not share."""
    docs = table(spark, sf_dir, "documents")
    return asr.known_overlap(docs.where(F.col("lang") == "de"), docs.where(F.col("lang") == "fr"), "source")


@plan(
    "set2_id_sets",
    U
    + """, a AS (SELECT DISTINCT id FROM run_a WHERE status = 'success'), b AS (SELECT DISTINCT id FROM run_b WHERE status = 'success')
SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS common, count(*) FILTER (WHERE b.id IS NULL) AS only_left,
  count(*) FILTER (WHERE a.id IS NULL) AS only_right, false AS equal FROM a FULL JOIN b ON a.id = b.id""",
)
def _set2(spark, sf_dir):
    """SET2: intersection, differences and equality of id sets."""
    a, b = runs(spark, sf_dir)
    return mf.id_set_comparison(asr.successes(a), asr.successes(b), "id")


@plan(
    "srt3_worst_utterances",
    U
    + """SELECT id, speaker, CAST(levenshtein(reference, hypothesis) AS INT) AS edits FROM run_a WHERE status = 'success' ORDER BY edits DESC, id DESC LIMIT 100""",
)
def _srt3(spark, sf_dir):
    """SRT3: the hundred worst utterances."""
    run = asr.successes(one_run(spark, sf_dir)).withColumn("edits", char_distance(F.col("reference"), F.col("hypothesis")))
    return asr.worst(run.select("id", "speaker", "edits"), "edits", "id", 100)


@plan(
    "srt3_worst_by_word_error",
    U + ", " + edits_sql("run_a", "ea") + "SELECT id, speaker, round(edits / reference_words::DOUBLE, 6) AS wer FROM ea ORDER BY edits / reference_words::DOUBLE DESC, id DESC LIMIT 100",
)
def _srt3_words(spark, sf_dir):
    """SRT3: worst utterances by word error rate."""
    scored = asr.aligned(asr.successes(one_run(spark, sf_dir)))
    edits = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    rated = scored.select("id", "speaker", (edits / F.col("reference_words")).alias("wer"))
    return asr.worst(rated, "wer", "id", 100)


@plan(
    "win2_last_row_wins",
    U
    + """, r AS (SELECT *, 0 AS seq FROM run_a UNION ALL SELECT *, 1 FROM run_b WHERE split = 'other')
SELECT id, arg_max(hypothesis, seq) AS hypothesis, arg_max(status, seq) AS status, count(*) AS versions FROM r GROUP BY id""",
)
def _win2(spark, sf_dir):
    """WIN2: the last row of each id in ingest order."""
    a, b = runs(spark, sf_dir)
    cols = ["id", "hypothesis", "status"]
    rows = a.select(*cols, F.lit(0).alias("seq")).unionByName(b.where(F.col("split") == "other").select(*cols, F.lit(1).alias("seq")))
    return asr.last_row_wins(rows, "id", "seq").drop("seq")


@plan(
    "win11_smoke_subset",
    U
    + """, r AS (SELECT id, speaker, duration_sec, row_number() OVER (PARTITION BY speaker ORDER BY duration_sec, id) AS i, count(*) OVER (PARTITION BY speaker) AS n FROM utts),
lead AS (SELECT id, speaker FROM r WHERE i = n // 2 + 1 ORDER BY sha256('20260620:' || speaker), speaker LIMIT 64),
rest AS (SELECT id, speaker, (row_number() OVER (ORDER BY duration_sec, id) - 1) % 3 AS bin FROM r WHERE id NOT IN (SELECT id FROM lead)),
turn AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha256('20260620:' || id), id) AS t FROM rest),
both_ AS (SELECT id, speaker, 0 AS f, 0 AS t, 0 AS bin FROM lead UNION ALL SELECT id, speaker, 1, t, bin FROM turn)
SELECT id, speaker FROM both_ ORDER BY f, t, bin, id LIMIT 64""",
)
def _win11(spark, sf_dir):
    """WIN11: median row per speaker, filled from duration bins."""
    utts = utterances(spark, sf_dir).select("id", "speaker", "duration_sec")
    return sm.smoke_subset(utts, "speaker", "duration_sec", "id", count=64).select("id", "speaker")


QUOTAS = {GROUPS["P1"]: 20, GROUPS["P2"]: 20, GROUPS["P3"]: 20, GROUPS["P4"]: 40}


@plan(
    "win12_systematic_sample",
    with_ctes(WINDOWS_SQL)
    + """, q AS (SELECT *, CASE WHEN prompt_group = 'P4_negative' THEN 40 ELSE 20 END AS quota,
  row_number() OVER (PARTITION BY prompt_group ORDER BY clip_id, window_index) AS i, count(*) OVER (PARTITION BY prompt_group) AS n FROM w),
p AS (SELECT prompt_group, clip_id, quota, min(i) AS i FROM q WHERE (i - 1) % greatest(1, n // quota) = 0 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY prompt_group ORDER BY i) AS t FROM p QUALIFY t <= quota),
l AS (SELECT clip_id, prompt_group, 0 AS f, list_position(['P1', 'P2', 'P3', 'P4_negative'], prompt_group) AS g, i AS r FROM c),
o AS (SELECT clip_id, arg_min(prompt_group, window_index) AS prompt_group FROM w WHERE clip_id NOT IN (SELECT clip_id FROM c) GROUP BY clip_id ORDER BY clip_id LIMIT 120)
SELECT clip_id, prompt_group, f = 0 AS by_quota FROM (SELECT * FROM l UNION ALL SELECT clip_id, prompt_group, 1, 0, 0 FROM o) ORDER BY f, g, r, clip_id LIMIT 120""",
)
def _win12(spark, sf_dir):
    """WIN12: systematic sample with group quotas, then fill."""
    w = windows(spark, sf_dir).select("clip_id", "window_index", "prompt_group")
    step = F.substring("clip_id", 1, 4)
    return sm.systematic_sample(w, "prompt_group", "clip_id", ["clip_id", "window_index"], QUOTAS, step, total=120)
