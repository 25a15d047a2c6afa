"""Recognition scoring, run comparison and run health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.alignment import char_distance, word_edits
from ..functions.numeric import ratio


def aligned(rows: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Add substitutions, deletions, insertions and reference words per row.

    Pairs are aligned by the batch; of equal pairs no text is sent.
    """
    same = F.col(reference) == F.col(hypothesis)
    counts = word_edits(F.when(~same, F.col(reference)), F.when(~same, F.col(hypothesis)))
    staged = rows.withColumn("_align", counts)
    return staged.withColumns(
        {
            **{c: F.col(f"_align.{c}") for c in ("substitutions", "deletions", "insertions")},
            "reference_words": F.size(tx.words(F.col(reference))).cast("long"),
        }
    ).drop("_align")


def corpus_word_errors(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled and per-key word error; null without reference words."""
    edits = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    sums = scored.rollup(*keys).agg(
        *[F.sum(c).alias(c) for c in ("substitutions", "deletions", "insertions", "reference_words")],
        F.count_if(edits > 0).alias("sentence_errors"),
        F.count(F.lit(1)).alias("total_sentences"),
    )
    total = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return sums.withColumns(
        {
            "wer": ratio(total, F.col("reference_words")),
            "sentence_error_rate": ratio(F.col("sentence_errors"), F.col("total_sentences")),
            "exact_match_rate": ratio(F.col("total_sentences") - F.col("sentence_errors"), F.col("total_sentences")),
        }
    )


def exact_rates(rows: DataFrame, keys: Sequence[str], reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Sentence rates and reference words: no alignment is needed for these."""
    exact = F.col(reference) == F.col(hypothesis)
    out = rows.rollup(*keys).agg(
        F.count(F.lit(1)).alias("total_sentences"),
        F.count_if(~exact).alias("sentence_errors"),
        F.sum(F.size(tx.words(F.col(reference)))).cast("long").alias("reference_words"),
    )
    return out.withColumn(
        "exact_match_rate", ratio(F.col("total_sentences") - F.col("sentence_errors"), F.col("total_sentences"))
    )


def character_errors(rows: DataFrame, keys: Sequence[str], reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    ref, hyp = tx.collapse(F.col(reference)), tx.collapse(F.col(hypothesis))
    staged = rows.select(*keys, char_distance(ref, hyp).alias("_e"), F.length(ref).alias("_c"))
    out = staged.rollup(*keys).agg(
        F.sum("_e").cast("long").alias("character_edits"), F.sum("_c").cast("long").alias("reference_characters")
    )
    return out.withColumn("cer", ratio(F.col("character_edits"), F.col("reference_characters")))


def successes(run: DataFrame) -> DataFrame:
    return run.where(F.col("status") == "success")


def paired_runs(base: DataFrame, candidate: DataFrame, cols: Sequence[str], key: str = "id") -> DataFrame:
    """Full outer join of the successful rows with presence flags."""
    left = successes(base).select(key, *[F.col(c).alias(f"base_{c}") for c in cols], F.lit(True).alias("_base"))
    right = successes(candidate).select(key, *[F.col(c).alias(f"cand_{c}") for c in cols], F.lit(True).alias("_cand"))
    both = left.join(right, key, "full")
    return both.withColumns({"in_base": F.col("_base").isNotNull(), "in_cand": F.col("_cand").isNotNull()}).drop(
        "_base", "_cand"
    )


def comparison_summary(pairs: DataFrame, base_error: str, cand_error: str) -> DataFrame:
    """Who is on which side, and how the shared utterances changed."""
    both = F.col("in_base") & F.col("in_cand")
    delta = F.col(cand_error) - F.col(base_error)
    out = pairs.agg(
        F.count_if(both).alias("common_successes"),
        F.count_if(F.col("in_base") & ~F.col("in_cand")).alias("baseline_only"),
        F.count_if(F.col("in_cand") & ~F.col("in_base")).alias("candidate_only"),
        F.count_if(both & (delta < 0)).alias("improved"),
        F.count_if(both & (delta > 0)).alias("degraded"),
        F.count_if(both & (delta == 0)).alias("unchanged"),
        F.sum(F.when(both, F.col(base_error))).cast("long").alias("baseline_errors"),
        F.sum(F.when(both, F.col(cand_error))).cast("long").alias("candidate_errors"),
    )
    formal = (F.col("baseline_only") == 0) & (F.col("candidate_only") == 0)
    return out.withColumn("comparison_mode", F.when(formal, "same_ids").otherwise("intersection_only"))


def worst(rows: DataFrame, error: str, key: str, count: int) -> DataFrame:
    """Top report: highest error, then highest id."""
    return rows.orderBy(F.col(error).desc(), F.col(key).desc()).limit(count)


def two_way_missing(transcripts: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side that is missing."""
    left = transcripts.select(key).distinct().withColumn("_t", F.lit(True))
    right = audio.select(key).distinct().withColumn("_a", F.lit(True))
    both = left.join(right, key, "full")
    missing = F.when(F.col("_a").isNull(), "missing_audio").when(F.col("_t").isNull(), "missing_transcript")
    return both.select(key, missing.alias("problem")).where(F.col("problem").isNotNull())


def pending(manifest: DataFrame, predictions: DataFrame, key: str, *, retry_failed: bool) -> DataFrame:
    """Manifest rows still to do; failures count as done unless retried."""
    done = predictions.where(F.col("status") == "success") if retry_failed else predictions
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def last_row_wins(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Newest row per id as a partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_last"), F.count(F.lit(1)).alias("versions"))
    return out.select(key, "_last.*", "versions")


def known_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both sets; a blind export needs none."""
    return a.select(key).intersect(b.select(key))


def run_health(run: DataFrame, manifest: DataFrame, key: str, hypothesis: str, path: str) -> DataFrame:
    """Rows, failures, malformed texts, repeated ids and id-set equality."""
    ids = run.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("status") != "success").alias("_failed"),
        F.count_if(tx.looks_like_repr(F.coalesce(F.col(hypothesis), F.lit("")))).alias("_bad"),
    )
    wanted = manifest.select(key).distinct().withColumn("_m", F.lit(True))
    joined = ids.join(wanted, key, "full")
    out = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_failed"), F.lit(0)).alias("failures"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("malformed"),
        F.count_if(F.col("_n") > 1).alias("repeated_ids"),
        F.count_if(F.col("_n").isNull()).alias("missing_ids"),
        F.count_if(F.col("_m").isNull()).alias("unknown_ids"),
    )
    paths = run.where(F.col(path).isNotNull()).agg(F.count_distinct(path).alias("paths"))
    clean = [F.col(c) == 0 for c in ("failures", "malformed", "repeated_ids", "missing_ids", "unknown_ids")]
    verified = clean[0]
    for c in clean[1:]:
        verified = verified & c
    status = F.when(verified, "verified").otherwise("invalid_or_incomplete")
    return out.withColumn("status", status).crossJoin(F.broadcast(paths))


def extraction_paths(run: DataFrame, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every path transcripts were taken from, with its rows and failures; one row a path, however many rows."""
    return run.where(F.col(path).isNotNull()).groupBy(path, *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") != "success").alias("failures")
    )


def manifest_summary(rows: DataFrame) -> DataFrame:
    """Utterances, speakers, chapters and hours from one pre-aggregate."""
    chapters = rows.groupBy("speaker", "chapter").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("duration_sec").alias("_s"),
        F.min("duration_sec").alias("_lo"),
        F.max("duration_sec").alias("_hi"),
    )
    speakers = chapters.groupBy("speaker").agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_c"),
        F.sum("_s").alias("_s"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
    )
    return speakers.agg(
        F.sum("_n").alias("utterances"),
        F.count(F.lit(1)).alias("speakers"),
        F.sum("_c").alias("chapters"),
        (F.sum("_s") / 3600.0).alias("duration_hours"),
        F.min("_lo").alias("min_duration_sec"),
        F.max("_hi").alias("max_duration_sec"),
    )


def transcript_parity(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """Exact and normalised matches and word distance between two runs."""
    left = a.select(key, F.col(text).alias("_a"))
    right = b.select(key, F.col(text).alias("_b"))
    pairs = left.join(right, key).withColumns({"_na": tx.parity_form(F.col("_a")), "_nb": tx.parity_form(F.col("_b"))})
    scored = aligned(pairs, "_na", "_nb")
    distance = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_a") == F.col("_b")).alias("exact_matches"),
        F.count_if(F.col("_na") == F.col("_nb")).alias("normalised_matches"),
        F.sum(distance).alias("word_edit_distance"),
        F.max(distance).alias("max_word_edit_distance"),
    )
