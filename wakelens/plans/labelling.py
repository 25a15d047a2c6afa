"""Text, label, quality and privacy plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..operators import labels as lb
from ..operators import manifest as mf
from ..operators import metrics as mt
from ..operators import privacy as pv
from ..operators import quality as ql
from .bindings import (
    KEYWORD,
    STAR_SQL,
    TEXT_SQL,
    clips,
    collapse_sql,
    has_keyword_sql,
    labelled_text,
    match_form_sql,
    scoring_form_sql,
    table,
    texts,
    with_ctes,
)
from .registry import counts_sql, metric_sql, plan

GROUPS = lb.PromptGroups("P1", "P2", "P3", "P4_negative")
PHRASES = ("Then", "them", "there", "and the", "of", "der")
WORDS = ("then", "them", "there", "other", "these")
T = with_ctes(TEXT_SQL)


def digest(column):
    """Whole text as its sha256, to keep report rows narrow."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def recase_sql(expr: str, casing: str) -> str:
    edge = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
    mark = chr(1)  # a mark first, so neighbouring keywords are all found
    found = f"'(^|{edge})(?i:{KEYWORD})($|{edge})', '\\1{mark}\\2', 'g'"
    one = f"regexp_replace({collapse_sql(expr)}, {found})"
    return f"replace(regexp_replace({one}, {found}), '{mark}', '{casing}')"


@plan(
    "prj1_text_normalisers",
    T
    + f"""SELECT doc_id, sha256({collapse_sql('transcript')}) AS collapsed, sha256({recase_sql('transcript', 'THE')}) AS recased,
  sha256({match_form_sql('transcript')}) AS match_form FROM t""",
)
def _prj1(spark, sf_dir):
    """PRJ1: white space, keyword casing and matching form."""
    t, c = labelled_text(spark, sf_dir), F.col("transcript")
    return t.select(
        "doc_id",
        digest(tx.collapse(c)).alias("collapsed"),
        digest(tx.recase_keyword(c, KEYWORD)).alias("recased"),
        digest(tx.match_form(c)).alias("match_form"),
    )


@plan("prj2_keyword_predicate", T + f"SELECT doc_id, {has_keyword_sql('transcript')} AS has_keyword FROM t")
def _prj2(spark, sf_dir):
    """PRJ2: the exact keyword as a whole word, any case."""
    return labelled_text(spark, sf_dir).select("doc_id", tx.has_keyword(F.col("transcript"), KEYWORD).alias("has_keyword"))


def _phrase_sql(match: str, label: str) -> str:
    known = "['then', 'them', 'there', 'and the', 'of', 'der']"
    return f"""CASE WHEN {label} = 1 THEN 'the' WHEN list_contains({known}, {match}) THEN {match}
  WHEN list_contains({known}, string_split({match}, ' ')[1]) THEN string_split({match}, ' ')[1] ELSE 'background' END"""


MAPPED_SQL = f"""m0 AS (SELECT *, prompt_group = '' AS unknown,
  {recase_sql("CASE WHEN prompt_group = 'P1' THEN 'THE' ELSE coalesce(nullif(transcript, ''), CASE WHEN prompt_group = '' THEN 'legacy' ELSE '' END) END", 'THE')} AS said FROM t),
m1 AS (SELECT *, {has_keyword_sql('said')} AS has, {match_form_sql('said')} AS mf FROM m0),
m2 AS (SELECT *, CASE WHEN unknown THEN has ELSE prompt_group IN ('P1', 'P2', 'P3') END AS positive,
  NOT unknown AND prompt_group = 'P4_negative' AS negative FROM m1),
m AS (SELECT doc_id, clip_id, participant_id, lang, n_chars, CASE WHEN unknown THEN 'legacy' ELSE prompt_group END AS mapped_group, said, mf, CAST(positive AS INT) AS label, negative,
  {_phrase_sql('mf', 'CAST(positive AS INT)')} AS phrase_id,
  list_filter([CASE WHEN NOT unknown AND said = '' THEN 'missing_transcript' END,
   CASE WHEN prompt_group IN ('P2', 'P3') AND NOT has THEN 'positive_prompt_missing_exact_keyword' END,
   CASE WHEN negative AND has THEN 'negative_prompt_contains_exact_keyword' END,
   CASE WHEN NOT unknown AND contains_keyword <> positive THEN 'inconsistent_contains_keyword' END,
   CASE WHEN NOT unknown AND is_negative <> negative THEN 'inconsistent_is_negative' END], lambda x: x IS NOT NULL) AS reasons FROM m2)"""


def mapped(spark, sf_dir):
    return lb.map_labels(labelled_text(spark, sf_dir), KEYWORD, GROUPS, PHRASES)


@plan(
    "prj3_label_mapping",
    T
    + f""", {MAPPED_SQL} SELECT doc_id, mapped_group, label, negative AS mapped_negative, sha256(said) AS said, sha256(mf) AS match_form,
  array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM m""",
)
def _prj3(spark, sf_dir):
    """PRJ3: label mapping with quarantine reasons."""
    return mapped(spark, sf_dir).select(
        "doc_id",
        "mapped_group",
        "label",
        "mapped_negative",
        digest("mapped_transcript").alias("said"),
        digest("match_form").alias("match_form"),
        F.array_join("reasons", ",").alias("reasons"),
        (F.size("reasons") == 0).alias("accepted"),
    )


@plan("prj5_phrase_ids", T + f", {MAPPED_SQL} SELECT doc_id, phrase_id FROM m")
def _prj5(spark, sf_dir):
    """PRJ5: keyword, listed phrase, listed first word or background."""
    return mapped(spark, sf_dir).select("doc_id", "phrase_id")


INVENTORY_SQL = """files AS (SELECT DISTINCT clip_id FROM clips WHERE storage_id > 10)"""


def inventory(spark, sf_dir):
    """Clips with a stored file: all but those of the first few storages."""
    return clips(spark, sf_dir).where(F.col("storage_id") > 10).select("clip_id").distinct()


def sampled(spark, sf_dir):
    """Ids repeat in the clip table; the first row by ingest order counts."""
    firsts = lb.canonical_samples(clips(spark, sf_dir), "clip_id", "ingest")
    stored = inventory(spark, sf_dir).withColumn("_stored", F.lit(True))
    joined = firsts.join(stored, "clip_id", "left")
    reason = F.coalesce("sample_reason", F.when(F.col("_stored").isNull(), "missing_canonical_audio_member"))
    return joined.withColumn("sample_reason", reason).drop("_stored")


@plan(
    "prj4_canonical_samples",
    with_ctes(STAR_SQL)
    + f""", {INVENTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ingest) AS i FROM clips)
SELECT r.clip_id, r.created_at::VARCHAR AS at, prompt_id, CASE WHEN i > 1 THEN 'duplicate_clip_id_in_metadata'
  WHEN f.clip_id IS NULL THEN 'missing_canonical_audio_member' ELSE 'accepted' END AS outcome
FROM r LEFT JOIN files f USING (clip_id)""",
)
def _prj4(spark, sf_dir):
    """PRJ4: canonical samples and why the other rows are refused."""
    return sampled(spark, sf_dir).select(
        "clip_id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "prompt_id",
        F.coalesce("sample_reason", F.lit("accepted")).alias("outcome"),
    )


@plan(
    "prj6_legacy_backfill",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  CASE WHEN l_linenumber <= 3 THEN 'P' || l_linenumber WHEN l_linenumber <= 5 THEN 'legacy' ELSE '' END AS g,
  CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'said ' || l_suppkey END AS tr FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate::VARCHAR AS at, l_extendedprice,
  coalesce(nullif(g, ''), 'legacy') AS prompt_group, CAST(l_partkey AS VARCHAR) AS prompt_title,
  coalesce(nullif(tr, ''), p_name, CAST(l_partkey AS VARCHAR)) AS transcript,
  CASE WHEN g <> 'legacy' THEN false WHEN p_size > 25 THEN true ELSE false END AS contains_keyword,
  CASE WHEN g <> 'legacy' THEN false WHEN p_size > 40 THEN true ELSE false END AS wake_intent
FROM c LEFT JOIN (SELECT * FROM part WHERE p_retailprice < 1000 OR p_size > 10) ON p_partkey = l_partkey""",
)
def _prj6(spark, sf_dir):
    """PRJ6: backfill of legacy clips from the prompt catalogue."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "l_extendedprice",
        F.col("l_partkey").alias("prompt_id"),
        F.when(n <= 3, F.concat(F.lit("P"), n.cast("string"))).when(n <= 5, "legacy").otherwise("").alias("prompt_group"),
        F.lit("").alias("prompt_title"),
        F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("said "), F.col("l_suppkey").cast("string"))).alias("transcript"),
        F.lit("").alias("normalized_transcript"),
        F.lit(False).alias("contains_keyword"),
        F.lit(False).alias("wake_intent"),
        F.lit(None).cast("boolean").alias("is_negative"),
    )
    catalogue = table(spark, sf_dir, "part").where((F.col("p_retailprice") < 1000) | (F.col("p_size") > 10))
    prompts = catalogue.select(
        F.col("p_partkey").alias("prompt_id"),
        F.col("p_name").alias("expected_transcript"),
        (F.col("p_size") > 25).alias("contains_keyword"),
        (F.col("p_size") > 40).alias("wake_intent"),
    )
    out = lb.backfill_legacy(rows, prompts)
    return out.drop("prompt_id", "normalized_transcript", "is_negative")


@plan(
    "prj7_effective_flags",
    T
    + f""", f AS (SELECT doc_id, CASE WHEN is_negative THEN ['a_flag', 'z_flag'] WHEN contains_keyword THEN ['not json'] ELSE [] END AS stored,
  CASE WHEN lang = 'de' THEN 'auto_rejected' WHEN lang = 'fr' THEN 'flagged_for_review' ELSE 'auto_accepted' END AS st,
  [CASE WHEN transcript = '' THEN 'missing_transcript' END,
   CASE WHEN prompt_group IN ('P2', 'P3') AND NOT {has_keyword_sql('transcript')} THEN 'transcript_missing_keyword' END,
   CASE WHEN prompt_group = 'P4_negative' AND {has_keyword_sql('transcript')} THEN 'negative_transcript_contains_keyword' END,
   CASE WHEN n_chars > 4000 THEN 'missing_audio_file' END] AS derived FROM t),
e AS (SELECT doc_id, st, list_sort(list_distinct(list_filter(list_concat(stored, derived), lambda x: x IS NOT NULL))) AS fl FROM f)
SELECT doc_id, array_to_string(fl, ',') AS flags, CASE WHEN st = 'auto_rejected' THEN st WHEN len(fl) > 0 OR st = 'flagged_for_review'
  THEN 'flagged_for_review' ELSE 'auto_accepted' END AS status FROM e""",
)
def _prj7(spark, sf_dir):
    """PRJ7: effective QC flags and review status."""
    t = labelled_text(spark, sf_dir)
    stored = F.when(F.col("is_negative"), '["z_flag", "a_flag"]').when(F.col("contains_keyword"), "not json")
    path = F.when(F.col("n_chars") <= 4000, F.concat(F.lit("raw/"), "clip_id"))
    flags = ql.effective_flags(stored, F.col("transcript"), F.col("prompt_group"), path, KEYWORD, GROUPS)
    status = F.when(F.col("lang") == "de", ql.REJECTED).when(F.col("lang") == "fr", ql.FLAGGED).otherwise(ql.ACCEPTED)
    rows = t.select("doc_id", flags.alias("fl"), status.alias("st"))
    return rows.select(
        "doc_id", F.array_join("fl", ",").alias("flags"), ql.effective_status(F.col("st"), F.col("fl")).alias("status")
    )


@plan(
    "prj8_audio_rules",
    """WITH a AS (SELECT *, l_quantity / 10.0::DOUBLE AS du, l_discount / 2.0::DOUBLE AS rms, l_tax / 4.0::DOUBLE AS cl,
  CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_linenumber >= 4 THEN l_linenumber * 0.35 ELSE 0.35 END::DOUBLE AS lo,
  CASE WHEN l_returnflag = 'R' THEN 12.0 WHEN l_linenumber >= 4 THEN l_linenumber * 2.8 ELSE 8.0 END::DOUBLE AS hi,
  CAST(l_quantity AS INT) % 50 AS ns FROM lineitem),
f AS (SELECT l_returnflag, l_linenumber, list_sort(list_filter([CASE WHEN du < 0.3 THEN 'duration_less_than_0_3_sec' END,
  CASE WHEN du < lo THEN 'duration_much_shorter_than_expected' END, CASE WHEN du > hi THEN 'duration_much_longer_than_expected' END,
  CASE WHEN ns = 0 THEN 'empty_audio' END, CASE WHEN ns > 0 AND rms < 0.01 THEN 'very_low_volume' END,
  CASE WHEN ns > 0 AND cl > 0.01 THEN 'severe_clipping' END], lambda x: x IS NOT NULL)) AS fl FROM a)
SELECT array_to_string(fl, ',') AS flags, CASE WHEN list_has_any(fl, ['empty_audio', 'duration_less_than_0_3_sec', 'ffmpeg_conversion_failed'])
  THEN 'auto_rejected' WHEN len(fl) > 0 THEN 'flagged_for_review' ELSE 'auto_accepted' END AS status, count(*) AS n FROM f GROUP BY ALL""",
)
def _prj8(spark, sf_dir):
    """PRJ8: duration, volume and clipping rules."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "calibration").otherwise("prompt")
    low, high = ql.expected_bounds(kind, F.when(n >= 4, "repeat").otherwise("single"), n)
    samples = F.col("l_quantity").cast("int") % 50
    flags = ql.audio_flags(F.col("l_quantity") / 10.0, samples, F.col("l_discount") / 2.0, F.col("l_tax") / 4.0, low, high)
    rows = li.select(flags.alias("fl"))
    named = rows.select(F.array_join("fl", ",").alias("flags"), ql.audio_status(F.col("fl")).alias("status"))
    return named.groupBy("flags", "status").agg(F.count(F.lit(1)).alias("n"))


LEAK_SQL = " OR ".join(f"contains(x, '{t}')" for t in tx.LABEL_TOKENS)


@plan(
    "prj9_asr_targets",
    T
    + f""", x AS (SELECT doc_id, 'language English<asr_text>' || {recase_sql('transcript', 'THE')} AS x FROM t)
SELECT doc_id, sha256(x) AS target, {LEAK_SQL} AS leaks FROM x""",
)
def _prj9(spark, sf_dir):
    """PRJ9: recognition targets and label leakage."""
    rows = labelled_text(spark, sf_dir).select("doc_id", tx.asr_target(F.col("transcript"), KEYWORD).alias("x"))
    return rows.select("doc_id", digest("x").alias("target"), tx.leaks_label(F.col("x")).alias("leaks"))


@plan(
    "prj10_scoring_normalisers",
    f"""SELECT doc_id, sha256({scoring_form_sql('text')}) AS scoring, sha256({collapse_sql("translate(text, '‘’‛′ʼ`', '''''''''''''')")}) AS raw,
  sha256(trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'))) AS parity FROM documents""",
)
def _prj10(spark, sf_dir):
    """PRJ10: word-error, raw and parity normalisers over whole documents."""
    docs, c = texts(spark, sf_dir, "doc_id", "text"), F.col("text")
    return docs.select(
        "doc_id",
        digest(tx.scoring_form(c)).alias("scoring"),
        digest(tx.raw_scoring_form(c)).alias("raw"),
        digest(tx.parity_form(c)).alias("parity"),
    )


@plan(
    "prj13_pseudonyms",
    """SELECT c_custkey, 'spk_' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS speaker,
  CASE WHEN c_acctbal < 0 THEN '' ELSE 'id_' || substr(sha256('user' || c_custkey || '@mail.example'), 1, 10) END AS identity,
  sha256(c_name) AS hashed FROM customer""",
)
def _prj13(spark, sf_dir):
    """PRJ13: speaker, identity and clip pseudonyms."""
    c = table(spark, sf_dir, "customer")
    mail = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example")))
    return c.select(
        "c_custkey",
        hs.speaker_pseudonym(F.col("c_custkey")).alias("speaker"),
        hs.identity_pseudonym(mail).alias("identity"),
        F.sha2("c_name", 256).alias("hashed"),
    )


@plan(
    "prj14_privacy_scan",
    r"""WITH p AS (SELECT doc_id, text || ' spk_' || substr(sha256(source), 1, 12) AS text FROM documents),
h AS (SELECT doc_id, 'email' AS kind, len(regexp_extract_all(text, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}')) AS hits FROM p UNION ALL
SELECT doc_id, 'speaker_hash', len(regexp_extract_all(text, '\bspk_[0-9a-fA-F]{8,}\b')) FROM p UNION ALL
SELECT doc_id, 'long_hex', len(regexp_extract_all(text, '\b[A-Fa-f0-9]{40,}\b')) FROM p)
SELECT doc_id, kind, CAST(hits AS INT) AS hits FROM h WHERE hits > 0""",
)
def _prj14(spark, sf_dir):
    """PRJ14: private-looking values per document and kind."""
    tag = F.concat(F.lit(" "), hs.speaker_pseudonym(F.col("source")))
    docs = texts(spark, sf_dir, "doc_id", "source", "text").select("doc_id", F.concat("text", tag).alias("text"))
    return pv.require_public(pv.scan(docs, "doc_id", "text"))


@plan(
    "prj14_email_values",
    r"""SELECT doc_id, unnest(regexp_extract_all(text, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}')) AS value FROM documents""",
)
def _prj14_values(spark, sf_dir):
    """PRJ14: the matched e-mail-like values."""
    return pv.hits(texts(spark, sf_dir, "doc_id", "text"), "doc_id", "text", "email")


@plan(
    "prj15_hard_negatives",
    T
    + f""", {MAPPED_SQL} SELECT doc_id, label = 0 AND ({' OR '.join(f"contains(lower(said), '{w}')" for w in WORDS)} OR starts_with(mapped_group, 'P4')) AS hard_negative FROM m""",
)
def _prj15(spark, sf_dir):
    """PRJ15: confusable words or the negative group."""
    hard = lb.hard_negative(F.col("label"), F.col("mapped_transcript"), F.col("mapped_group"), WORDS)
    return mapped(spark, sf_dir).select("doc_id", hard.alias("hard_negative"))


PRESETS = {
    "positive": "label = 1",
    "negative": "label = 0",
    "flagged": "auto_qc_status <> 'auto_accepted'",
    **{p: f"starts_with(prompt_group, '{p}')" for p in ("P1", "P2", "P3", "P4")},
}


@plan(
    "prj16_clip_presets",
    with_ctes(STAR_SQL)
    + " UNION ALL ".join(f"SELECT '{n}' AS preset, count(*) AS clips, count(DISTINCT clip_id) AS ids FROM clips WHERE {w}" for n, w in PRESETS.items()),
)
def _prj16(spark, sf_dir):
    """PRJ16: clip list presets, all counted in one scan."""
    return lb.preset_counts(clips(spark, sf_dir))


DECIDED_SQL = f"d AS (SELECT doc_id, mapped_group, label, {has_keyword_sql('said')} AS decision FROM m)"


def decided(spark, sf_dir):
    rows = mapped(spark, sf_dir)
    return rows.withColumn("decision", tx.has_keyword(F.col("mapped_transcript"), KEYWORD))


@plan(
    "prj17_keyword_baseline",
    T
    + f""", {MAPPED_SQL}, {DECIDED_SQL}, x AS (SELECT mapped_group, count(*) AS n, {counts_sql('label', 'decision')} FROM d GROUP BY 1)
SELECT *, {metric_sql()} FROM x""",
)
def _prj17(spark, sf_dir):
    """PRJ17: the keyword match as a detector, per group."""
    return mt.confusion(decided(spark, sf_dir), ["mapped_group"], "label", F.col("decision"))


@plan(
    "prj17_misclassified",
    T + f", {MAPPED_SQL}, {DECIDED_SQL} SELECT doc_id, mapped_group, label, decision FROM d WHERE (label = 1) <> decision",
)
def _prj17_wrong(spark, sf_dir):
    """PRJ17: the misclassified examples."""
    wrong = decided(spark, sf_dir).where((F.col("label") == 1) != F.col("decision"))
    return wrong.select("doc_id", "mapped_group", "label", "decision")


@plan(
    "prj18_intake_labels",
    T
    + f""", i AS (SELECT doc_id, prompt_group AS g, CASE WHEN prompt_group = 'P1' THEN 'The' ELSE {recase_sql('transcript', 'The')} END AS s FROM t),
h AS (SELECT *, {has_keyword_sql('s')} AS has FROM i)
SELECT doc_id, g AS intake_group, sha256(s) AS said, g IN ('P1', 'P2', 'P3') AS intake_contains_keyword, g = 'P4_negative' AS intake_is_negative,
  CASE WHEN g = '' THEN 'invalid_prompt_group' WHEN s = '' THEN 'transcript_required' WHEN g IN ('P2', 'P3') AND NOT has THEN 'keyword_missing'
  WHEN g = 'P4_negative' AND has THEN 'negative_contains_keyword' END AS intake_reason FROM h""",
)
def _prj18(spark, sf_dir):
    """PRJ18: label derivation when a clip is handed in."""
    t = labelled_text(spark, sf_dir).withColumn("prompt_group", F.concat(F.lit(" "), "prompt_group", F.lit(" ")))
    return lb.intake_labels(t, KEYWORD, GROUPS).select(
        "doc_id",
        "intake_group",
        digest("intake_transcript").alias("said"),
        "intake_contains_keyword",
        "intake_is_negative",
        "intake_reason",
    )


@plan(
    "agg26_inspection_counts",
    T
    + f""", {MAPPED_SQL} SELECT mapped_group, label, count(*) AS rows, count(DISTINCT clip_id) AS ids,
  count(*) FILTER (WHERE len(reasons) = 0) AS accepted, count(*) FILTER (WHERE len(reasons) > 0) AS rejected FROM m GROUP BY ALL""",
)
def _agg26(spark, sf_dir):
    """AGG26: rows, ids, accepted and rejected per group and label."""
    return (
        mapped(spark, sf_dir)
        .groupBy("mapped_group", "label")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("clip_id").alias("ids"),
            F.count_if(F.size("reasons") == 0).alias("accepted"),
            F.count_if(F.size("reasons") > 0).alias("rejected"),
        )
    )


@plan(
    "agg12_duplicate_texts",
    """SELECT sha256(text) AS content, count(*) AS clip_count, count(DISTINCT source) AS participant_count,
  min(doc_id) AS first_clip, count(DISTINCT source) > 1 AS cross_participant FROM documents GROUP BY text HAVING count(*) > 1""",
)
def _agg12(spark, sf_dir):
    """AGG12: groups of identical content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", digest("text").alias("content"))
    return mf.duplicate_groups(docs, "content", "source", "doc_id")


@plan(
    "agg12_duplicate_members",
    """WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
SELECT doc_id, source, sha256(text) AS content, n AS clip_count FROM documents JOIN g USING (text)""",
)
def _agg12_members(spark, sf_dir):
    """AGG12: members of the duplicate groups, one row each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", digest("text").alias("content"))
    return mf.duplicate_members(docs, "content", "source", "doc_id").select("doc_id", "source", "content", "clip_count")


@plan(
    "agg13_duplicate_policy",
    """WITH g AS (SELECT text, count(DISTINCT source) AS u, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY text)
SELECT doc_id, source, lang FROM documents JOIN g USING (text) WHERE n = 1 OR (u = 1 AND doc_id = f)""",
)
def _agg13(spark, sf_dir):
    """AGG13: cross-participant copies dropped, others kept once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", digest("text").alias("content"))
    return mf.drop_duplicates_by_policy(docs, "content", "source", "doc_id").drop("content")
