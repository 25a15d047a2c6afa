"""Label mapping, quarantine reasons and phrase ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

LEGACY = "legacy"


@dataclass(frozen=True)
class PromptGroups:
    """Names of the four prompt groups; the keyword and names are parameters."""

    only: str
    before: str
    after: str
    negative: str

    @property
    def positives(self) -> tuple[str, str, str]:
        return (self.only, self.before, self.after)

    @property
    def all(self) -> tuple[str, ...]:
        return (*self.positives, self.negative)


def default_groups(keyword: str) -> PromptGroups:
    return PromptGroups(f"P1_{keyword}_only", f"P2_phrase_plus_{keyword}", f"P3_{keyword}_plus_phrase", "P4_negative")


def filled(column: str | Column) -> Column:
    """Null for the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(c, F.lit(""))


def phrase_id(match_form: Column, label: Column, keyword: str, phrases: Sequence[str]) -> Column:
    """Keyword for positives; else a listed phrase, a listed first word or background."""
    known = F.array(*[F.lit(p) for p in phrases]) if phrases else F.array().cast("array<string>")
    normal = F.transform(known, tx.match_form)
    first = F.split(match_form, " ")[0]
    return (
        F.when(label == 1, F.lit(keyword.lower()))
        .when(F.array_contains(normal, match_form), match_form)
        .when(F.array_contains(normal, first), first)
        .otherwise(F.lit("background"))
    )


def map_labels(df: DataFrame, keyword: str, groups: PromptGroups, phrases: Sequence[str]) -> DataFrame:
    """Map stored clips to training labels or quarantine reasons.

    Reads prompt_group, prompt_id, transcript, normalized_transcript and the
    three stored flags (missing columns count as null).  Adds the mapped
    columns and ``reasons``; a row with reasons is rejected.
    """

    def have(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    group = F.coalesce(filled(have("prompt_group")), filled(have("prompt_id").cast("string")), F.lit(LEGACY))
    known = group.isin(*groups.all)
    stored = F.coalesce(filled(have("transcript")), filled(have("normalized_transcript")))
    said = (
        F.when(~known, F.coalesce(stored, group))
        .when(group == groups.only, F.lit(keyword.upper()))
        .otherwise(F.coalesce(stored, F.lit("")))
    )
    base = df.withColumns({"_group": group, "_known": known, "_said": tx.recase_keyword(said, keyword)})
    base = base.withColumns({"_has": tx.has_keyword(F.col("_said"), keyword), "_match": tx.match_form(F.col("_said"))})
    known, group, has = F.col("_known"), F.col("_group"), F.col("_has")
    positive = F.when(known, group.isin(*groups.positives)).otherwise(has)
    negative = known & (group == groups.negative)

    def clash(name: str, expected: Column) -> Column:
        return F.when(known & (have(name, "boolean") != expected), f"inconsistent_{name}")

    reasons = F.array_compact(
        F.array(
            F.when(known & (F.col("_said") == ""), "missing_transcript"),
            F.when(group.isin(groups.before, groups.after) & ~has, "positive_prompt_missing_exact_keyword"),
            F.when(negative & has, "negative_prompt_contains_exact_keyword"),
            clash("contains_keyword", positive),
            clash("wake_intent", positive),
            clash("is_negative", negative),
        )
    )
    mapped = {
        "mapped_group": F.when(known, group).otherwise(LEGACY),
        "mapped_transcript": F.col("_said"),
        "match_form": F.col("_match"),
        "label": positive.cast("int"),
        "mapped_negative": negative,
        "phrase_id": phrase_id(F.col("_match"), positive.cast("int"), keyword, phrases),
        "reasons": reasons,
    }
    return base.withColumns(mapped).drop("_group", "_known", "_said", "_has", "_match")


def intake_labels(df: DataFrame, keyword: str, groups: PromptGroups, *, group: str = "prompt_group", transcript: str = "transcript") -> DataFrame:
    """Derive labels when a clip is handed in; a reason means it is refused."""
    g = F.trim(F.coalesce(F.col(group), F.lit("")))
    raw = F.trim(F.coalesce(F.col(transcript), F.lit("")))
    cased = F.when(g == groups.only, keyword.capitalize()).otherwise(
        tx.recase_keyword(raw, keyword, keyword.capitalize())
    )
    base = df.withColumns({"intake_group": g, "intake_transcript": cased})
    has = tx.has_keyword(F.col("intake_transcript"), keyword)
    g, said = F.col("intake_group"), F.col("intake_transcript")
    reason = (
        F.when(~g.isin(*groups.all), "invalid_prompt_group")
        .when(said == "", "transcript_required")
        .when(g.isin(groups.before, groups.after) & ~has, "keyword_missing")
        .when((g == groups.negative) & has, "negative_contains_keyword")
    )
    positive = g.isin(*groups.positives)
    return base.withColumns(
        {
            "intake_contains_keyword": positive,
            "intake_wake_intent": positive,
            "intake_is_negative": g == groups.negative,
            "intake_reason": reason,
        }
    )


def canonical_samples(df: DataFrame, clip: str, order: str) -> DataFrame:
    """First occurrence of each id; the others and null ids get a reason.

    ``order`` must be unique per row.  Ids are compared with their minimum
    through a join, so one heavily repeated id does not gather in one task.
    """
    firsts = df.where(F.col(clip).isNotNull()).groupBy(clip).agg(F.min(order).alias("_first"))
    joined = df.join(firsts, clip, "left")
    reason = F.when(F.col(clip).isNull(), "missing_clip_id").when(
        F.col(order) > F.col("_first"), "duplicate_clip_id_in_metadata"
    )
    return joined.withColumn("sample_reason", reason).drop("_first")


def backfill_legacy(clips: DataFrame, prompts: DataFrame) -> DataFrame:
    """Fill empty label columns from the prompt catalogue.

    Flags come from the prompt only where the old group was literally
    ``legacy``; an old empty string does not count.
    """
    extra = prompts.select(
        "prompt_id",
        F.col("expected_transcript").alias("_expected"),
        F.col("contains_keyword").alias("_has"),
        F.col("wake_intent").alias("_wake"),
    )
    joined = clips.join(extra, "prompt_id", "left")
    own = F.col("prompt_id").cast("string")
    legacy = F.col("prompt_group") == LEGACY
    return joined.withColumns(
        {
            "contains_keyword": F.when(legacy & F.col("_has"), F.lit(True)).otherwise(F.col("contains_keyword")),
            "wake_intent": F.when(legacy & F.col("_wake"), F.lit(True)).otherwise(F.col("wake_intent")),
            "is_negative": F.coalesce("is_negative", F.lit(False)),
            "prompt_title": F.coalesce(filled("prompt_title"), own),
            "transcript": F.coalesce(filled("transcript"), F.col("_expected"), own),
            "normalized_transcript": F.coalesce(filled("normalized_transcript"), F.col("_expected"), own),
            "prompt_group": F.coalesce(filled("prompt_group"), F.lit(LEGACY)),
        }
    ).drop("_expected", "_has", "_wake")


def hard_negative(label: Column, transcript: Column, group: Column, words: Sequence[str]) -> Column:
    """Negative that holds a confusable word or sits in the negative group."""
    lowered = F.lower(F.coalesce(transcript, F.lit("")))
    confusable = tx.any_of(*[lowered.contains(w) for w in words]) if words else F.lit(False)
    return (label == 0) & (confusable | F.coalesce(group.startswith("P4"), F.lit(False)))


def preset_rules(*, group: str = "prompt_group", label: str = "label", status: str = "auto_qc_status") -> dict[str, Column]:
    """Clip list presets: positive, negative, flagged and P1 to P4."""
    return {
        "positive": F.col(label) == 1,
        "negative": F.col(label) == 0,
        "flagged": F.col(status) != "auto_accepted",
        **{p: F.col(group).startswith(p) for p in ("P1", "P2", "P3", "P4")},
    }


def preset(df: DataFrame, name: str, **columns: str) -> DataFrame:
    return df.where(preset_rules(**columns)[name])


def preset_counts(df: DataFrame, clip: str = "clip_id", **columns: str) -> DataFrame:
    """Rows and ids per preset; each row names its presets, so one scan serves all."""
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in preset_rules(**columns).items()]))
    per_id = df.select(clip, F.explode(named).alias("preset")).groupBy("preset", clip).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy("preset").agg(F.sum("_n").alias("clips"), F.count(F.lit(1)).alias("ids"))
