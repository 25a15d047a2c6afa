"""Text normalisers and predicates as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import APOSTROPHES, nfkc_udf, parity_udf, scoring_udf

# Tokens that must not appear in recognition targets.
LABEL_TOKENS = (
    "positive",
    "negative",
    "trigger",
    "wake_intent",
    "prompt_group",
    "P1_",
    "P2_",
    "P3_",
    "P4_",
)

# Marks of a stringified result object instead of a transcript.
OBJECT_REPR_PATTERNS = (
    r"<[^>]+ object at 0x[0-9a-fA-F]+>",
    r"^[A-Za-z_][\w.]*Result\s*\(",
    r"^[\w.]*ASR[A-Za-z_]*\s*\(",
    r"(?s)\blanguage\s*=.+\btext\s*=",
)

def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def collapse(text: Column) -> Column:
    """Trim and squeeze runs of Unicode white space; null counts as empty."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.trim(squeezed)


def keyword_pattern(keyword: str) -> str:
    return rf"(?iU)\b{keyword}\b"


def has_keyword(text: Column, keyword: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(keyword_pattern(keyword))


def recase_keyword(text: Column, keyword: str, casing: str | None = None) -> Column:
    """White space squeezed and every keyword occurrence in one casing."""
    return F.regexp_replace(collapse(text), keyword_pattern(keyword), casing or keyword.upper())


def match_form(text: Column) -> Column:
    """Lower case, punctuation dropped, white space squeezed."""
    return collapse(F.regexp_replace(F.lower(collapse(text)), r"(?U)[^\w\s]", ""))


def nfkc(text: Column) -> Column:
    """NFKC; pure ASCII rows are passed through without leaving the JVM."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(nfkc_udf(F.when(~ascii_only, text)))


def _plain_apostrophes(text: Column) -> Column:
    return F.regexp_replace(text, f"[{APOSTROPHES}]", "'")


def scoring_form(text: Column, *, normalise: bool = True) -> Column:
    """Word-error normaliser: only a-z, 0-9 and word-internal apostrophes."""
    return scoring_udf(text, F.lit(normalise))


def raw_scoring_form(text: Column, *, normalise: bool = True) -> Column:
    return collapse(_plain_apostrophes(nfkc(text) if normalise else text))


def parity_form(text: Column) -> Column:
    return parity_udf(text)


def asr_target(text: Column, keyword: str, language: str = "English") -> Column:
    return F.concat(F.lit(f"language {language}<asr_text>"), recase_keyword(text, keyword))


def leaks_label(text: Column) -> Column:
    return any_of(*[text.contains(token) for token in LABEL_TOKENS])


def looks_like_repr(text: Column) -> Column:
    return any_of(*[text.rlike(pattern) for pattern in OBJECT_REPR_PATTERNS])


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y"), F.lit(False))


def words(text: Column) -> Column:
    """Words of an already squeezed text; the empty text has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def keep_last(text: Column, limit: int) -> Column:
    return F.right(text, F.lit(limit))
