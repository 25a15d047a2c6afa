"""Scans for private values and column-level redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What must not appear in public output.
PATTERNS = {
    "email": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    "speaker_hash": r"\bspk_[0-9a-fA-F]{8,}\b",
    "long_hex": r"\b[A-Fa-f0-9]{40,}\b",
}
FORBIDDEN_KEYS = ("name", "email", "speaker_hash", "account_id", "session_id", "participant_alias_map")


def scan(df: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per document and kind with the number of hits."""
    found = [
        F.struct(F.lit(kind).alias("kind"), F.regexp_count(F.col(text), F.lit(p)).alias("hits"))
        for kind, p in (patterns or PATTERNS).items()
    ]
    return df.select(key, F.inline(F.array(*found))).where(F.col("hits") > 0)


def hits(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """The matched values themselves, one row each."""
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))).alias("value"))


def redact_columns(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN_KEYS) -> DataFrame:
    return df.drop(*[c for c in forbidden if c in df.columns])


def require_public(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN_KEYS) -> DataFrame:
    """Raise on a private column; a schema check, no job runs."""
    found = sorted(set(df.columns) & set(forbidden))
    if found:
        raise ValueError(f"private columns in public output: {found}")
    return df
