"""Transcript extraction from nested recogniser results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import nested_transcript
from .text import OBJECT_REPR_PATTERNS, looks_like_repr

# Transcript fields in order of preference.
TEXT_FIELDS = ("text", "transcript", "hypothesis", "prediction", "output")
MAX_DEPTH = 8


def _usable(text: Column) -> Column:
    clean = F.trim(text)
    return F.when((clean != "") & ~looks_like_repr(clean), clean)


def _leaf(json: Column, path: str) -> Column:
    """String at a JSON path; objects and lists there give null."""
    raw = F.get_json_object(json, path)
    return F.when(~raw.startswith("{") & ~raw.startswith("["), _usable(raw))


def extract_transcript(df: DataFrame, json: str, *, text: str = "text", path: str = "extraction_path", error: str = "extraction_error") -> DataFrame:
    """Add text, path and error.

    A flat object whose preferred field holds a plain string is read in the
    JVM; every other shape goes through the Arrow function.
    """
    raw = F.col(json)
    first_value, first_path = _leaf(raw, f"$.{TEXT_FIELDS[0]}"), f"$['{TEXT_FIELDS[0]}']"
    flat = raw.startswith("{") & first_value.isNotNull() & ~raw.contains('"text":{') & ~raw.contains('"text":[')
    rest = nested_transcript(TEXT_FIELDS, OBJECT_REPR_PATTERNS, MAX_DEPTH)
    staged = df.withColumn("_flat", F.when(flat, first_value))
    staged = staged.withColumn("_deep", rest(F.when(F.col("_flat").isNull(), raw)))
    return staged.withColumns(
        {
            text: F.coalesce("_flat", "_deep.text"),
            path: F.when(F.col("_flat").isNotNull(), first_path).otherwise(F.col("_deep.path")),
            error: F.when(F.col("_flat").isNull(), F.col("_deep.error")),
        }
    ).drop("_flat", "_deep")
