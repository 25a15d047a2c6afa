"""The few steps Spark SQL cannot express, as Arrow-batched functions."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers inside the task closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Apostrophe look-alikes that score as a plain apostrophe.
APOSTROPHES = "‘’‛′ʼ`"

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789'"
_SPACED = bytes(i if i in _KEPT else ord(" ") for i in range(256))
_OUTER_APOSTROPHE = re.compile(rb"'(?:(?![a-z0-9])|(?<![a-z0-9]'))")


def _spaced(text: str) -> bytes:
    """Lower case; every character but a-z, 0-9 and the apostrophe is a space."""
    return text.lower().encode("ascii", "replace").translate(_SPACED)


def _squeezed(spaced: bytes) -> str:
    return b" ".join(spaced.split()).decode("ascii")


def _scored(text: str | None, normalise: bool) -> str:
    text = unicodedata.normalize("NFKC", text or "") if normalise else text or ""
    for mark in APOSTROPHES:
        text = text.replace(mark, "'")
    spaced = _spaced(text)
    return _squeezed(_OUTER_APOSTROPHE.sub(b" ", spaced) if b"'" in spaced else spaced)


@F.pandas_udf(T.StringType())
def scoring_udf(text: pd.Series, normalise: pd.Series) -> pd.Series:
    return pd.Series([_scored(*pair) for pair in zip(text, normalise)], dtype=object)


@F.pandas_udf(T.StringType())
def parity_udf(text: pd.Series) -> pd.Series:
    return pd.Series([_squeezed(_spaced(t or "")) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def nfkc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


TRANSCRIPT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())]
)


def nested_transcript(fields: tuple, repr_patterns: tuple, max_depth: int):
    """Arrow function for results nested deeper than the column form reaches."""
    import json

    bad = [re.compile(p) for p in repr_patterns]

    def visit(value, path, depth):
        if depth > max_depth:
            return None, path, "max_depth"
        if isinstance(value, str):
            text = value.strip()
            if not text:
                return None, path, "empty"
            return (None, path, "object_repr") if any(p.search(text) for p in bad) else (text, path, None)
        if isinstance(value, dict):
            children = [(f"['{f}']", value[f]) for f in fields if f in value]
        elif isinstance(value, list):
            children = [(f"[{i}]", item) for i, item in enumerate(value)]
        else:
            children = []
        last = (None, path, "unsupported")
        for suffix, child in children:
            last = visit(child, path + suffix, depth + 1)
            if last[2] is None:
                break
        return last

    @F.pandas_udf(TRANSCRIPT)
    def extract(result: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in result:
            if raw is None:
                rows.append((None, None, None))
                continue
            try:
                rows.append(visit(json.loads(raw), "$", 0))
            except ValueError:
                rows.append((None, "$", "invalid_json"))
        return pd.DataFrame(rows, columns=["text", "path", "error"])

    return extract
