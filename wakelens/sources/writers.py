"""Sinks: split manifests, projections and reports as directories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

KEYWORD_FIELDS = ("audio", "transcript", "label", "prompt_group", "phrase_id", "participant_alias", "split", "clip_id")
ASR_FIELDS = ("audio", "text")


def write_partitioned(rows: DataFrame, path: str, by: Sequence[str], kind: str = "parquet", *, order: Sequence[str] = (), files: int | None = None) -> None:
    """One folder per value.

    With ``order`` the rows are range-partitioned over the folder and the order
    together, so a value that holds most rows spans many files, each sorted.
    """
    if order:
        keys = [*by, *order]
        placed = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        rows = placed.sortWithinPartitions(*keys)
    rows.write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def write_split_manifests(rows: DataFrame, path: str, *, split: str = "split", order: Sequence[str] = ("clip_id", "window_index")) -> dict[str, str]:
    """Manifests per split, sorted; ``all`` is the parent folder itself."""
    write_partitioned(rows, path, [split], "json", order=order)
    return {"all": path, **{s: f"{path}/{split}={s}" for s in ("train", "val", "test")}}


def asr_rows(manifest: DataFrame, keyword: str, *, audio: str, transcript: str) -> DataFrame:
    """Recognition rows: audio and text only."""
    return manifest.select("split", F.col(audio).alias("audio"), tx.asr_target(F.col(transcript), keyword).alias("text"))


def asr_violations(rows: DataFrame) -> DataFrame:
    """Recognition rows without the prefix or with a label token in the text."""
    extra = sorted(set(rows.columns) - {*ASR_FIELDS, "split"})
    if extra:
        raise ValueError(f"recognition rows hold other fields: {extra}")
    return rows.where(~F.col("text").startswith("language ") | tx.leaks_label(F.col("text")))


def keyword_rows(manifest: DataFrame, keyword: str, *, audio: str, transcript: str, alias: str) -> DataFrame:
    """Keyword rows: the eight label fields."""
    return manifest.select(
        F.col(audio).alias("audio"),
        tx.recase_keyword(F.col(transcript), keyword).alias("transcript"),
        "label",
        "prompt_group",
        "phrase_id",
        F.col(alias).alias("participant_alias"),
        "split",
        "clip_id",
    )


def union_report(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of different shapes under the sorted union of their columns."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.select(*sorted(merged.columns))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def route(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows for the quarantine)."""
    passed = F.coalesce(good, F.lit(False))
    return rows.where(passed), rows.where(~passed)
