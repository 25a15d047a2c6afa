"""Scans with explicit schemas and quarantine of bad rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import dot
from ..functions.text import truthy

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are dropped.

    Tolerant reads keep a broken line in ``_corrupt_record``; strict ones fail.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows


def prediction_state(rows: DataFrame, key: str, *, retry_failed: bool = False) -> DataFrame:
    """Completed ids, failures and corrupt lines of a resumable run; an unknown status completes nothing."""
    corrupt = F.col(CORRUPT).isNotNull() | (F.coalesce(F.col(key), F.lit("")) == "")
    status = F.coalesce(F.col("status"), F.lit(""))
    failed = ~corrupt & (status == "failed")
    done = ~corrupt & ((status == "success") | (F.lit(not retry_failed) & failed))
    per_id = rows.select(key, corrupt.alias("_c"), failed.alias("_f"), done.alias("_d"))
    folded = per_id.groupBy(key).agg(
        F.count_if("_c").alias("_c"), F.count_if("_f").alias("_f"), F.max("_d").cast("int").alias("_d"), F.count(F.lit(1)).alias("_n")
    )
    return folded.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("corrupt"),
        F.coalesce(F.sum("_f"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("completed_ids"),
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, flags: Sequence[str] = ()) -> DataFrame:
    """CSV with header; the named string columns become booleans."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumns({c: truthy(F.col(c)) for c in flags}) if flags else rows


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length")


SUFFIXES = ("webm", "m4a", "wav")


def canonical_members(clips: DataFrame, files: DataFrame, *, clip: str = "clip_id", recorded: str = "raw_audio_path", path: str = "path") -> DataFrame:
    """One file per clip by three rules, tried in this order.

    A single file ``audio_raw/<id>.*``; the recorded path; a file named
    ``<id>`` with a known suffix (the first one).  Each rule is an equi-join on
    a pre-aggregated key, never a prefix comparison of all pairs.
    """
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    stem = F.regexp_extract(name, r"^([^.]+)\.", 1)
    folder = F.col(path).startswith("audio_raw/") & ~F.substring(F.col(path), 11, 1_000_000).contains("/")
    by_folder = files.where(folder & (stem != "")).groupBy(stem.alias(clip)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(path).alias("_folder")
    )
    known = F.regexp_extract(name, rf"^(.*)\.({'|'.join(SUFFIXES)})$", 1)
    nested = F.col(path).contains("/")
    by_suffix = files.where(nested & (known != "")).groupBy(known.alias(clip)).agg(F.min(path).alias("_suffix"))
    existing = files.select(F.col(path).alias(recorded)).distinct().withColumn("_recorded", F.col(recorded))
    joined = clips.join(by_folder, clip, "left").join(existing, recorded, "left").join(by_suffix, clip, "left")
    single = F.when(F.col("_n") == 1, F.col("_folder"))
    rule = F.when(single.isNotNull(), "unique_prefix").when(F.col("_recorded").isNotNull(), "recorded_path").when(F.col("_suffix").isNotNull(), "suffix")
    member = F.coalesce(single, "_recorded", "_suffix")
    return joined.withColumns({"member": member, "member_rule": rule}).drop("_n", "_folder", "_recorded", "_suffix")


def member_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Member names of a listing in which ``dir=`` and ``name=`` folders stand for folder and file."""
    part = r"/dir=([^/]+)/name=([^/]+)/"
    member = F.concat_ws("/", F.regexp_extract(path, part, 1), F.regexp_extract(path, part, 2))
    return files.where(F.col(path).rlike(part)).select(F.url_decode(F.replace(member, F.lit("+"), F.lit("%2B"))).alias("path"), "length").groupBy("path").agg(F.sum("length").alias("length"))


def ambiguous_prefixes(files: DataFrame, path: str = "path", clip: str = "clip_id") -> DataFrame:
    """Ids for which more than one file ``audio_raw/<id>.*`` exists, with their number."""
    stem = F.regexp_extract(path, r"^audio_raw/([^/.]+)\.[^/]*$", 1)
    counted = files.where(stem != "").groupBy(stem.alias(clip)).agg(F.count(F.lit(1)).alias("files"), F.min(path).alias("first_file"), F.max(path).alias("last_file"))
    return counted.where(F.col("files") > 1)


def duplicate_transcripts(parsed: DataFrame) -> DataFrame:
    """Well-formed ids that occur more than once, with the number of different texts."""
    sound = parsed.where(F.col("problem").isNull())
    per_text = sound.groupBy("id", "reference").agg(F.count(F.lit(1)).alias("_n"))
    counted = per_text.groupBy("id").agg(F.sum("_n").alias("occurrences"), F.count(F.lit(1)).alias("texts"))
    return counted.where(F.col("occurrences") > 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<speaker>-<chapter>-<number> <text>``; bad lines get a problem."""
    return parse_transcripts(spark.read.text(path))


def parse_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    parts = F.split(F.trim(value), " ", 2)
    utt = parts[0]
    text = F.trim(F.get(parts, F.lit(1)))
    pieces = F.split(utt, "-")
    problem = F.when(F.size(pieces) != 3, "malformed_id").when(F.coalesce(text, F.lit("")) == "", "empty_text")
    return lines.where(F.trim(value) != "").select(
        utt.alias("id"),
        F.get(pieces, F.lit(0)).alias("speaker_id"),
        F.get(pieces, F.lit(1)).alias("chapter_id"),
        text.alias("reference"),
        problem.alias("problem"),
    )


def vector_health(rows: DataFrame, vector: str, keys: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Vectors per key and dimension, non-finite ones and unit-norm ones."""
    v = F.col(vector)
    infinite = float("inf")
    broken = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == infinite))
    length = F.sqrt(dot(v, v))
    return rows.groupBy(*keys, F.size(v).alias("dimension")).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(broken).alias("non_finite"),
        F.count_if(~broken & (F.abs(length - 1.0) <= tolerance)).alias("unit_norm"),
    )


def read_table(spark: SparkSession, path: str, order: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Relational scan ordered by key; only the named columns are read."""
    rows = spark.read.parquet(path)
    return (rows.select(*columns) if columns else rows).orderBy(*order)


def read_database(spark: SparkSession, url: str, table: str, *, partition: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """JDBC scan split over a numeric key, so executors read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
    return reader.option("numPartitions", parts).options(**options).load()
