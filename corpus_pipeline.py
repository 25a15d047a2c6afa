"""From raw documents to token ids, in five stages on Spark.

Every stage works on all that the one before it kept.  All but the last return
the columns of ``documents``; between stages the rows are written as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakelens.llm import byte_bpe, decontamination, language_id, privacy, similar_texts
from wakelens.llm.packed import prepare
from wakelens.llm.queries import BYTE_RANKS
from wakelens.session import cut, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; ``lang`` becomes the predicted one.

    Rejected are texts without a letter and those whose codeword lead is too
    small to tell the language.
    """
    model = language_id.fit(docs)
    found = language_id.label(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five words, 0.8)."""
    return similar_texts.representatives(docs, width=5, percent=80).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = cut(decontamination.matches(docs, benchmark).select("id").distinct())
    return docs.join(hit, docs["doc_id"] == hit["id"], "left_anti").select(*COLUMNS)


def remove_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with personal data and disclosing terms replaced."""
    return privacy.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to."""
    coded = byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(tune(spark)), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("language_id", _prepared(identify_language)),
    ("similar_texts", _prepared(drop_similar)),
    ("decontamination", _prepared(decontaminate)),
    ("private_data", _prepared(remove_private_data)),
    ("byte_bpe", _prepared(encode)),
]

# Trained classifiers, searches and token merges: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
