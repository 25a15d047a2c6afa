"""The operators as named queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder, tune
from . import byte_bpe, conversation_repair, conversation_sql, decontamination, language_id, main_text, phrases, privacy, quality_rules, repeated_passages, sharding, similar_texts, token_counts, token_files
from .packed import prepare

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
BYTE_VOCABULARY = "byte_bpe_50k.json"
END_ID = 2


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    PLANS[build.__name__] = run
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(~held_out()))
    found = language_id.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    coded = byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document from the counts stored at its prefixes."""
    counted = token_counts.prefix_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))
    total = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", total.alias("n_tokens"), (total > TOKEN_LIMIT).alias("over_limit"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from the labels."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    wanted = quality_rules.training_ids(labels)
    chosen = docs.select("doc_id", "text").join(wanted.select("id"), F.col("doc_id") == F.col("id")).select("doc_id", "text")
    stats = quality_rules.statistics(chosen)
    pruning = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    rows = stats.join(wanted, "id").select(pruning.alias("pruning"), "good", "base_failed", *[c.alias(n) for n, c in quality_rules.features().items()])
    rules = quality_rules.fit(cut(rows).where(~F.col("base_failed")))
    return quality_rules.apply(quality_rules.statistics(docs), rules).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the templates of its host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = main_text.extract(pages, cut(main_text.induce(pages)))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards near equal in bytes."""
    placed = sharding.assign(documents(spark, sf_dir), shards=40)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document and the terms that disclose them."""
    docs = documents(spark, sf_dir)
    found = privacy.find(docs, cut(privacy.disclosing_terms(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform("base", line), ",")
    added = F.transform("added", lambda s: F.concat_ws(":", F.concat(F.lit("term_"), s["kind"]), s["start"], s["end"]))
    spans = F.array_join(F.concat(F.transform("base", line), added), ",")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in privacy.KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, with scores and overlaps."""
    found = decontamination.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("score", 6).alias("score"), F.round("question", 6).alias("question_share"), F.round("answer", 6).alias("answer_share"), "start", "end")


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of its repeated passages, as a digest."""
    left = repeated_passages.remove_repeats(documents(spark, sf_dir))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    found = similar_texts.similar(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two or three words of every language."""
    return phrases.collocations(documents(tune(spark), sf_dir))


SQL["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM lists, range(1, 4) t(k), unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) u(i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, CAST(k AS BIGINT))) AS j FROM found)),
cuts AS (
  SELECT d.lang, d.phrase, d.a, d.j, l.c AS l, r.c AS r, CAST(1000000::HUGEINT * d.a * d.a // (l.c::HUGEINT * r.c) AS BIGINT) AS score
  FROM parts d JOIN f l ON l.lang = d.lang AND l.phrase = d.head JOIN f r ON r.lang = d.lang AND r.phrase = d.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM found, range(1, 3) t(i) WHERE k = 3 GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, CAST(t.n AS BIGINT) AS n, b.score
  FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT * FROM ranked WHERE rank <= 2000
"""


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    folder = shared_folder(spark)
    token_files.write(documents(spark, sf_dir), folder, public_tokenizers.path(BYTE_VOCABULARY), END_ID)
    found = token_files.read(spark, folder)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", token_files.check().alias("ids_crc32"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversation_repair.summaries(conversation_repair.damaged(rows))
    every = rows.select(F.col("conv_id")).distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL["op13_conversation_repair"] = conversation_sql.REPAIRED
