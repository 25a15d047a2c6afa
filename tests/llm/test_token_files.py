"""Operator 12 against the library, and its coding on its own."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakelens.llm import token_files as tf
from wakelens.session import shared_folder

VOCABULARY = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, id string, file int, ids long, n long, check string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\t", " \n ", " ", "᠎", "\x1c", "\x85", "　", "don't", "'s", "''", "12", "é", "日本", "😀", "<|endoftext|>", "!?", ".", "A", "́", "ǅ", "٣", "_", "\x00", "a.\nb", "a\n\nb", "c. \nd", ",e", "f:g", "\n"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [None, "", " ", "a", " a", "a ", "a  b", "the " * 50_000, "x" * 20_000, "same", "same", *mixed]


@pytest.mark.parametrize("held", [1_200_000, 20])
def test_parts_encode_like_whole_texts(library, texts, monkeypatch, held):
    monkeypatch.setattr(tf, "MAX_PARTS", held)
    coder = tf.Encoder(VOCABULARY)
    known = [t for t in texts if t is not None]
    for some in (known, *[[t] for t in known]):
        raw = [t.encode() for t in some]
        ids, counts = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for text, got in zip(some, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("bits, top", [(1, 1 << 16), (2, 1 << 32)])
def test_coding_round_trip(bits, top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ranks = np.concatenate([rng.integers(0, 256, n), rng.integers(0, top, n)]).astype(np.uint32)
        control, data = tf.pack(ranks, bits)
        assert len(control) == -(-len(ranks) * bits // 8)
        assert (tf.unpack(control, data, len(ranks), bits) == ranks).all()


@pytest.mark.parametrize("block, small", [(1 << 18, 1 << 16), (64, 1 << 16), (64, 10)])
def test_files(spark, library, texts, monkeypatch, block, small):
    monkeypatch.setattr(tf, "BLOCK_IDS", block)
    monkeypatch.setattr(tf, "SMALL_VOCABULARY", small)
    rows = [(7 * k % 100 if k % 10 else (None if k % 20 else 5), t, "x", 1, 2, 3, "y") for k, t in enumerate(texts)]
    folder = shared_folder(spark)
    tf.write(spark.createDataFrame(rows, DOCS).repartition(4), folder, VOCABULARY, 2)
    got = tf.read(spark, folder).select("id", "start", "n_tokens", "ids", tf.check().alias("crc")).collect()
    want = sorted(((i is not None, i or 0), tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    assert sorted(((r.id is not None, r.id or 0), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place and r.n_tokens == len(r.ids) // 4 and r.crc == zlib.crc32(r.ids)
        place += r.n_tokens
    order = [(r.id is not None, r.id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [(-r.times, r.token) for r in ranks] == sorted((-r.times, r.token) for r in ranks)


def test_documents_pack_one_after_another():
    rng = np.random.default_rng(2)
    counts = np.array([0, 3, 8, 0, 17, 1])
    ranks = rng.integers(0, 70_000, counts.sum()).astype(np.uint32)
    control, data, n_control, n_data = tf.pack_all(ranks, counts, 2)
    parts = zip(np.split(ranks, np.cumsum(counts)[:-1]), np.split(control, np.cumsum(n_control)[:-1]), np.split(data, np.cumsum(n_data)[:-1]))
    assert all((tf.unpack(c.tobytes(), d.tobytes(), len(r), 2) == r).all() for r, c, d in parts)


def test_empty_table(spark):
    folder = shared_folder(spark)
    tf.write(spark.createDataFrame([], DOCS), folder, VOCABULARY, 2)
    assert tf.read(spark, folder).count() == 0


def test_one_identifier_is_dealt_out(spark):
    """A third of all rows with one identifier and one text spread over the files."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    folder = shared_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny files would be joined
    try:
        tf.write(rows.repartition(6), folder, VOCABULARY, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum(F.size("ids")).alias("n")).collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) < 1000
