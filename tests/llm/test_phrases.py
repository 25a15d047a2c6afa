"""Operator 11 against counting every phrase, and its parsing on its own."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wakelens.llm import phrases as ph
from wakelens.llm.packed import hash_words

DOCS = "doc_id long, text string, lang string, phrase string, times int, hash long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        words = [w for w in re.split(r"[ \t]+", piece) if w]
        if words:
            yield words


def brute(rows, top, least, inside, longest):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "a", "b", "é", "日本", "x" * 300, "new", "york", "city", "\x0b", "\x00", "\xa0w", "a.b", ","]
    made = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        made.append((rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", ".", "\n"]), rng.choice(["en", "fr", None])))
    passage = " ".join(rng.choice("abcdefgh") for _ in range(200))
    return [*made, *[(passage, "en")] * 12, (None, "en"), ("", None), (" . ", "xx"), ("same " * 5000, "de"), ("one", "it")]


@pytest.mark.parametrize("longest, least, top, inside", [(3, 10, 2000, 50), (2, 3, 7, 50), (4, 5, 40, 90)])
def test_collocations(spark, rows, longest, least, top, inside):
    df = spark.createDataFrame([(1, t, lang, "x", 1, 2) for t, lang in rows], DOCS).repartition(4)
    got = ph.collocations(df, top, least, inside, longest).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, top, least, inside, longest)


def test_full_filter_and_small_flushes_change_nothing(spark, rows, monkeypatch):
    """A filter in which every bit is set and a flush after every group give the same phrases."""
    monkeypatch.setattr(ph, "FILTER_BITS", 64)
    monkeypatch.setattr(ph, "HELD", 4)
    df = spark.createDataFrame([(1, t, lang, "x", 1, 2) for t, lang in rows], DOCS)
    assert sorted(tuple(r) for r in ph.collocations(df).collect()) == brute(rows, 2000, 10, 50, 3)


def test_empty(spark):
    assert ph.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert ph.collocations(spark.createDataFrame([(1, None, None, "", 1, 1)], DOCS)).count() == 0


@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_every_word_starts_in_one_chunk(overlap):
    rng = random.Random(overlap)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    raw = [t.encode() for t in texts]
    data, starts, ends, bounds = ph.plain_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    begins, stops, final = ph.chunk_bounds(hash_words(data, starts, ends), bounds, overlap)
    counted = [w for a, b, last in zip(begins, stops, final) for w in range(a, b if last else b - overlap)]
    assert counted == list(range(len(starts)))
    for a, b, last in zip(begins, stops, final):
        assert np.searchsorted(bounds, a, side="right") == np.searchsorted(bounds, b - 1, side="right") and (last or b - a > overlap)


def test_copies_share_chunks(spark):
    rng = random.Random(8)
    passage = " ".join(rng.choice("abcdefghijklmnop") for _ in range(2000))
    df = spark.createDataFrame([(k, f"start {k} " + passage, "en", "", 1, 1) for k in range(20)], DOCS)
    found = ph.dictionary(df).toPandas()
    assert found["times"].max() >= 20 and found["chunk"].str.len().sum() < 3 * len(passage)
