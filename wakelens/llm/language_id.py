"""Language identification with error-correcting output codes (operator 1).

Every language gets a codeword.  One linear classifier over hashed character
n-grams per bit predicts whether the bit is set: its weights are the logarithms
of the odds of the n-gram in the languages with the bit and in those without it,
each language counting the same however many rows it has.  A text takes the
language whose codeword loses least against the predicted margins; a bit counts
the more for a language, the more often it was right for it in the sample.
A small lead over the second codeword is flagged as ambiguous.

The classifiers are fitted on at most ``per_language`` texts of each language,
those whose identifiers hash lowest.  Everything else covers all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
is ambiguous; without labelled rows every text is ``und``; with one language all
texts with a letter get it.  Every row gives one row, repeated rows included.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .packed import Shared, arrow_map, mix, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
PER_LANGUAGE = 600
SPAN_BITS = 16
PIECE = 1 << 16
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def text_grams(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams (one to four letters) of a text, and its letters."""
    letters = worker_cache("letters", _letters)
    counts, total = np.zeros(BUCKETS, np.int64), 0
    for i in range(0, len(text), PIECE):
        # A piece looks back so that no n-gram is lost between two of them.
        raw = np.frombuffer(text[max(0, i - 3) : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[raw]
        total += int(is_letter.sum())
        c = np.where(is_letter, raw, np.uint32(32)).astype(np.uint64)
        c = c[~((c == 32) & (np.concatenate(([0], c[:-1])) == 32))]
        h = c
        for n in range(2, 5):
            if len(c) < n:
                break
            with np.errstate(over="ignore"):
                h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
                counts += np.bincount((mix(h + np.uint64(n)) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return counts, total


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1: all distinct splits up to five languages, else hashed ones.

    A hashed column is kept if it splits the languages and is new; there are
    ``15 + 4 log2(languages)`` of them, so codewords lie far apart.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        masks = [m for m in range(1, 1 << (languages - 1))]
        return np.array([[1.0 if m >> k & 1 else -1.0 for m in masks] for k in range(languages)])
    wanted, seen, columns, seed = 15 + 4 * int(np.ceil(np.log2(languages))), set(), [], 0
    while len(columns) < wanted:
        bits = (mix(np.arange(languages, dtype=np.uint64) + np.uint64(seed << 20)) >> np.uint64(63)).astype(int)
        seed += 1
        bits = bits ^ bits[0]
        if 0 < bits.sum() < languages and tuple(bits) not in seen and abs(int(bits.sum()) * 2 - languages) <= max(2, languages // 4):
            seen.add(tuple(bits))
            columns.append(2.0 * bits - 1.0)
    return np.array(columns).T


@dataclass
class Coded:
    """Fitted classifiers: n-gram weights and scale per bit, codewords, bit reliability."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each codeword."""
        margin = np.tanh((counts @ self.weights) / max(1, counts.sum()) / self.scale)
        return (self.trust * np.exp(-self.code * margin)).sum(axis=1)

    def predict(self, text: str | None, lead: float) -> tuple[str, float, bool]:
        counts, letters = text_grams(text) if text else (None, 0)
        if not letters or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(counts)
        odds = np.exp(-(loss - loss.min()) * 8.0)
        odds /= odds.sum()
        best = int(np.argmin(loss))
        return self.languages[best], float(odds[best]), bool(odds[best] - np.sort(odds)[-2] < lead)


def labelled_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows a language, by hash of the identifier."""
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN))
    ids = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h"))
    # Counts of the hashes' leading bits tell beyond which no hash can be picked, so few rows meet in the ranking of a language.
    span = F.shiftright("h", 64 - SPAN_BITS)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    counts = ids.groupBy("lang", span.alias("span")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    # Written, so that the size of this one row a language is known before the join.
    near = cut(counts.where(F.col("before") < per_language).groupBy("lang").agg(F.max("span").alias("span")))
    lowest = Window.partitionBy("lang").orderBy("h", "id")
    picked = ids.join(near, "lang").where(span <= F.col("span")).withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= per_language)
    # One row a language, the bound of its sample; written, so that its size is known before the join.
    last = cut(picked.groupBy("lang").agg(F.max("h").alias("last")))
    texts = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    return texts.join(last, "lang").where(F.col("h") <= F.col("last")).select("lang", "text")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Coded:
    """Fit one classifier per code bit; tasks send one row of sums per language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, letters = text_grams(text)
                if letters:
                    part = held.setdefault(lang, np.zeros(BUCKETS))
                    part += counts / max(1, counts.sum())
        for lang, total in held.items():
            near = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(near)), pa.array(near), pa.array(total[near])], ["lang", "bucket", "share"])

    sample = labelled_sample(df, id_col, text_col, lang_col, per_language)
    rows = arrow_map(sample, sums, "lang string, bucket long, share double").groupBy("lang", "bucket").agg(F.sum("share").alias("share")).toPandas()
    languages = sorted(rows["lang"].unique()) if len(rows) else []
    shares = np.full((len(languages), BUCKETS), 0.0)
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        shares[k, own["bucket"].to_numpy()] = own["share"].to_numpy()
    model = _classifiers(languages, shares)
    return _reliability(sample, model) if len(languages) > 1 else model


def _classifiers(languages: list[str], shares: np.ndarray) -> Coded:
    code = codewords(len(languages))
    if len(languages) < 2:
        return Coded(languages, code, np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1]), np.ones(code.shape))
    chance = shares / shares.sum(axis=1, keepdims=True) + 0.05 / BUCKETS
    weights = np.stack([np.log(chance[bit > 0].mean(axis=0) / chance[bit < 0].mean(axis=0)) for bit in code.T], axis=1)
    typical = np.abs(chance @ weights)
    return Coded(languages, code, weights.astype(np.float32), np.maximum(typical.min(axis=0), 1e-6), np.ones(code.shape) / code.shape[1])


def _reliability(sample: DataFrame, model: Coded) -> Coded:
    """Weight the bits of each language by how often they are right for it."""
    languages, bits = model.languages, model.code.shape[1]
    shared = Shared(sample.sparkSession, model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, held = shared.get(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, letters = text_grams(text)
                if letters and lang in fitted.languages:
                    agree = np.sign(counts @ fitted.weights) == fitted.code[fitted.languages.index(lang)]
                    part = held.setdefault(lang, np.zeros(bits + 1))
                    part += np.append(agree, 1)
        for lang, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (bits + 1)), pa.array(np.arange(bits + 1)), pa.array(part)], ["lang", "bit", "n"])

    rows = arrow_map(sample, right, "lang string, bit long, n double").groupBy("lang", "bit").agg(F.sum("n").alias("n")).toPandas()
    table = rows.pivot(index="lang", columns="bit", values="n").reindex(languages).to_numpy() if len(rows) else np.ones((len(languages), bits + 1))
    hits = (table[:, :bits] + 1.0) / (table[:, bits:] + 2.0)
    model.trust = hits / hits.sum(axis=1, keepdims=True)
    return model


def predict(df: DataFrame, model: Coded, id_col: str = "doc_id", text_col: str = "text", lead: float = 0.1) -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every whole text."""
    # Size bound: buckets times code bits, whatever the corpus.
    shared = Shared(df.sparkSession, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.get()
        for batch in batches:
            out = [fitted.predict(t, lead) for t in batch.column(1).to_pylist()]
            langs, scores, flags = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, task, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def label(df: DataFrame, model: Coded, text_col: str = "text", lead: float = 0.1) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``ambiguous`` added to every row.

    Columns of these names, in any case, are replaced.
    """
    shared = Shared(df.sparkSession, model)
    df = df.drop("lang_pred", "score", "ambiguous")
    place = df.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.get()
        for batch in batches:
            out = [fitted.predict(t, lead) for t in batch.column(place).to_pylist()]
            langs, scores, flags = zip(*out) if out else ((), (), ())
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return arrow_map(df, task, f"{schema}, lang_pred string, score double, ambiguous boolean")
