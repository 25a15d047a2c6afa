"""Benchmark decontamination by a BM25 index with block-max bounds (operator 7).

The test items are the indexed documents, training passages are the queries.
Items are indexed in blocks of bounded size, one block of items after another, so
the index that tasks hold has a fixed bound while any number of items is served.
Inside a block of items, postings are cut into runs of ``RUN`` items with the
largest impact of each term in each run.  Impacts are divided by the item's own
score, so the share of the item that a passage covers is the sum of the impacts
of their common terms, and one threshold fits all items.

Every passage is a query: windows of ``PASSAGE`` words (or twice the longest
item of the block, if that is more), moved by half a window, over whole texts.  A run is opened only if the sum of its largest impacts reaches
the threshold (block-max); inside an open run, terms are taken in the order of
falling bounds and an item is dropped as soon as what is left cannot lift it to
the threshold, as WAND does.  Every item above the threshold comes out.

Hits are then verified on the text: the words of the item must be found in the
order of the item around the passage.  The share of the item's word pairs that
occurs as pairs in the region, for the question (all but the last fifth of the
words) and for the answer (that fifth), must both reach their thresholds.

Defined cases: null or empty passages and items hit nothing; items of fewer than
``MIN_WORDS`` words are indexed but match only as a whole; repeated items are
separate items; a document with several hits of an item gives one row, the best.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .packed import Shared, arrow_map, group_words, text_buffers, text_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGE = 96
RUN = 8
BLOCK_ITEMS = 2048
BLOCK_WORDS = 200_000
K1, B = 1.2, 0.75
MIN_SHARE = 0.6
QUESTION, ANSWER = 0.7, 0.6


class ItemIndex:
    """Normalised BM25 impacts of one block of items, with their runs and pair hashes."""

    def __init__(self, ids: list[int], texts: list[str], df: dict[int, int], items: int, mean_words: float, share: float) -> None:
        raw, offsets = text_buffers(pa.array(texts, pa.string()))
        words, _, _, bounds = group_words(raw, offsets, True)
        self.ids, self.share = np.array(ids, object), share
        self.items = [words[bounds[i] : bounds[i + 1]] for i in range(len(ids))]
        self.pairs = [_pairs(w) for w in self.items]
        # Every item fits whole into some passage, since passages move by half.
        self.passage = max(PASSAGE, 2 * max((len(w) for w in self.items), default=0))
        terms, item, impact = [], [], []
        for i, w in enumerate(self.items):
            term, count = np.unique(w, return_counts=True)
            if not len(term):
                continue
            n = np.array([df[int(t)] for t in term])
            idf = np.log1p((items - n + 0.5) / (n + 0.5))
            weight = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * len(w) / mean_words))
            terms.append(term)
            item.append(np.full(len(term), i))
            impact.append(weight / weight.sum())
        self.terms = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        term = np.searchsorted(self.terms, np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        item, impact = (np.concatenate(x) if x else np.zeros(0) for x in (item, impact))
        order = np.lexsort((item, term))
        self.item, self.impact = item[order].astype(np.int64), impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        runs = (len(ids) + RUN - 1) // RUN
        self.bound = np.zeros((len(self.terms) + 1, runs), np.float32)
        np.maximum.at(self.bound, (term[order], self.item // RUN), self.impact.astype(np.float32) * np.float32(1 + 1e-6))

    def candidates(self, passage: np.ndarray) -> dict[int, float]:
        """Items of which the passage (term numbers, each once) covers the share."""
        found: dict[int, float] = {}
        bounds = self.bound[passage]
        for run in np.flatnonzero(bounds.sum(axis=0) >= self.share):
            column = bounds[:, run]
            order = np.argsort(-column)
            order = order[column[order] > 0]
            left = np.cumsum(column[order][::-1])[::-1]
            scores: dict[int, float] = {}
            for place, k in enumerate(order):
                term, rest = passage[k], float(left[place])
                lo, hi = self.first[term], self.first[term + 1]
                a = lo + np.searchsorted(self.item[lo:hi], run * RUN)
                while a < hi and self.item[a] < (run + 1) * RUN:
                    item = int(self.item[a])
                    held = scores.get(item, 0.0)
                    # An unseen item needs all that is left; a seen one what it lacks.
                    if held + rest >= self.share:
                        scores[item] = held + float(self.impact[a])
                    a += 1
            found.update({i: s for i, s in scores.items() if s >= self.share - 1e-9})
        return found


def _pairs(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]


def overlap(index: ItemIndex, item: int, region: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and the answer's word pairs found in the region."""
    own = index.pairs[item]
    if not len(own):
        whole = float(len(index.items[item]) > 0 and bool(np.isin(index.items[item], region).all()))
        return whole, whole
    found = np.isin(own, _pairs(region))
    cut_at = max(1, int(np.ceil(len(own) * 0.8))) if len(own) > 1 else 1
    answer = found[cut_at:] if cut_at < len(own) else found
    return float(found[:cut_at].mean()), float(answer.mean())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Items in order of their identifier, in lists of bounded size."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("text") > 0)).orderBy("id", "text")
    held, words = [], 0
    for row in rows.toLocalIterator():
        n = row.text.count(" ") + 1
        if held and (len(held) >= BLOCK_ITEMS or words + n > BLOCK_WORDS):
            yield held
            held, words = [], 0
        held.append((row.id, row.text))
        words += n
    if held:
        yield held


def _statistics(benchmark: DataFrame, text_col: str) -> tuple[int, float]:
    """Number of items and their mean length, over all of them."""
    words = F.size(F.filter(F.split(F.col(text_col).cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    row = benchmark.where(F.length(text_col) > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(words).alias("mean")).first()
    return row.n, max(1.0, row.mean or 1.0)


def _frequencies(benchmark: DataFrame, text_col: str, block: list) -> dict[int, int]:
    """In how many items of the whole benchmark each term of the block occurs."""
    raw, offsets = text_buffers(pa.array([t for _, t in block], pa.string()))
    terms = np.unique(group_words(raw, offsets, True)[0])
    shared = Shared(benchmark.sparkSession, terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.get()
        held = np.zeros(len(wanted), np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            words, _, _, bounds = group_words(raw, offsets, True)
            for i in range(batch.num_rows):
                own = np.unique(words[bounds[i] : bounds[i + 1]])
                at = np.searchsorted(wanted, own)
                at = at[(at < len(wanted)) & (wanted[np.minimum(at, max(0, len(wanted) - 1))] == own)] if len(wanted) else at[:0]
                held[at] += 1
        near = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(held[near])], ["term", "n"])

    rows = arrow_map(benchmark.select(F.lower(F.col(text_col).cast("string")).alias("text")), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(terms[r.term]): r.n for r in rows}


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = MIN_SHARE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(id, item, score, question, answer, start, end): verified items of every document.

    ``start`` and ``end`` are word positions of the passage.
    """
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    kinds = source.schema["id"].dataType.simpleString(), benchmark.select(item_col).schema[0].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, score double, question double, answer double, start long, end long"
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    n, mean = _statistics(benchmark, item_text_col)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        index = ItemIndex([i for i, _ in block], [t for _, t in block], _frequencies(benchmark, item_text_col, block), n, mean, share)
        # Size bound: BLOCK_ITEMS items of BLOCK_WORDS words in all.
        part = arrow_map(source, _search(Shared(docs.sparkSession, index), question, answer, item_kind), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _search(shared: Shared, question: float, answer: float, item_kind: pa.DataType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.get()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for first, to, raw, offsets in text_groups(batch.column(1)):
                words, _, _, bounds = group_words(raw, offsets, True)
                for k, item, *hit in _hits(index, words, bounds, question, answer):
                    rows.append((ids[first + k], index.ids[item], *hit))
            kinds = (batch.column(0).type, item_kind, pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(7)], ["id", "item", "score", "question", "answer", "start", "end"])

    return task


def _hits(index: ItemIndex, words: np.ndarray, bounds: np.ndarray, question: float, answer: float) -> Iterator[tuple]:
    if not len(words) or not len(index.terms):
        return
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.where(index.terms[at] == words, at, len(index.terms))
    best_of = index.bound.max(axis=1)
    # Passages of half a window's step; the bound over all runs prunes most at once.
    half = index.passage // 2
    weight = np.concatenate(([0.0], np.cumsum(best_of[known])))
    for k in range(len(bounds) - 1):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        if hi == lo:
            continue
        starts = np.arange(lo, max(lo + 1, hi - half), half)
        ends = np.minimum(starts + index.passage, hi)
        best: dict[int, tuple] = {}
        for a, b in zip(starts[weight[ends] - weight[starts] >= index.share], ends[weight[ends] - weight[starts] >= index.share]):
            own = np.unique(known[a:b])
            own = own[own < len(index.terms)]
            if best_of[own].sum() < index.share:
                continue
            for item, score in index.candidates(own).items():
                size = len(index.items[item])
                region = words[max(lo, a - size) : min(hi, b + size)]
                q, r = overlap(index, item, region)
                if q >= question and r >= answer and (item not in best or score > best[item][0]):
                    best[item] = (score, q, r, int(a - lo), int(b - lo))
        for item, hit in best.items():
            yield (k, item, *hit)


def contaminated(found: DataFrame) -> DataFrame:
    """(id, items, best): documents to remove, with the number of items and the best score."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), "item")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") == 1)
    counts = found.groupBy("id").agg(F.countDistinct("item").alias("items"))
    return top.select("id", F.col("item").alias("best_item"), "score").join(counts, "id")
