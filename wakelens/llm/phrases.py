"""Phrase collocation mining by prefix-free parsing (operator 11).

The words of a text are parsed into chunks: a chunk ends where the last ``longest -
1`` words' hash hits a trigger, and the next one starts with those words.  So the
same passage gives the same chunks wherever it stands, and chunks overlap by just
as many words as a phrase may reach across.  The dictionary of distinct chunks
with their frequencies is a fraction of a corpus with copies, and it is all that
is read from then on.  A phrase belongs to the chunk in which it starts before
the overlap, so every occurrence is counted once; its count is the sum of its
chunks' frequencies.

Counting takes two passes over the dictionary.  The first counts words and pairs of
neighbouring words by 64-bit hash, packed and dealt out by hash; a task sends a
hash once per flush.  Hashes with ``least`` occurrences are put in a filter of at
most ``FILTER_BITS``.  The second pass sends as strings the words and pairs that
may be frequent and the longer phrases all of whose pairs may be; their sums are
exact, and only those that reach ``least`` stay.  A shared hash or a full filter lets more phrases through to
the exact count, never fewer.

Scores are integers: products are decimals of 38 digits, so they are exact up to
counts of 10**14.

Defined cases: a null or empty text, or one without words, adds nothing; a null
language is ``und``; repeated rows count again; equal scores go by count, then
phrase in byte order; an empty table gives no phrases; only the named columns are
read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .packed import Shared, arrow_map, bloom, hash_words, maybe_in, mix, slices, text_groups, window_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
# One word in so many ends a chunk, on average.
CHUNK_WORDS = 24
BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
LINE, SPACE = 0x0A, 0x20
# Hashes a task holds before it sends them; entries of one counting group; buckets by leading bits.
HELD = 1 << 21
GROUP_ENTRIES = 1 << 22
BUCKET_BITS = 8
FILTER_BITS = 1 << 28


def _kinds() -> np.ndarray:
    """0: part of a word, 1: blank, 2: end of a piece."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(BLANKS)], kinds[list(STOPS)] = 1, 2
    return kinds


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def plain_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case with one byte between words (a line end between pieces).

    Returns the bytes, starts and ends of the words in them, and the first word of
    each text (and the end).  A text's last word is followed by a line end.
    """
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    # A line end after every text keeps words of different texts apart.
    raw = np.insert(_lower()[raw], offsets[1:], np.uint8(LINE))
    offsets = offsets + np.arange(len(offsets))
    kind = _kinds()[raw]
    word = kind == 0
    starts = np.flatnonzero(word & ~np.append(False, word[:-1]))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    if not len(starts):
        return raw[:0], starts, ends, np.zeros(len(offsets), np.int64)
    stops = np.append(0, np.cumsum(kind == 2))
    gap = np.append(starts[1:], len(raw))
    raw[ends] = np.where(stops[gap] > stops[ends], LINE, SPACE)
    kept = word.copy()
    kept[ends] = True
    sizes = ends - starts + 1
    to = np.cumsum(sizes)
    return raw[kept], to - sizes, to - 1, np.searchsorted(starts, offsets)


def chunk_bounds(hashes: np.ndarray, bounds: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and whether it is the text's last, of every chunk of several texts."""
    windows = window_hashes(hashes, overlap, 11)
    hit = np.flatnonzero(windows % np.uint64(CHUNK_WORDS) == 0) + overlap - 1
    owner = np.searchsorted(bounds, hit, side="right") - 1
    # The window lies in one text, a word stands before it, and one follows.
    hit = hit[(hit - overlap >= bounds[owner]) & (hit + 1 < bounds[owner + 1])]
    filled = np.flatnonzero(np.diff(bounds))
    begins = np.sort(np.concatenate((bounds[filled], hit - overlap + 1)))
    owner = np.searchsorted(bounds[filled], begins, side="right") - 1
    final = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(final, bounds[filled + 1][owner], np.append(begins[1:], 0) + overlap)
    return begins, ends, final


def dictionary(docs: DataFrame, longest: int = 3, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, chunk, times): the distinct chunks of every language.

    Words are parted by a blank and pieces by a line end; a text's last chunk ends with a line end.
    """
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    overlap = max(longest - 1, 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, raw, offsets in text_groups(batch.column(1)):
                data, starts, ends, bounds = plain_words(raw, offsets)
                if not len(starts):
                    continue
                begins, stops, final = chunk_bounds(hash_words(data, starts, ends), bounds, overlap)
                at = starts[begins]
                until = ends[stops - 1] + final
                owner = np.searchsorted(bounds, begins, side="right") - 1
                langs = batch.column(0).slice(row, to - row).take(pa.array(owner))
                sizes = until - at
                out = np.cumsum(sizes)
                text = data[np.repeat(at - (out - sizes), sizes) + np.arange(out[-1])]
                chunks = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(0, out).astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())
                table = pa.table({"lang": langs, "chunk": chunks}).group_by(["lang", "chunk"]).aggregate([([], "count_all")])
                for part in table.select(["lang", "chunk", "count_all"]).rename_columns(["lang", "chunk", "times"]).to_batches():
                    yield part

    return arrow_map(slim, task, "lang string, chunk string, times long").groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


class Chunks:
    """Words of a run of chunks, with the weight of each and the starts that count."""

    def __init__(self, batch: pa.RecordBatch, row: int, to: int, raw: np.ndarray, offsets: np.ndarray, overlap: int) -> None:
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        word = (raw != SPACE) & (raw != LINE)
        edge = np.zeros(len(raw), bool)
        edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
        self.starts = np.flatnonzero(word & (edge | ~np.append(False, word[:-1])))
        self.ends = np.flatnonzero(word & (np.append(edge[1:], True) | ~np.append(word[1:], False))) + 1
        self.raw = raw
        self.bounds = np.searchsorted(self.starts, offsets)
        counts = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(to - row), counts)
        final = raw[np.maximum(offsets[1:] - 1, 0)] == LINE
        self.counted = np.arange(len(self.starts)) < np.repeat(self.bounds[1:] - np.where(final, 0, overlap), counts)
        weights = batch.column(2).slice(row, to - row).to_numpy()
        self.weights = weights[self.owner]
        self.langs = batch.column(0).slice(row, to - row)
        salts = {name: np.frombuffer(_digest(name), np.uint64)[0] for name in self.langs.unique().to_pylist()}
        self.salt = np.array([salts[x] for x in self.langs.to_pylist()], np.uint64)[self.owner]
        self.hashes = mix(hash_words(raw, self.starts, self.ends) ^ self.salt)
        # Whether the next word is of the same piece and chunk.
        follows = np.zeros(len(self.starts), bool)
        if len(self.starts) > 1:
            follows[:-1] = (self.owner[1:] == self.owner[:-1]) & (raw[np.minimum(self.ends[:-1], len(raw) - 1)] == SPACE)
        self.follows = follows

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the pair that starts at every word, and whether there is one."""
        out = np.zeros(len(self.hashes), np.uint64)
        out[: max(len(self.hashes) - 1, 0)] = window_hashes(self.hashes, 2)
        return out, self.follows

    def phrases(self, at: np.ndarray, width: int) -> pa.RecordBatch:
        """(lang, phrase, times) of the phrases of ``width`` words from the words ``at``, equal ones of a language summed."""
        begin, end = self.starts[at], self.ends[at + width - 1]
        sizes = end - begin
        out = np.cumsum(sizes)
        text = self.raw[np.repeat(begin - (out - sizes), sizes) + np.arange(out[-1] if len(out) else 0)]
        names = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(0, out).astype(np.int64)), pa.py_buffer(text)])
        table = pa.table({"lang": self.langs.take(pa.array(self.owner[at])), "phrase": names.cast(pa.string()), "times": pa.array(self.weights[at])})
        summed = table.group_by(["lang", "phrase"]).aggregate([("times", "sum")]).select(["lang", "phrase", "times_sum"]).rename_columns(["lang", "phrase", "times"])
        return summed.combine_chunks()


def _digest(name: str) -> bytes:
    import hashlib

    return hashlib.blake2b(name.encode("utf-8"), digest_size=8).digest()


def _chunks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Chunks]:
    for batch in batches:
        for row, to, raw, offsets in text_groups(batch.column(1)):
            yield Chunks(batch, row, to, raw, offsets, overlap)


def _summed(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, weights = hashes[order], weights[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def frequent(chunks: DataFrame, least: int, overlap: int) -> DataFrame:
    """(hash): the words and pairs of neighbouring words with at least ``least`` occurrences in their language."""
    # A group of the exchange holds about ``GROUP_ENTRIES`` hashes at any size; four bytes a word is little.
    entries = (chunks.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0) // 4
    bits = max(BUCKET_BITS, int(np.ceil(np.log2(max(entries, 1) / GROUP_ENTRIES))))
    kind = np.uint8 if least < 256 else np.uint32

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in _chunks(batches, overlap):
            pair, there = part.pairs()
            at = there & part.counted
            held.append(_summed(np.concatenate((part.hashes[part.counted], pair[at])), np.concatenate((part.weights[part.counted], part.weights[at]))))
            size += len(held[-1][0])
            if size >= HELD:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield _packed(*held.pop(), bits, least, kind)
                    size = 0
        if size:
            yield _packed(*_summed(*map(np.concatenate, zip(*held))), bits, least, kind)

    def count(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("hashes")])
        times = np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column("times")]).astype(np.int64)
        found, total = _summed(hashes, times)
        return pa.table({"hash": pa.array(found[total >= least].view(np.int64))})

    return arrow_map(chunks, send, "part long, hashes binary, times binary").groupBy("part").applyInArrow(count, "hash long")


def _packed(hashes: np.ndarray, times: np.ndarray, bits: int, least: int, kind: type) -> pa.RecordBatch:
    """A row a bucket; counts beyond ``least`` need not be told apart."""
    times = np.minimum(times, least).astype(kind)
    rows = [(b, hashes[s].tobytes(), times[s].tobytes()) for b, s in slices(hashes, bits)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["part", "hashes", "times"])


def counts(chunks: DataFrame, often: DataFrame, least: int, longest: int = 3) -> DataFrame:
    """(lang, phrase, width, times): exact counts of the words and phrases that occur ``least`` times.

    ``often`` holds the hashes of ``frequent``.  The row with an empty phrase holds
    all word occurrences of its language.
    """
    overlap = max(longest - 1, 1)
    bits = min(FILTER_BITS, 1 << max(16, (16 * often.count()).bit_length()))
    shared = Shared(chunks.sparkSession, bloom(often, "hash", bits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.get()

        def sized(found: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
            yield from found.append_column("width", pa.array(np.full(len(found), width, np.int32))).select(["lang", "phrase", "width", "times"]).to_batches()

        for part in _chunks(batches, overlap):
            pair, there = part.pairs()
            likely = there.copy()
            likely[there] = maybe_in(held, pair[there])
            counted = np.flatnonzero(part.counted)
            totals = pa.table({"lang": part.langs.take(pa.array(part.owner[counted])), "times": pa.array(part.weights[counted])}).group_by("lang").aggregate([("times", "sum")])
            yield from sized(pa.table({"lang": totals["lang"], "phrase": pa.array([""] * len(totals), pa.string()), "times": totals["times_sum"]}), 0)
            yield from sized(part.phrases(counted[maybe_in(held, part.hashes[counted])], 1), 1)
            run = likely
            for width in range(2, longest + 1):
                if width > 2:
                    run = run & np.append(likely[width - 2 :], np.zeros(width - 2, bool))
                at = np.flatnonzero(run & part.counted)
                if len(at):
                    yield from sized(part.phrases(at, width), width)

    summed = arrow_map(chunks, task, "lang string, phrase string, width int, times long").groupBy("lang", "phrase", "width").agg(F.sum("times").alias("times"))
    return summed.where((F.col("width") == 0) | (F.col("times") >= least))


def candidates(counted: DataFrame, inside_percent: int) -> DataFrame:
    """(lang, phrase, width, a, l, r, n, score): the scored phrases that no longer one takes in."""
    phrases = counted.where(F.col("width") > 1)
    words = F.split("phrase", " ")
    part = lambda lo, size: F.array_join(F.slice("words", lo, size), " ")
    split = phrases.select("lang", "phrase", "width", F.col("times").alias("a"), words.alias("words")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    split = split.withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("width") - F.col("k"))).drop("words")
    known = counted.where(F.col("width") > 0).select(F.col("lang").alias("lang_"), F.col("phrase").alias("part"), "times")
    for side, name in (("left", "l"), ("right", "r")):
        of = known.select("lang_", "part", F.col("times").alias(name))
        split = split.join(of, (split["lang"] == of["lang_"]) & (split[side] == of["part"])).drop("lang_", "part")
    wide = lambda name: F.col(name).cast("decimal(18,0)")
    above = F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")
    scored = split.withColumn("above", above).withColumn("below", wide("l") * wide("r")).withColumn("score", F.expr("above div below"))
    least_cut = scored.groupBy("lang", "phrase", "width", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.where(F.col("width") > 2).select(F.col("lang").alias("lang_"), F.col("times").alias("longer"), F.col("width").alias("w"), F.split("phrase", " ").alias("words"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("w") - 1))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("w") - F.col("size") + 1)))
    taken = longer.select("lang_", part(F.col("from"), F.col("size")).alias("part"), "longer").groupBy("lang_", "part").agg(F.max("longer").alias("longer"))
    left = least_cut.join(taken, (least_cut["lang"] == taken["lang_"]) & (least_cut["phrase"] == taken["part"]), "left")
    kept = left.where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    totals = counted.where(F.col("width") == 0).select(F.col("lang").alias("of"), F.col("times").alias("n"))
    return kept.join(F.broadcast(totals), kept["lang"] == F.col("of")).select("lang", "phrase", "width", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, inside_percent: int = 50, longest: int = 3, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of every language by score: lang, rank, phrase, a, l, r, n, score."""
    chunks = cut(dictionary(docs, longest, lang_col, text_col))
    often = cut(frequent(chunks, least, max(longest - 1, 1)))
    counted = cut(counts(chunks, often, least, longest))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The rank's bound reaches below the exchange: a task sends at most ``top`` rows a language.
    ranked = candidates(counted, inside_percent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
