"""Token ids in binary files, frequent ids short (operator 12).

Ids are replaced by their rank in falling frequency over the whole corpus, so the
commonest 256 take one byte.  Ranks are written byte-aligned and of variable
length, and the lengths stand apart in control bytes: one bit an id (one or two
bytes) where the vocabulary has at most 65,536 ids, two bits (one to four bytes)
beyond.  Reading looks the lengths of a whole control byte up in a table of 256
rows and takes all ids of a block at once with numpy.

A folder of token files holds ``blocks`` (Parquet files as containers: control and
data bytes of about ``BLOCK_IDS`` ids a row, with the documents' identifiers and
lengths) and ``ranks`` (id and rank, at most one row an id of the vocabulary).
Files follow one another in ascending identifiers, nulls first; a block says how
many ids its file holds before it.  They can be written to and read from every
store that Spark knows.

Texts are encoded once: they are cut where the library surely cuts them too, and
the library's results for the parts are memoised.  Only coded ids are exchanged.  Equal identifiers are told
apart by content, then by a salt, so one that a third of all rows bear is dealt
out like any other.

Defined cases: a null or empty text has the end id only; rows with equal
identifiers stay rows of their own, ordered by their ids; an empty table gives
files without documents; only the named columns are read.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .packed import Shared, arrow_map, hash_words, text_groups, worker_slot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 1 << 18
SMALL_VOCABULARY = 1 << 16
# Memoised parts of a worker; when it holds more it starts anew.
MAX_PARTS = 1_200_000
TOGETHER = 500
SALTS = 1 << 20
# Bytes of ids that are coded at once.
SHRUNK_BYTES = 1 << 22
SPACE, LINE = 0x20, 0x0A
MARKS = b".,;:!?"


def borders(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a part surely starts, and which bytes belong to Latin letters.

    What stands on both sides of a border is split and merged apart whatever the
    text around it: before a blank between two characters no library counts as
    white space, between a Latin letter and a plain mark, before a line end after
    a letter, and between a single line end and a letter.
    """
    kinds = np.zeros(256, np.uint8)  # 1: letter, 2: other visible, 4: mark or line end
    kinds[0x21:0x7F] = 2
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 3
    kinds[list(MARKS)] = 6
    kinds[LINE] = 4
    kind = kinds[raw]
    after = np.append(raw[1:], np.uint8(0))
    # U+00C0 to U+024F without the two signs: lead bytes C3 to C9.
    lead = (raw >= 0xC3) & (raw <= 0xC9) & (after >= 0x80) & ((raw != 0xC9) | (after <= 0x8F)) & ((raw != 0xC3) | ((after != 0x97) & (after != 0xB7)))
    trail = np.append(False, lead[:-1])
    plain = (kind & 1).astype(bool)
    first, last = plain | lead, plain | trail
    seen = (kind & 2).astype(bool)
    seen_first, seen_last = seen | lead, seen | trail
    before = lambda flags, k=1: np.append(np.zeros(k, bool), flags[:-k]) if len(flags) >= k else np.zeros(len(flags), bool)
    stop = (kind & 4).astype(bool)
    mark, line = stop & seen, raw == LINE
    out = (raw == SPACE) & before(seen_last) & np.append(seen_first[1:], False)[: len(raw)]
    out |= stop & before(last)
    out |= first & (before(mark) | (before(line) & before(seen_last, 2)))
    return out, first | trail


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """A library tokenizer whose results for the parts of texts are memoised.

    Parts are told apart by 128 bits of two hashes.
    """

    def __init__(self, path: str) -> None:
        self.library = _library(path)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.second = np.zeros(1 << 10, np.uint64)
        self.at = np.zeros((1 << 10) + 1, np.int64)
        self.ids = np.zeros(1 << 12, "<u4")

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts (their UTF-8 bytes and offsets), and how many each text has."""
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        start, letter = borders(raw)
        start[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(raw))
        slots = self._slots(raw, starts, ends, letter)
        sizes = self.at[slots + 1] - self.at[slots]
        to = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.at[slots] - (to - sizes), sizes) + np.arange(to[-1])]
        bound = np.append(0, to)[np.searchsorted(starts, offsets)]
        return ids, np.diff(bound)

    def _slots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The place of every part's ids, learning what is new."""
        hashes, which, inverse = np.unique(hash_words(raw, starts, ends), return_index=True, return_inverse=True)
        second = hash_words(raw ^ np.uint8(0x5A), starts, ends)[which]
        if len(self.slots) > MAX_PARTS:
            self._clear()
        found = np.array([self.slots.get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(raw, starts[which[new]], ends[which[new]], letter, second[new])
            self.slots.update(zip(hashes[new].tolist(), found[new].tolist()))
        if (self.second[found] != second).any():
            raise ValueError("two parts of texts share a hash of 64 bits")
        return found[inverse]

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letter: np.ndarray, second: np.ndarray) -> np.ndarray:
        letters = np.append(0, np.cumsum(letter))
        # Blank and letters, blank and letters: the library takes such parts one by one.
        plain = (raw[starts] == SPACE) & (letters[ends] - letters[starts] == ends - starts - 1) & (ends - starts > 1)
        text = raw.tobytes()
        parts = [text[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())]
        found: list[np.ndarray] = [np.zeros(0, "<u4")] * len(parts)
        chosen = np.flatnonzero(plain).tolist()
        for k in range(0, len(chosen), TOGETHER):
            some = chosen[k : k + TOGETHER]
            coded = self.library.encode("".join([parts[j] for j in some]), add_special_tokens=False)
            ids, owner = np.array(coded.ids, "<u4"), np.array(coded.word_ids)
            cuts = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
            for j, a, b in zip(some, cuts[:-1], cuts[1:]):
                found[j] = ids[a:b]
        alone = np.flatnonzero(~plain).tolist()
        for j, coded in zip(alone, self.library.encode_batch_fast([parts[j] for j in alone], add_special_tokens=False)):
            found[j] = np.array(coded.ids, "<u4")
        return self._keep(found, second)

    def _keep(self, found: list[np.ndarray], second: np.ndarray) -> np.ndarray:
        n, sizes = len(self.slots), np.array([len(f) for f in found], np.int64)
        used, total = int(self.at[n]), int(sizes.sum())
        if n + len(found) > len(self.second):
            more = max(n + len(found), 2 * len(self.second))
            self.second, self.at = np.resize(self.second, more), np.resize(self.at, more + 1)
        if used + total > len(self.ids):
            self.ids = np.resize(self.ids, max(used + total, 2 * len(self.ids)))
        self.second[n : n + len(found)] = second
        self.at[n + 1 : n + len(found) + 1] = used + np.cumsum(sizes)
        self.ids[used : used + total] = np.concatenate(found)
        return np.arange(n, n + len(found))


def encode(docs: DataFrame, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every text as little-endian 32-bit integers, with the end id."""
    return _encoded(docs, vocabulary, end, id_col, text_col, "<u4").where("times is null").select("id", "ids")


def _encoded(docs: DataFrame, vocabulary: str, end: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(id, ids, times): documents without times, and one row a task with how often it met each id."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_slot(("tokens", vocabulary), lambda: Encoder(vocabulary))
        times, name = np.zeros(0, np.int64), None
        for batch in batches:
            name = batch.schema.field(0).type
            for row, to, raw, offsets in text_groups(batch.column(1)):
                ids, counts = encoder.encode(raw, offsets)
                whole = np.insert(ids, np.cumsum(counts), np.uint32(end))
                found = np.bincount(whole, minlength=len(times))
                found[: len(times)] += times
                times = found
                coded = binaries(whole.astype(kind), counts + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), coded, pa.nulls(to - row, pa.binary())], ["id", "ids", "times"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, name), pa.nulls(1, pa.binary()), pa.array([times.tobytes()], pa.binary())], ["id", "ids", "times"])

    return arrow_map(slim, task, f"id {dict(slim.dtypes)['id']}, ids binary, times binary")


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value of ``counts`` ids each."""
    ends = ids.itemsize * np.append(0, np.cumsum(counts))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def lengths_table(bits: int) -> np.ndarray:
    """Byte lengths of the ids of every control byte, first id in the lowest bits."""
    each = 8 // bits
    return (((np.arange(256)[:, None] >> (bits * np.arange(each))) & ((1 << bits) - 1)) + 1).astype(np.uint8)


def pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks``."""
    control, data, _, _ = pack_all(ranks, np.array([len(ranks)]), bits)
    return control.tobytes(), data.tobytes()


def pack_all(ranks: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of several documents one after another, and how many of each a document has."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8)
    if bits == 2:
        extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    each = 8 // bits
    n_control = -(-counts // each)
    shift = np.cumsum(n_control * each) - n_control * each - (np.cumsum(counts) - counts)
    places = np.zeros(int(n_control.sum()) * each, np.uint8)
    places[np.arange(len(ranks)) + np.repeat(shift, counts)] = extra
    control = np.bitwise_or.reduce(places.reshape(-1, each) << (bits * np.arange(each, dtype=np.uint8)), axis=1).astype(np.uint8)
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    sizes = np.append(0, np.cumsum(extra, dtype=np.int64))
    ends = np.cumsum(counts)
    return control, ranks.view(np.uint8).reshape(-1, 4)[used], n_control, counts + sizes[ends] - sizes[ends - counts]


def unpack(control: bytes, data: bytes, count: int, bits: int) -> np.ndarray:
    """The ``count`` ranks that ``pack`` coded."""
    sizes = lengths_table(bits)[np.frombuffer(control, np.uint8)].ravel()[:count].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32) if count else np.zeros(0, np.uint32)
    for k in range(1, 1 << bits):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def frequencies(coded: DataFrame) -> DataFrame:
    """(token, times) over all ids, from the counts of the tasks that wrote ``coded``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                times = np.frombuffer(raw.as_buffer(), np.int64)
                seen = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times[seen])], ["token", "times"])

    counted = coded.select("times").where("times is not null")
    return arrow_map(counted, task, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))


def _rank_arrays(ranks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every id and id of every rank; as large as the vocabulary, whatever the corpus."""
    table = ranks.select("token", "rank").toPandas()
    tokens, places = table["token"].to_numpy(np.int64), table["rank"].to_numpy(np.int64)
    of = np.zeros(int(tokens.max(initial=-1)) + 1, np.uint32)
    back = np.zeros(len(tokens), np.uint32)
    of[tokens], back[places] = places, tokens
    return of, back


def write(docs: DataFrame, folder: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write them as token files, in ascending identifiers."""
    spark = docs.sparkSession
    # Ids of two bytes where the vocabulary allows, for the one table between encoding and ranks.
    wide = "<u2" if max(_library(vocabulary).get_vocab_size() - 1, end) < 1 << 16 else "<u4"
    coded = cut(_encoded(docs, vocabulary, end, id_col, text_col, wide))
    ranked = frequencies(coded).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("times"), "token")) - 1)
    ranked.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    of, back = _rank_arrays(spark.read.parquet(f"{folder}/ranks"))
    bits = 1 if len(back) <= SMALL_VOCABULARY else 2
    shared = Shared(spark, of)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.get()
        for whole in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(whole.column(1)), np.int64))
            row = 0
            while row < len(whole):
                to = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + SHRUNK_BYTES, side="right")))
                batch, row = whole.slice(row, to - row), to
                raws = [v.as_buffer() for v in batch.column(1)]
                counts = np.array([v.size for v in raws], np.int64) // np.dtype(wide).itemsize
                control, data, n_control, n_data = pack_all(rank[np.frombuffer(b"".join(raws), wide)], counts, bits)
                checks = pa.array([zlib.crc32(v) for v in raws], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), checks, binaries(control, n_control), binaries(data, n_data)], ["id", "n", "check", "control", "data"])

    kind = dict(coded.dtypes)["id"]
    documents = coded.where("times is null").select("id", "ids")
    short = arrow_map(documents, shrink, f"id {kind}, n long, check long, control binary, data binary")
    salted = short.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    dealt = salted.repartitionByRange("id", "check", "n", "salt").sortWithinPartitions("id", "check", "n", "data", "salt")
    filed = dealt.select(F.spark_partition_id().alias("file"), "id", "n", "control", "data")
    arrow_map(filed, _blocks, f"file int, block long, before long, bits int, ids array<{kind}>, lengths array<long>, control binary, data binary").withColumn("bits", F.lit(bits)).write.mode("overwrite").parquet(f"{folder}/blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents; control bytes of a document start at a byte."""
    block = before = size = 0
    rows: list[tuple] = []
    kind, file = None, 0

    def sent() -> pa.RecordBatch:
        ids, lengths, control, data = zip(*rows)
        columns = [pa.array([file], pa.int32()), pa.array([block]), pa.array([before]), pa.array([0], pa.int32()), pa.array([list(ids)], pa.list_(kind)), pa.array([list(lengths)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary())], ["file", "block", "before", "bits", "ids", "lengths", "control", "data"])

    for batch in batches:
        kind = batch.schema.field(1).type
        for file, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            rows.append(tuple(row))
            size += row[1]
            if size >= BLOCK_IDS:
                yield sent()
                block, before, size, rows = block + 1, before + size, 0, []
    if rows:
        yield sent()


def starts(blocks: DataFrame) -> DataFrame:
    """(at, first): how many ids stand before every file; one row a file."""
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    totals = blocks.select("file", ids.alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    return totals.select(F.col("file").alias("at"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("first"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids): the documents of token files; ids as little-endian 32-bit integers."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    _, back = _rank_arrays(spark.read.parquet(f"{folder}/ranks"))
    shared = Shared(spark, back)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.get()
        for batch in batches:
            for k in range(len(batch)):
                start, bits = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                names, lengths = batch.column(2)[k].values, np.asarray(batch.column(3)[k].as_py(), np.int64)
                control, data = batch.column(4)[k].as_buffer(), batch.column(5)[k].as_buffer()
                each = 8 // bits
                padded = -(-lengths // each) * each
                # Unused places of a document's last control byte say one byte, yet no data is there.
                yield _documents(names, lengths, padded, control, data, bits, start, token)

    placed = blocks.join(F.broadcast(starts(blocks)), blocks["file"] == F.col("at")).select((F.col("first") + F.col("before")).alias("start"), "bits", "ids", "lengths", "control", "data")
    return arrow_map(placed, task, f"id {kind}, start long, n_tokens long, ids binary")


def _documents(names: pa.Array, lengths: np.ndarray, padded: np.ndarray, control: pa.Buffer, data: pa.Buffer, bits: int, start: int, token: np.ndarray) -> pa.RecordBatch:
    sizes = lengths_table(bits)[np.frombuffer(control, np.uint8)].ravel()
    first = np.cumsum(padded) - padded
    used = np.arange(int(padded.sum())) - np.repeat(first, padded) < np.repeat(lengths, padded)
    sizes = sizes[used].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, 1 << bits):
        longer = np.flatnonzero(sizes > k)
        ranks[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    ids = token[ranks].astype("<u4")
    ends, coded = np.cumsum(lengths), binaries(ids, lengths)
    return pa.RecordBatch.from_arrays([names, pa.array(start + ends - lengths), pa.array(lengths), coded], ["id", "start", "n_tokens", "ids"])


def check(ids: str = "ids") -> Column:
    """CRC-32 of a document's ids as little-endian unsigned 32-bit integers."""
    return F.crc32(F.col(ids))
