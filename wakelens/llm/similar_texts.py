"""Similarity join on word shingles by T-occurrence search (operator 8).

The set of a text is its distinct shingles.  Two texts link when their sets'
Jaccard similarity reaches the threshold.  Equal sets are one set from the start,
so copies cost nothing.

Where sets may meet: in an order of all shingles with frequent ones last, two
linked sets share one of the first n - ceil(t n) + 1 shingles.  Frequencies come
from an exchange of packed hashes and are held in filters of fixed size; they
only order shingles and leave out those that occur once, so what they miss costs
time, never a link.  Sets that share such a shingle, directly or in a chain, are
a family; every link lies within one.

Inside a family each set is a query against inverted lists (DivideSkip): the
short lists are merged, counting how often each set occurs; sets that can still
reach the overlap are looked up in the long lists by binary search; the exact
overlap decides.  Found sets leave the search and become the next queries, so a
group of near copies is taken in without comparing all its pairs.  A family of
more than ``block_sets`` sets is first dealt out into blocks by hash, ``DEALS``
times over, and searched inside the blocks; that alone brings a group of near
copies together, at a cost in proportion to its size.  Then only sets that are
still in different components need to meet: blocks are formed by component and
size, and a pair of blocks is a unit unless both are of one component or too
unlike in size to hold a link.  So no task holds a family however large it is.

Defined cases: a null or empty text, or one without words, has an empty set and
no link; with fewer words than a shingle the whole sequence is the one shingle;
repeated rows are linked copies; ties go to the smallest identifier.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components, stars
from .packed import Shared, arrow_map, bloom, free, group_words, low_bits, maybe_in, mix, rows_batch, slices, slot, text_groups, window_hashes, within_texts
from .repeated_passages import bucket_bits, keyed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLUSH = 1_000_000
FREQUENT = 16
FREQUENT_CELLS = 1 << 22
KEY_BITS = 1 << 25
SALT_SETS = 4096
BLOCK_SETS = 1024
UNIT_SETS = 1000
DEALS = 2


def text_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    words, _, _, bounds = group_words(raw, offsets, True)
    hashes = window_hashes(words, width)
    ok = np.flatnonzero(within_texts(len(hashes), width, bounds)) if len(hashes) else np.zeros(0, np.int64)
    owner = np.searchsorted(bounds, ok, "right") - 1
    hashes = hashes[ok]
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < width))
    if len(short):
        whole = [window_hashes(words[bounds[i] : bounds[i + 1]], int(bounds[i + 1] - bounds[i]))[0] for i in short]
        hashes, owner = np.concatenate((hashes, np.array(whole, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit number per set, from its members in any order."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)))
    twisted = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)))
    size = np.diff(at).astype(np.uint64)
    return mix(mix(total[at[1:]] - total[at[:-1]]) ^ (twisted[at[1:]] - twisted[at[:-1]]) + size).view(np.int64)


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(id, key, n, set): size and number of every row's set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers = [], []
            for _, _, raw, offsets in text_groups(batch.column(2)):
                hashes, at = text_sets(raw, offsets, width)
                sizes.append(np.diff(at))
                numbers.append(set_ids(hashes, at))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(numbers))], ["id", "key", "n", "set"])

    return arrow_map(texts, task, f"id {texts.schema['id'].dataType.simpleString()}, key long, n long, set long")


def _new_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, bounds, numbers) of the sets that a task has not met before."""
    met: set[int] = set()
    for batch in batches:
        for _, _, raw, offsets in text_groups(batch.column(2)):
            hashes, at = text_sets(raw, offsets, width)
            numbers, size = set_ids(hashes, at), np.diff(at)
            keep = [i for i in np.flatnonzero(size) if not (int(numbers[i]) in met or met.add(int(numbers[i])))]
            if keep:
                yield np.concatenate([hashes[at[i] : at[i + 1]] for i in keep]), np.concatenate(([0], np.cumsum(size[keep]))), numbers[keep]
            if len(met) > 200_000:
                met.clear()


_COUNTED = (("bucket", pa.int64()), ("low", pa.binary()), ("count", pa.binary()))


def _shingle_counts(width: int, bits: int):
    def flush(parts: list) -> Iterator[tuple]:
        hashes = np.sort(np.concatenate(parts))
        at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        count = np.minimum(np.diff(np.append(at, len(hashes))), 255).astype(np.uint8)
        hashes = hashes[at]
        low = low_bits(hashes, bits)
        for bucket, part in slices(hashes, bits):
            yield bucket, low[part].tobytes(), count[part].tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for hashes, _, _ in _new_sets(batches, width):
            parts.append(hashes)
            held += len(hashes)
            if held >= FLUSH:
                yield rows_batch(flush(parts), _COUNTED)
                parts, held = [], 0
        if held:
            yield rows_batch(flush(parts), _COUNTED)

    return task


def _frequencies(bits: int, filter_bits: int):
    """Per bucket: a filter of the shingles met twice, and cells with the logarithm of frequent ones."""
    own, cells = filter_bits >> bits, max(8, FREQUENT_CELLS >> bits)

    def reduce(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()])
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("count").to_pylist()])
        order = np.argsort(low, kind="stable")
        low, count = low[order], count[order]
        at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        total, low = np.add.reduceat(count.astype(np.int64), at), low[at]
        part, often = np.zeros(own, bool), np.zeros(cells, np.uint8)
        for k in range(2):
            part[slot(low[total > 1], k, own)] = True
        many = total >= FREQUENT
        np.maximum.at(often, slot(low[many], 7, cells), (2 * np.log2(total[many])).astype(np.uint8))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary()), "often": pa.array([often.tobytes()], pa.binary())})

    return reduce


class Frequencies:
    """What is known of the frequency of a shingle; of fixed size."""

    def __init__(self, bits: int, filter_bits: int) -> None:
        self.bits, self.own, self.cells = bits, filter_bits >> bits, max(8, FREQUENT_CELLS >> bits)
        self.twice = np.zeros((self.own // 8) << bits, np.uint8)
        self.often = np.zeros(self.cells << bits, np.uint8)

    def put(self, bucket: int, part: bytes, often: bytes) -> None:
        size = self.own // 8
        self.twice[bucket * size : (bucket + 1) * size] = np.frombuffer(part, np.uint8)
        self.often[bucket * self.cells : (bucket + 1) * self.cells] = np.frombuffer(often, np.uint8)

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """0 for a shingle met once, 1 for a rare one, then by the logarithm of its frequency."""
        low, bucket = low_bits(hashes, self.bits), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = np.ones(len(hashes), bool)
        for k in range(2):
            at = bucket * self.own + slot(low, k, self.own)
            seen &= (self.twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return np.where(seen, 1 + self.often[bucket * self.cells + slot(low, 7, self.cells)], 0).astype(np.int64)


_POSTED = (("bucket", pa.int64()), ("salt", pa.int64()), ("low", pa.binary()), ("set", pa.binary()))


def _postings(width: int, percent: int, bits: int, known: Shared):
    """Shared shingles of the prefixes; those of very many sets are dealt out by the set too."""

    def flush(parts: list) -> Iterator[tuple]:
        hashes, numbers, rank = (np.concatenate(x) for x in zip(*parts))
        often = np.maximum(0, rank - 1) / 2.0
        pieces = np.maximum(1, (2.0**often / SALT_SETS).astype(np.int64))
        salt = (mix(numbers.view(np.uint64)) % pieces.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((numbers, hashes, salt))
        hashes, numbers, salt = hashes[order], numbers[order], np.where(pieces > 1, salt + 1, 0)[order]
        low = low_bits(hashes, bits)
        for s in np.unique(salt):
            mine = np.flatnonzero(salt == s)
            sub = np.argsort(hashes[mine], kind="stable")
            mine = mine[sub]
            for bucket, part in slices(hashes[mine], bits):
                yield bucket, int(s), low[mine[part]].tobytes(), numbers[mine[part]].tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of, parts, held = known.get(), [], 0
        for hashes, at, numbers in _new_sets(batches, width):
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            rank = order_of.rank(hashes)
            order = np.lexsort((hashes, rank, owner))
            place = np.arange(len(hashes)) - np.repeat(at[:-1], size)
            first = size - (percent * size + 99) // 100 + 1
            take = order[(place < first[owner]) & (rank[order] > 0)]
            parts.append((hashes[take], numbers[owner[take]], rank[take]))
            held += len(take)
            if held >= FLUSH // 2:
                yield rows_batch(flush(parts), _POSTED)
                parts, held = [], 0
        if held:
            yield rows_batch(flush(parts), _POSTED)

    return task


def _stars(table: pa.Table) -> pa.Table:
    """Per bucket: edges that join the sets of each list, at most one a set and two a list.

    A list that is dealt out gets a node of its own, which its smallest set in every part is joined with.
    """
    bucket, salt = table.column("bucket")[0].as_py(), table.column("salt")[0].as_py()
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()])
    sets = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("set").to_pylist()])
    order = np.lexsort((sets, low))
    low, sets = low[order], sets[order]
    at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    hub = np.repeat(sets[at], np.diff(np.append(at, len(low))))
    apart = sets != hub
    node, hub = stars(sets[apart], hub[apart])
    if salt:
        node, hub = np.append(node, sets[at]), np.append(hub, mix((np.uint64(bucket) << np.uint64(32)) + low[at].astype(np.uint64)).view(np.int64))
    return pa.table({"node": pa.array(node), "hub": pa.array(hub)})


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of each set (its smallest number), linking at ``percent`` similarity."""
    count = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), size)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    length = np.diff(np.append(first, len(tokens)))
    shared = length > 1
    terms, first, length = tokens[first[shared]], first[shared], length[shared]
    component, open_sets = np.arange(count), np.ones(count, bool)
    for seed in range(count):
        if not open_sets[seed]:
            continue
        open_sets[seed] = False
        queue = [seed]
        while queue:
            query = queue.pop()
            near = _neighbours(query, sets[query], size, owner, terms, first, length, open_sets, percent)
            open_sets[near] = False
            component[near] = seed
            queue.extend(near.tolist())
    return component


def _neighbours(query: int, own: np.ndarray, size: np.ndarray, owner: np.ndarray, terms: np.ndarray, first: np.ndarray, length: np.ndarray, open_sets: np.ndarray, percent: int) -> np.ndarray:
    """Open sets that link with the query, by DivideSkip."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not open_sets.any():
        return none
    at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
    at = at[terms[at] == own]
    needed = -(-percent * len(own) // 100)
    if len(at) < needed:
        return none
    at = at[np.argsort(length[at], kind="stable")]
    longest = int(length[at[-1]])
    n_long = min(needed - 1, int(needed / (0.5 * log2(max(2, longest)) + 1)))
    short, long = at[: len(at) - n_long], at[len(at) - n_long :]
    lists = [owner[first[k] : first[k] + length[k]] for k in short]
    seen = np.bincount(np.concatenate(lists), minlength=len(size))
    found = np.flatnonzero(open_sets & (seen >= needed - n_long) & (size * 100 >= percent * len(own)) & (len(own) * 100 >= percent * size))
    overlap = seen[found]
    for k in long:
        part = owner[first[k] : first[k] + length[k]]
        place = np.minimum(np.searchsorted(part, found), len(part) - 1)
        overlap = overlap + (part[place] == found)
    return found[overlap * (100 + percent) >= percent * (len(own) + size[found])]


def _joined(percent: int):
    """Per group of units: (node, hub) links inside each unit."""

    def task(table: pa.Table) -> pa.Table:
        unit = table.column("unit").to_numpy()
        number = table.column("set").to_numpy()
        raw = table.column("members")
        order = np.lexsort((number, unit))
        nodes, hubs = [], []
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(unit[order]) != 0)))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            mine = order[a:b]
            # Blocks that meet themselves bring a set twice.
            mine = mine[np.concatenate(([True], number[mine][1:] != number[mine][:-1]))]
            if len(mine) > 1:
                component = linked([np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in mine], percent)
                moved = np.flatnonzero(component != np.arange(len(mine)))
                nodes.append(number[mine[moved]])
                hubs.append(number[mine[component[moved]]])
        empty = np.zeros(0, np.int64)
        return pa.table({"node": pa.array(np.concatenate(nodes) if nodes else empty), "hub": pa.array(np.concatenate(hubs) if hubs else empty)})

    return task


def _members(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                out = []
                for _, _, raw, offsets in text_groups(batch.column(2)):
                    hashes, at = text_sets(raw, offsets, width)
                    out.extend(hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["set", "units", "members"])

    return task


def families(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component): sets that share a prefix shingle, directly or in a chain."""
    bits, filter_bits = bucket_bits(texts, "text")
    filter_bits = min(1 << 28, 4 * filter_bits)
    counted = arrow_map(texts, _shingle_counts(width, bits), "bucket long, low binary, count binary")
    known = Frequencies(bits, filter_bits)
    # Size bound: 32 MB and FREQUENT_CELLS, whatever the corpus.
    for row in counted.groupBy("bucket").applyInArrow(_frequencies(bits, filter_bits), "bucket long, part binary, often binary").toLocalIterator():
        known.put(row.bucket, row.part, row.often)
    posted = arrow_map(texts, _postings(width, percent, bits, Shared(texts.sparkSession, known)), "bucket long, salt long, low binary, set binary")
    return components(posted.groupBy("bucket", "salt").applyInArrow(_stars, "node long, hub long"))


def links(texts: DataFrame, sets: DataFrame, width: int, percent: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(node, hub): links between different sets, at least a spanning tree of each component."""
    one = sets.where("n > 0").groupBy("set").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    family = families(texts, width, percent)
    placed = cut(one.join(family, one["set"] == family["node"]).select("set", "key", "n", F.col("component").alias("family")))
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    spread = cut(placed.join(sizes, "family"))
    deals = F.transform(F.sequence(F.lit(1), F.lit(DEALS)), lambda k: F.xxhash64(F.lit("deal"), "family", k, F.pmod(F.xxhash64("set", k), F.ceil(F.col("sets") / block_sets))))
    units = F.when(F.col("sets") > block_sets, deals).otherwise(F.array("family"))
    found = _searched(texts, spread.select(F.col("key").alias("_key"), "set", units.alias("units")), width, percent)
    large = spread.where(F.col("sets") > block_sets)
    if large.isEmpty():
        return found
    rest = cut(_unmet(large, components(found), percent, block_sets))
    return found if rest.isEmpty() else found.unionByName(_searched(texts, rest, width, percent))


def _unmet(large: DataFrame, joined: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """(_key, set, units) of the sets of large families that may link with another component's."""
    known = large.join(joined, large["set"] == joined["node"], "left").select("set", "key", "n", "family", F.coalesce("component", "set").alias("component"))
    # Sizes of linked sets differ by one band at most; the margin is for rounding.
    band = F.floor(F.log("n") / (1.001 * -log(percent / 100))) if percent < 100 else F.col("n")
    known = cut(known.withColumn("band", band.cast("long")))
    whole = known.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= block_sets).select("family", "component", F.col("component").alias("own"))
    owned = known.join(whole, ["family", "component"], "left").withColumn("part", F.xxhash64("family", F.col("own").isNull(), F.coalesce("own", F.lit(0)), "band"))
    parts = owned.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("blocks"))
    block = F.xxhash64("part", F.pmod(F.xxhash64("set", F.lit("block")), F.col("blocks")))
    dealt = cut(owned.join(parts, "part").select("set", "key", "family", "own", "band", block.alias("block")))
    one = cut(dealt.groupBy("block").agg(*[F.first(c).alias(c) for c in ("family", "own", "band")]))
    other = one.select(F.col("block").alias("other"), F.col("family").alias("_family"), F.col("own").alias("_own"), F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("_band"))
    # Sets of one component have met already; those of none in particular may not have.
    meet = (F.col("family") == F.col("_family")) & (F.col("band") == F.col("_band")) & ~F.coalesce(F.col("own") == F.col("_own"), F.lit(False))
    pairs = one.join(other, meet).select("block", F.xxhash64(F.lit("unit"), F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    units = pairs.groupBy("block").agg(F.collect_list("unit").alias("units"))
    return dealt.join(units, "block").select(F.col("key").alias("_key"), "set", "units")


def _searched(texts: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, hub): links inside each unit of ``wanted``, (_key, set, units)."""
    wanted = cut(wanted)
    # A task holds one large unit or about as many sets in small ones.
    tasks = max(256, ceil((wanted.agg(F.sum(F.size("units"))).first()[0] or 0) / UNIT_SETS))
    held = Shared(texts.sparkSession, bloom(wanted, "_key", KEY_BITS))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.get()
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(maybe_in(known, keys)))

    few = arrow_map(texts, near, f"id {texts.schema['id'].dataType.simpleString()}, key long, text string")
    chosen = few.join(wanted, few["key"] == wanted["_key"]).select("set", "units", "text")
    members = arrow_map(chosen, _members(width), "set long, units array<bigint>, members binary")
    rows = members.select("set", F.explode("units").alias("unit"), "members").withColumn("task", F.pmod("unit", F.lit(tasks)))
    # Written once: components() reads the links from both ends.
    return cut(rows.groupBy("task").applyInArrow(_joined(percent), "node long, hub long"))


def similar(df: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_shingles, component_id) of every row; ``key`` names it by identifier and text."""
    texts = keyed(df, id_col, text_col)
    sets = cut(sets_of(texts, width))
    joined = components(links(texts, sets, width, percent))
    lowest = sets.where("n > 0").groupBy("set").agg(F.min("id").alias("first"))
    labelled = lowest.join(joined, lowest["set"] == joined["node"], "left").select("set", "first", F.coalesce("component", "set").alias("component"))
    labelled = cut(labelled)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = labelled.join(least, "component").select(F.col("set").alias("_set"), "component_id")
    out = sets.join(classes, (sets["set"] == classes["_set"]) & (sets["n"] > 0), "left")
    return out.select("id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def representatives(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` per component: that with its smallest identifier.

    Rows without words are no copies of each other and stay, as do rows without
    an identifier.  Of rows equal in identifier and text one stays.
    """
    found = cut(similar(df, width, percent, id_col, text_col))
    own = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    key, left, many = free(df, "_key", "_gone", "_many")
    gone = found.where(F.col("id").isNotNull() & (F.col("id") != F.col("component_id"))).select(F.col("key").alias(left)).distinct()
    repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("key").alias(many))
    kept = df.withColumn(key, own).join(gone, F.col(key) == F.col(left), "left_anti").join(repeated, F.col(key) == F.col(many), "left")
    single = kept.where(F.col(many).isNull()).select(*df.columns)
    return single.unionByName(kept.where(F.col(many).isNotNull()).dropDuplicates([key]).select(*df.columns))
