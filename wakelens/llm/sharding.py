"""Shards by sampled splitters (operator 6), with DataFrame functions only.

Rows are ordered by the hash of their text, so copies are neighbours.  A sample
of keys, drawn with a chance in proportion to the size, gives quantile splitters
for many small ranges; a text whose copies overfill a range, in bytes or in
rows, is subdivided by the hash of the identifier.  Sizes of the small cells are
summed over all rows, and a row's place on the line of all bytes decides its
shard, so that shards are equal in bytes up to a document or a small group.

Groups of equal texts stay in one shard as long as one has room for them: those
that hold more than ``group_share`` of a shard, at most ``shards / group_share``
of them, and those that overfill a range are placed first, the largest into the
emptiest shard; the line of all others fills what room is left.  Only a group
that fits into no shard is cut.

Defined cases: a null text is an empty one (16 bytes, checksum 0); ties are
ordered by identifier and checksum; rows equal in all of that get adjoining
slots, unless they overfill a range by themselves: then a written salt
subdivides them; with fewer rows than shards some shards are empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from heapq import heapify, heapreplace
from itertools import accumulate
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ROW_BYTES = 16


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, size, text_crc32) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def roomy_shards(groups: list[tuple[int, int]], shards: int, room: int) -> tuple[dict[int, int], list[int]]:
    """Whole groups (key, bytes), largest first, into the emptiest shard that has room; loads by shard."""
    loads, placed = [(0, s) for s in range(shards)], {}
    heapify(loads)
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, shard = loads[0]
        if load + size <= room:
            placed[key] = shard
            heapreplace(loads, (load + size, shard))
    return placed, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def splitters(rows: DataFrame, ranges: int, total: int, per_range: int = 64) -> list[int]:
    """Quantiles of a size-weighted sample of about ``ranges * per_range`` keys."""
    chance = F.col("size") * (ranges * per_range / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("id", "key", F.lit("draw")), F.lit(1 << 30)) < chance * (1 << 30))
    found = drawn.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] if ranges > 1 else None
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of splitters at or below the key: a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, isqrt(len(bounds)))
    longs = lambda values: F.expr("array(" + ",".join("bigint('%d')" % v for v in values) + ")")
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= key))
    fine = F.filter(F.get(F.array(*[longs(b) for b in blocks]), coarse - 1), lambda x: x <= key)
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(fine))


def assign(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", group_share: float = 0.02, rows_per_range: int = 500_000) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row's shard and its place there."""
    rows = cut(sized(df, id_col, text_col).withColumn("salt", F.monotonically_increasing_id()))
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    ranges = max(8 * shards, ceil(n / rows_per_range))
    target, many, room = max(1, total // ranges), max(1, ceil(n / ranges)), ceil(total / shards)
    # At most twice ``ranges`` texts can hold more than a range's share of bytes or rows.
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    full = (F.col("bytes") > target) | (F.col("n") > many)
    pieces = F.greatest(F.ceil(F.col("bytes") / target), F.ceil(F.col("n") / many))
    large = cut(groups.where(full | (F.col("bytes") > group_share * total / shards)).select("key", "bytes", F.when(full, pieces).alias("pieces")))
    kept = large.where(F.col("bytes") <= room).select("key", "bytes").collect()
    fixed, loads = roomy_shards([(r["key"], r["bytes"]) for r in kept], shards, room)
    known = df.sparkSession.createDataFrame(list(fixed.items()), "key long, fixed int")
    hot = large.join(F.broadcast(known), "key", "left").select("key", "pieces", "fixed")
    # Identifiers that overfill a range by themselves: again at most ``ranges``.
    same_id = rows.join(F.broadcast(hot.where(F.col("pieces").isNotNull())), "key", "left_semi").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    heavy = cut(same_id.where(F.col("n") > many).select(F.col("key").alias("_key"), F.col("id").alias("_id"), F.lit(True).alias("heavy")))
    spread = F.xxhash64("id", F.lit("piece"), F.when(F.col("heavy"), F.col("salt")))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(spread, F.col("pieces"))).otherwise(F.lit(-1))
    cells = rows.join(F.broadcast(hot), "key", "left").join(F.broadcast(heavy), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", "key", "size", "text_crc32", "fixed",
        range_of(F.col("key"), splitters(rows, ranges, total)).alias("range"),
        F.when(F.col("pieces").isNotNull(), F.col("key")).alias("hot"),
        piece.alias("piece"),
    )
    place = ["range", "hot", "piece"]
    # One row a cell: at most three times the number of ranges.
    sums = cells.groupBy(*place).agg(F.sum(F.when(F.col("fixed").isNull(), F.col("size")).otherwise(0)).alias("bytes"))
    line = Window.orderBy("range", F.col("hot").asc_nulls_first(), "piece")
    before = sums.select(*[F.col(c).alias(f"_{c}") for c in place], (F.sum("bytes").over(line.rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    cells = cells.join(F.broadcast(before), same).select(*cells.columns, F.coalesce("before", F.lit(0)).alias("before"))
    cell = Window.partitionBy(*place)
    order = ["key", "id", "text_crc32"]
    copies = Window.partitionBy(*place, "key")
    loose = F.when(F.col("fixed").isNull(), F.col("size")).otherwise(0)
    running = cells.withColumn("end", F.col("before") + F.sum(loose).over(cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    grouped = running.withColumn("first", F.min(F.col("end") - F.col("size")).over(copies)).withColumn("whole", F.sum("size").over(copies))
    small = F.col("hot").isNull() & (F.col("whole") <= group_share * total / shards)
    middle = F.when(small, F.col("first") + F.col("whole") / 2).otherwise(F.col("end") - F.col("size") / 2)
    left = list(accumulate(room - load for load in loads))
    shard = F.coalesce("fixed", F.least(F.lit(shards - 1), range_of(F.floor(middle), left[:-1]))).cast("int")
    placed = cut(grouped.select(*order, "size", *place, shard.alias("shard")))
    counts = placed.groupBy("shard", *place).agg(F.count(F.lit(1)).alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("range", F.col("hot").asc_nulls_first(), "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in ["shard", *place]], F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("offset"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ["shard", *place]]
    joined = placed.join(F.broadcast(offsets), same).select(*placed.columns, "offset")
    slot = F.col("offset") + F.row_number().over(Window.partitionBy(*place, "shard").orderBy(*order)) - 1
    return joined.select("id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of ``df`` below ``path``, one folder per shard, in slot order.

    Identifiers must be unique here, since rows are found by them.
    """
    both = df.join(assigned.select(F.col("id").alias(id_col), "shard", "slot"), id_col)
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
