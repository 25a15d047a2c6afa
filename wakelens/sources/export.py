"""Dataset export: metadata tables that a manifest, written last, commits."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import iso_utc
from ..operators.manifest import fingerprint

CSV = {"header": True, "quoteAll": True, "escape": '"', "multiLine": True, "nullValue": "\\N", "emptyValue": "", "compression": "gzip", "zlib.compress.level": "FOUR"}
MANIFEST = "name string, rows long, fingerprint string, fields array<string>"


def metadata_rows(rows: DataFrame, fields: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """The fields, by name or made of the rows, as strings; times in UTC with a ``Z``."""
    made = rows.select(*[c.alias(f) for f, c in fields.items()]) if isinstance(fields, Mapping) else rows.select(*fields)
    kinds = dict(made.dtypes)

    def shown(name: str) -> Column:
        return iso_utc(F.col(name)) if kinds[name] in ("timestamp", "timestamp_ntz") else F.col(name).cast("string")

    return made.select(*[shown(f).alias(f) for f in made.columns])


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """Within, shuffles leave the disk when their query ends and their tasks sort in memory.

    Without the first, files stay until the driver collects garbage.  16 MB are
    some million narrow rows; up to 200 partitions Spark deals out unsorted.
    """
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    most = max(200, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(parts, None) or 0))
    held = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        parts: str(most),
    }
    before = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_export(
    tables: Mapping[str, tuple[DataFrame, Sequence[str] | Mapping[str, Column], Sequence[str | Column]]], folder: str, run: str | None = None
) -> str:
    """Write ``{name: (rows, fields, order)}`` as CSV tables; returns the run.

    Every run has a folder of its own.  Its manifest, a single file with row
    count and digest of each table as read back, is written last; a run
    without one was not finished and no reader sees it.  A run that exists is
    never written again.

    Fields and order may be columns made of the rows: these are made behind the
    shuffle, which then carries only what they are made of.
    """
    run = run or f"{time.time_ns():020d}"
    facts = []
    for name, (rows, fields, order) in tables.items():
        path = f"{folder}/run={run}/{name}"
        keys = {f"_order{i}": o for i, o in enumerate(order) if isinstance(o, Column)}
        sorts = [f"_order{i}" if isinstance(o, Column) else o for i, o in enumerate(order)]
        placed = rows.repartitionByRange(*order).withColumns(keys).sortWithinPartitions(*sorts)
        with _writing(rows.sparkSession):
            metadata_rows(placed, fields).write.mode("errorifexists").options(**CSV).csv(path)
        back = _table(rows.sparkSession, path, list(fields))
        facts.append(fingerprint(back, name).select(F.lit(name).alias("name"), "rows", "fingerprint", F.array(*map(F.lit, fields)).alias("fields")))
    manifest = reduce(DataFrame.unionByName, facts)
    with _writing(manifest.sparkSession):
        manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/run={run}/manifest")
    return run


def _table(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{f}` string" for f in fields)).options(**CSV).csv(path)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of the last finished run: a handful of rows with ``run``."""
    runs = spark.read.schema(MANIFEST + ", run string").option("basePath", folder).json(f"{folder}/run=*/manifest")
    last = runs.agg(F.max("run").alias("run"))
    return runs.join(last, "run")


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last finished run by name."""
    listed = read_manifest(spark, folder).collect()
    return {row.name: _table(spark, f"{folder}/run={row.run}/{row.name}", row.fields) for row in listed}


def check_export(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and digest of each table now, and whether they are the manifest's."""
    manifest = read_manifest(spark, folder)
    now = [fingerprint(rows, name).select(F.lit(name).alias("name"), F.col("rows").alias("_rows"), F.col("fingerprint").alias("_print")) for name, rows in read_export(spark, folder).items()]
    both = manifest.join(reduce(DataFrame.unionByName, now), "name")
    intact = (F.col("rows") == F.col("_rows")) & (F.col("fingerprint") == F.col("_print"))
    return both.select("name", F.size("fields").alias("columns"), F.col("_rows").alias("rows"), F.col("_print").alias("fingerprint"), intact.alias("intact"))
