"""Incremental intake of prediction files and draining of finite streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from ..sources.readers import CORRUPT


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", **options) -> DataFrame:
    """Stream over the files of a folder or glob, with an explicit schema."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def ended(stream: DataFrame, **values) -> DataFrame:
    """A finite stream with one more row, far in the future, that takes the watermark past all others."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    columns = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1, numPartitions=1).select(*columns).write.parquet(path)
    return stream.unionByName(file_stream(spark, path, stream.schema))


def prediction_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return file_stream(spark, path, wide, "json", columnNameOfCorruptRecord=CORRUPT)


def drain(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream until its input is used up and read what it wrote.

    Output and checkpoint live in the shared folder, so the run can resume on
    other executors.  With the ``base`` of an earlier run it goes on where that
    one ended, state and watermark included.
    """
    spark, base = stream.sparkSession, base or shared_folder(stream.sparkSession)
    out = f"{base}/out"
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def route_predictions(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows of a prediction stream with their outcome: success, failed or broken.

    Rows are routed before anything is dropped.  A micro-batch is one write,
    partitioned by outcome, to a folder of its own, so a replayed batch takes the
    place of its first try.  Afterwards the last row of an id wins, across files
    and outcomes; broken lines and rows without an id are all kept.
    """
    spark, base = stream.sparkSession, shared_folder(stream.sparkSession)

    def store(batch: DataFrame, number: int) -> None:
        broken = F.col(CORRUPT).isNotNull() | (F.coalesce(F.col(key), F.lit("")) == "") | ~F.coalesce(F.col("status").isin("success", "failed"), F.lit(False))
        routed = batch.withColumn("outcome", F.when(broken, "broken").otherwise(F.col("status")))
        routed.write.mode("overwrite").partitionBy("outcome").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("outcome", T.StringType())])
    rows = spark.read.schema(schema).parquet(f"{base}/rows")
    sound = rows.where(F.col("outcome") != "broken")
    last = sound.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(ts, "batch", F.col("outcome") == "success")).alias("r")).select("r.*")
    return rows.where(F.col("outcome") == "broken").unionByName(last)
