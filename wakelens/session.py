"""Session settings and the scratch folder shared by all executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on.  Joins whose build side is unique per
# key stay correct under AQE's skew split, so it may also add a shuffle for it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text and recipe work is heavy per byte: do not fold small partitions away.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Top-n per group is cut before the shuffle up to this n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wakelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share, removed when the session ends.

    It lies below the checkpoint folder of the context or of
    ``spark.checkpoint.dir``; only where neither is set, below the warehouse.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate"
    folder = f"{root.rstrip('/')}/wakelens-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of too few splits (one small file).

    Inputs with at least as many splits as cores are returned as they are, so
    large tables are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a written table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
