"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "flipside", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir, which every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Cuts the lineage with a copy that outlives any executor and tells the optimizer the table's
    real size.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(rows: DataFrame, scan: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out to all cores by ``keys`` if the scan they come from has fewer partitions.

    Text work is bound by the processor, and a small file may be a single partition. A scan that
    already keeps the cluster busy is left as it is, so large inputs are never shuffled for this.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, *keys)
