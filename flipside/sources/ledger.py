"""Sinks: result tables, and ledgers in which every ticket owns its own partition.

A ledger keeps every block a ticket has written as a version of its own. A commit record, written after
the block, names the version that counts: a run that breaks off in between leaves the earlier block in
force. Superseded versions stay where they are until the folder is cleaned up. Decisions are recorded
before held-out rows are scored, and a ticket keeps the first one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.operators.splits import FrozenDecision, SplitError
from flipside.sources.corpus import CSV_OPTIONS

PREDICTIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("y_true", T.IntegerType()),
        T.StructField("y_pred", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("ticket", T.StringType()),
    ]
)

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("ticket", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dev_f1_target_1", T.DoubleType()),
        T.StructField("heldout_f1_target_1", T.DoubleType()),
        T.StructField("heldout_accuracy", T.DoubleType()),
        T.StructField("fixed_fp", T.LongType()),
        T.StructField("fixed_fn", T.LongType()),
        T.StructField("new_fp", T.LongType()),
        T.StructField("new_fn", T.LongType()),
        T.StructField("decision", T.StringType()),
        T.StructField("decision_reason", T.StringType()),
    ]
)


def write_table(frame: DataFrame, path: str) -> None:
    """Overwrite a result table; a path ending in .csv becomes a folder of CSV files."""
    if path.rstrip("/").endswith(".csv"):
        frame.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    else:
        frame.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    return spark.read.schema(schema).parquet(path)


COMMITS = "ticket string, version string, number bigint"
DECISIONS = "ticket string, model_name string, decision string, reason string, threshold double"


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger's own records, none if nothing has been recorded yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_version(block: DataFrame, path: str, ticket: str) -> str:
    """Write a block of ``ticket`` beside its earlier ones; it does not count until it is committed."""
    strange = F.when(~F.col("ticket").eqNullSafe(F.lit(ticket)), F.raise_error(F.lit("a row of another ticket")))
    rows = block.filter(F.coalesce(strange.cast("boolean"), F.lit(True)))
    version = uuid.uuid4().hex
    rows.drop("ticket").write.parquet(f"{path}/ticket={ticket}/version={version}")
    return version


def commit_version(spark: SparkSession, path: str, ticket: str, version: str) -> None:
    """Make a written version the one that counts."""
    commits = _records(spark, f"{path}/_commits", COMMITS).filter(F.col("ticket") == ticket)
    number = commits.agg(F.coalesce(F.max("number"), F.lit(0)) + 1).first()[0]
    record = spark.createDataFrame([(ticket, version, number)], COMMITS)
    record.coalesce(1).write.mode("append").parquet(f"{path}/_commits")


def replace_in_ledger(block: DataFrame, path: str, ticket: str) -> None:
    """Replace whatever ``ticket`` wrote before by ``block``, which may be empty.

    Other tickets' rows are neither read nor rewritten. Rows of other tickets in the block are refused.
    """
    commit_version(block.sparkSession, path, ticket, write_version(block, path, ticket))


def record_decision(spark: SparkSession, path: str, frozen: FrozenDecision) -> FrozenDecision:
    """Write down a ticket's decision before held-out rows are scored for it.

    The same decision may be recorded again, for a re-run; another one for the same ticket is refused.
    """
    known = _records(spark, f"{path}/_decisions", DECISIONS).filter(F.col("ticket") == frozen.ticket).collect()
    for row in known:
        if (row.model_name, row.decision, row.threshold) != (frozen.model_name, frozen.decision, frozen.threshold):
            raise SplitError(f"{frozen.ticket} was frozen as {row.decision} of {row.model_name}; held-out rows are scored once")
    if not known:
        row = (frozen.ticket, frozen.model_name, frozen.decision, frozen.reason, frozen.threshold)
        spark.createDataFrame([row], DECISIONS).coalesce(1).write.mode("append").parquet(f"{path}/_decisions")
    return frozen


def stored_metric(table: DataFrame, metric: str, **where: object) -> DataFrame:
    """One row with the stored ``metric`` of the only row of a result table that meets ``where``."""
    for column, value in where.items():
        table = table.filter(F.col(column) == F.lit(value))
    single = F.when(F.count("*") != 1, F.raise_error(F.lit(f"not one row for {where}")))
    return table.agg(F.coalesce(single.cast("double"), F.max(metric)).alias(metric))


def read_ledger(
    spark: SparkSession, path: str, schema: T.StructType, ticket: str | None = None
) -> DataFrame:
    versioned = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
    ledger = spark.read.schema(versioned).parquet(path)
    current = _records(spark, f"{path}/_commits", COMMITS).groupBy("ticket").agg(F.max_by("version", "number").alias("version"))
    rows = ledger if ticket is None else ledger.filter(F.col("ticket") == ticket)
    # One row per ticket.
    return rows.join(F.broadcast(current), ["ticket", "version"], "left_semi").select(*schema.names)


def ledger_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """How far today's predictions are from the stored block: changed, and present on one side
    only. Both frames hold ``id`` and ``y_pred``."""
    both = stored.select("id", F.col("y_pred").alias("was")).join(
        current.select("id", F.col("y_pred").alias("now")), "id", "full"
    )
    return both.agg(
        F.count_if(F.col("was") == F.col("now")).alias("n_same"),
        F.count_if(F.col("was") != F.col("now")).alias("n_changed"),
        F.count_if(F.col("now").isNull()).alias("n_only_stored"),
        F.count_if(F.col("was").isNull()).alias("n_only_current"),
    )
