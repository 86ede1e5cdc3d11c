"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.operators.joins import fits_broadcast
from flipside.session import materialize

# Text handed to numpy at once.
SLICE_BYTES = 4 << 20
# Number of a written row, apart from any id.
ROW = "__row"
OWN_ROW = "__row of the table"
# A number holds the file above this bit and the row in the file below.
ROW_BITS = 40


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def id_text(doc_id: Column) -> Column:
    """The id as text, empty for a null id."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    return (F.crc32(id_text(doc_id)) % folds).cast("int")


def texts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: Column) -> DataFrame:
    """``(id, text)`` with null texts empty, and ``more``; every column of another name is left out."""
    return documents.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        *more,
    )


def byte_slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose ``column`` holds about ``budget`` bytes or one row."""
    start, held = 0, 0
    for row, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > budget:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_strings(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Hand what a Python worker has freed back to the system; a later stage may reuse the worker."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def give_back() -> None:
    gc.collect()
    trim()


def lean_group(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, which gives back what it used."""

    def run(table: pa.Table) -> pa.Table:
        result = function(table)
        trim()
        return result

    return run


def lean(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function of a task, which starts and ends by giving back unused memory."""

    def run(batches: Batches) -> Batches:
        give_back()
        yield from function(batches)
        give_back()

    return run


class Memo(dict):
    """A function's results by argument, emptied by ``trim`` when they number more than ``limit``."""

    def __init__(self, function: Callable[[Any], Any], limit: int = 600_000):
        super().__init__()
        self.function = function
        self.limit = limit

    def __missing__(self, key: Any) -> Any:
        value = self[key] = self.function(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def total_bytes(rows: DataFrame, column: str = "text") -> int:
    size = F.octet_length(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own in the column ``ROW``, the same each time they are read.

    Rows of a plain scan of files keep their place: the number of the file, then that of the row in it.
    All others are written first. A column that is called ``ROW`` itself moves to ``OWN_ROW``.
    """
    if ROW in rows.columns:
        rows = rows.withColumnRenamed(ROW, OWN_ROW)
    if rows._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return materialize(rows.withColumn(ROW, F.monotonically_increasing_id()), name)
    placed = rows.withColumns({"__file": F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    # One row per file; the driver plans by the same list.
    number = F.row_number().over(W.orderBy("__file")).cast("bigint")
    files = materialize(placed.select("__file").distinct().withColumn("__number", number), f"{name}-files")
    joined = placed.join(F.broadcast(files) if fits_broadcast(files) else files, "__file")
    return joined.withColumn(ROW, F.shiftleft("__number", ROW_BITS) + F.col(ROW)).drop("__file", "__number")


def unnumbered(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbered rows under the ``columns`` they came with."""
    return rows.select(*[F.col(OWN_ROW).alias(ROW) if name == ROW else F.col(name) for name in columns])


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered rows whose number is not in ``gone``, a written table with the column ``ROW``.

    The numbers are narrow: as long as they are measured to fit, they go to the rows, and no text is
    shuffled.
    """
    gone = gone.select(ROW)
    return rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, ROW, "left_anti")


def surplus_rows(members: DataFrame) -> DataFrame:
    """The numbers of all rows but one of each group, ``members (ROW, id, keep_id, group)``.

    The row that stays has the id its group keeps, null if all ids are null, and of such rows the
    smallest number.
    """
    best = members.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    stays = best.groupBy("group").agg(F.min(ROW).alias(ROW))
    return members.select(ROW).join(stays.select(ROW), ROW, "left_anti")


def pieces_for(total: int, target: int) -> int:
    """How many pieces of about ``target`` a whole of ``total`` makes; at least one."""
    return max(1, -(-total // target))
