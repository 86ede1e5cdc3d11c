"""Repeated lines, found by levelled, sorted runs of line hashes.

A batch of documents becomes one run: a table of ``(hash, n, keep)``, one row per line key, bucketed
and sorted by the hash. ``n`` counts the documents that hold the line, ``keep`` is the best of their
ids. Each new batch is merge-joined with the runs there are, without moving them: hashes that a run
has already settled (found in enough documents) are anti-joined away, since the line is known to be
dropped from this batch; all others are added as the batch's own run on level 0. When a level holds
``FANOUT`` runs they are compacted into one run of the next level, so that a hash is rewritten once
per level and a batch meets fewer than ``FANOUT`` runs on each. At the end one merge of the live runs
sums the counts that several runs share.

Batches come in the order of preference: what the first batch with a line keeps is what stays. The
whole table is cut into batches by descending id, so the largest id holding a line keeps it.

A line's key is the line without ASCII white space at both ends, A-Z in lower case; only keys of at
least ``min_length`` code points are considered. A document is a row: rows that share an id count
apart, and all rows with the id that keeps a line keep it.

Edge cases: a null or empty text is one empty line; null ids come last, and a line that only rows
without id hold is kept by all of them; a line that repeats inside a document counts once for it, and
stays or goes in all its places; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.llm.common import ROW, numbered, texts
from flipside.operators.joins import lookup_join
from flipside.session import materialize, scratch_path

BLANK = " \t\n\x0b\x0c\r"
BATCHES = 8
FANOUT = 4
# Line hashes that a bucket of a run should hold.
BUCKET_LINES = 1 << 22
# The ids at which batches are cut are exact to one in so many rows; it moves the borders, not the result.
BORDER_ACCURACY = 1000


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The runs of one store, which are bucketed tables of the session's catalog.

    Batches hold ``(hash, n, keep)`` once per hash. ``buckets`` is fixed for the store's life.
    """

    def __init__(self, spark: SparkSession, min_documents: int, buckets: int, fanout: int = FANOUT):
        self.spark = spark
        self.min_documents = min_documents
        self.buckets = buckets
        self.fanout = fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, records: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        self.written += 1
        dealt = records.repartition(self.buckets, "hash").sortWithinPartitions("hash")
        dealt.write.option("compression", "none").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The batch without the hashes that some run has found in enough documents."""
        for run in self.runs():
            settled = run.filter(F.col("n") >= self.min_documents).select("hash")
            batch = batch.join(settled.hint("merge"), "hash", "left_anti")
        return batch

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row per hash of several runs, oldest run first."""
        whole = runs[0].withColumn("run", F.lit(0))
        for place, run in enumerate(runs[1:], 1):
            whole = whole.unionByName(run.withColumn("run", F.lit(place)))
        # The oldest run that knows the line says who keeps it.
        return whole.groupBy("hash").agg(F.sum("n").alias("n"), F.min_by("keep", "run").alias("keep"))

    def add(self, batch: DataFrame) -> None:
        self._place(self._write(self.unsettled(batch)), 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old = self.levels[level]
            compacted = self._write(self.merged([self.spark.table(run) for run in old]))
            self.levels[level] = []
            self._drop(old)
            self._place(compacted, level + 1)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def repeated(self) -> DataFrame:
        """``(hash, n, keep)`` of the lines in at least ``min_documents`` documents.

        ``n`` stops growing once a run has settled a line, so it is a lower bound.
        """
        # Higher levels are older, and so are earlier runs of a level.
        names = [name for level in reversed(self.levels) for name in level]
        return self.merged([self.spark.table(name) for name in names]).filter(F.col("n") >= self.min_documents)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


@contextmanager
def line_runs(spark: SparkSession, min_documents: int, buckets: int, fanout: int = FANOUT) -> Iterator[LineRuns]:
    """A store whose tables are dropped at the end."""
    store = LineRuns(spark, min_documents, buckets, fanout)
    try:
        yield store
    finally:
        store.close()


def line_hashes(rows: DataFrame, min_length: int) -> DataFrame:
    """Rows ``(ROW, id, lines)``: place and hash of every line whose key is long enough."""
    keys = F.transform(split_lines(F.col("text")), lambda line, place: F.struct(place.alias("place"), line_key(line).alias("key")))
    long = F.filter(keys, lambda line: F.length(line["key"]) >= min_length)
    hashed = F.transform(long, lambda line: F.struct(line["place"].alias("place"), F.unhex(F.md5(line["key"])).alias("hash")))
    return rows.select(ROW, "id", hashed.alias("lines"))


def written_lines(lines: DataFrame) -> DataFrame:
    """The rows as a table with one folder per batch. Hashes do not compress, and a compressor holds
    buffers outside the heap for every column of every folder."""
    path = scratch_path(lines.sparkSession, "line-hashes")
    lines.write.partitionBy("batch").option("compression", "none").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def batch_borders(rows: DataFrame, batches: int) -> list[int]:
    """Descending ids that cut the rows into about equal batches; fewer if ids are few."""
    shares = [1 - place / batches for place in range(1, batches)]
    borders = rows.agg(F.percentile_approx("id", shares, BORDER_ACCURACY)).first()[0] if shares else None
    return sorted(set(borders or []), reverse=True)


def batch_of(id_: Column, borders: list[int]) -> Column:
    """Batch 0 holds the largest ids; rows without id come last."""
    place = F.lit(0)
    for border in borders:
        place = place + (id_ <= border).cast("int")
    return F.coalesce(place, F.lit(len(borders) + 1))


def batch_counts(lines: DataFrame) -> DataFrame:
    """``(hash, n, keep)`` of a batch of rows ``(id, lines)``."""
    held = lines.select("id", F.explode(F.array_distinct(F.transform("lines", lambda line: line["hash"]))).alias("hash"))
    return held.groupBy("hash").agg(F.count("*").alias("n"), F.max("id").alias("keep"))


def repeated_lines(lines: DataFrame, min_documents: int, fanout: int = FANOUT) -> DataFrame:
    """Written table ``(hash, n, keep)`` of the lines in enough of the written rows ``(batch, id, lines)``."""
    spark = lines.sparkSession
    found = lines.groupBy("batch").agg(F.sum(F.size("lines")).alias("n")).collect()
    buckets = max(-(-sum(row.n for row in found) // BUCKET_LINES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    with line_runs(spark, min_documents, buckets, fanout) as store:
        for batch in sorted(row.batch for row in found):
            store.add(batch_counts(lines.filter(F.col("batch") == batch)))
        if not found:
            return spark.createDataFrame([], "hash binary, n bigint, keep bigint")
        return materialize(store.repeated(), "repeated-lines")


def drop_repeated_lines(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_documents: int = 5,
    min_length: int = 40,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row ``(doc_id, text, n_lines, n_dropped)`` per document, repeated lines dropped."""
    rows = texts(numbered(documents, "line-rows"), id_column, text_column, F.col(ROW))
    batch = batch_of(F.col("id"), batch_borders(rows, batches))
    lines = written_lines(line_hashes(rows, min_length).withColumn("batch", batch))
    repeated = repeated_lines(lines, min_documents, fanout)
    held = lines.select(ROW, "id", F.explode("lines").alias("line")).select(ROW, "id", "line.place", "line.hash")
    counts = held.groupBy("hash").agg(F.count("*").alias("n"))
    matched = lookup_join(held, repeated.select("hash", "keep"), ["hash"], counts, F.col(ROW))
    dropped = matched.filter(~F.col("id").eqNullSafe(F.col("keep"))).groupBy(ROW).agg(F.collect_list("place").alias("dropped"))
    dropped = materialize(dropped, "dropped-lines")
    # One row per document on either side.
    joined = lookup_join(rows, dropped, [ROW], dropped.select(ROW, F.lit(1).alias("n")), F.col(ROW), "left")
    parts = split_lines(F.col("text"))
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.size("parts") - 1)
    kept = F.transform(F.array_except(every, gone), lambda place: F.get(F.col("parts"), place))
    return joined.withColumn("parts", parts).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("parts").cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_dropped"),
    )
