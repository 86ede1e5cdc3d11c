"""Terms hashed into a fixed number of buckets, as an option beside the exact vocabulary.

No term is numbered and none is kept: a document's cells are made inside its own row, and what is
learned from train is one idf per bucket, so that its size is known before any text is read. Half of
the terms count with a minus sign, which makes terms that share a bucket cancel on average rather
than add up. ``collisions`` tells which buckets are shared.

Edge cases: a cell whose signed count is 0 is left out; a bucket that no train document fills has
no idf and drops out of other splits, as an unknown term does; a document without tokens has no
cells; an empty corpus gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.terms import let, term_counts
from flipside.operators.features import smooth_idf, train_size
from flipside.session import materialize

# Buckets; documents are weighed by an array of as many doubles.
WIDTH = 1 << 16


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def bucket_of(term: Column, width: int) -> Column:
    """By the first eight hex digits of the term's md5."""
    return hex_number(F.substring(F.md5(term.cast("binary")), 1, 8)) % width


def is_negative(term: Column) -> Column:
    """By the ninth hex digit: odd ones."""
    return hex_number(F.substring(F.md5(term.cast("binary")), 9, 1)) % 2


def hashed_counts(words: Column, width: int = WIDTH) -> Column:
    """array<struct<bucket, tf>> of one document, ``tf`` being the signed count.

    Buckets are coded with their sign as the last bit, so that the two runs of a bucket are neighbours.
    """
    # Nine digits of one md5: eight for the bucket, the last for the sign.
    digits = F.transform(words, lambda word: hex_number(F.substring(F.md5(word.cast("binary")), 1, 9)))
    codes = F.transform(digits, lambda n: F.shiftright(n, 4) % width * 2 + n % 2)
    bucket = lambda run: F.shiftright(run["term"], 1)
    signed = lambda run: F.when(run["term"] % 2 == 1, -run["tf"]).otherwise(run["tf"])

    def cells(runs: Column) -> Column:
        def cell(run: Column, place: Column) -> Column:
            before, after = F.get(runs, place - 1), F.get(runs, place + 1)
            other = F.when(bucket(after) == bucket(run), signed(after)).otherwise(0)
            first = (place == 0) | (bucket(before) != bucket(run))
            return F.when(first, F.struct(bucket(run).alias("bucket"), (signed(run) + other).alias("tf")))

        return F.filter(F.transform(runs, cell), lambda found: found["tf"] != 0)

    return let(term_counts(codes), cells)


def hashed_cells(documents: DataFrame, words: Column, width: int = WIDTH) -> DataFrame:
    """``(id, target, split, cells)`` of every document, written: statistics and weights read it."""
    return materialize(documents.select("id", "target", "split", hashed_counts(words, width).alias("cells")), "cells")


def bucket_idf(cells: DataFrame) -> DataFrame:
    """``(bucket, df, idf)`` of the buckets that train fills, at most as many as there are."""
    filled = cells.filter(F.col("split") == "train").select(F.explode("cells.bucket").alias("bucket"))
    frequencies = filled.groupBy("bucket").agg(F.count("*").alias("df"))
    return frequencies.crossJoin(F.broadcast(train_size(cells))).select(
        "bucket", "df", smooth_idf(F.col("df"), F.col("n_train")).alias("idf")
    )


def hashed_tfidf(cells: DataFrame, idf: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows ``(id, target, split, bucket, tf, weight)`` of unit length per document.

    The idf of all buckets is one value, an array of ``width`` doubles that no row carries, so that a document
    is weighed and normed in its own row and no cell is shuffled.
    """
    every = idf.sparkSession.range(width).select(F.col("id").alias("bucket")).join(idf, "bucket", "left")
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "idf")))
    table = every.agg(F.transform(ordered, lambda entry: entry["idf"]).alias("idfs"))

    def weigh(cell: Column) -> Column:
        value = cell["tf"] * F.get(F.col("idfs"), cell["bucket"].cast("int"))
        return F.struct(cell["bucket"].alias("bucket"), cell["tf"].alias("tf"), value.alias("x"))

    def unit(known: Column) -> Column:
        norm = F.sqrt(F.aggregate(known, F.lit(0.0), lambda total, cell: total + cell["x"] * cell["x"]))
        share = lambda cell, n: F.struct(cell["bucket"].alias("bucket"), cell["tf"].alias("tf"), (cell["x"] / n).alias("weight"))
        return let(norm, lambda n: F.transform(known, lambda cell: share(cell, n)))

    known = F.filter(F.transform("cells", weigh), lambda cell: cell["x"].isNotNull())
    # Weights are made before rows: a norm beside the exploded cells is summed anew for each of them. The outer
    # form: for the inner one Spark derives a filter that weighs every document twice.
    weighed = cells.withColumn("idfs", table.scalar()).select("id", "target", "split", F.inline_outer(let(known, unit)))
    return weighed.filter(F.col("bucket").isNotNull())


def collisions(terms: DataFrame, width: int = WIDTH) -> DataFrame:
    """Buckets that several terms of train share, from the term statistics: ``(bucket, n_terms,
    n_negative, most_df, sum_df)``."""
    term = F.col("term")
    placed = terms.filter(F.col("df") > 0).select(
        bucket_of(term, width).alias("bucket"), is_negative(term).alias("negative"), "df"
    )
    return (
        placed.groupBy("bucket")
        .agg(
            F.count("*").alias("n_terms"),
            F.sum("negative").alias("n_negative"),
            F.max("df").alias("most_df"),
            F.sum("df").alias("sum_df"),
        )
        .filter(F.col("n_terms") > 1)
    )
