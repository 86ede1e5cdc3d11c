"""Places of rows inside their group, however large a group is.

A window over a group sorts all of it in one task. Here the rows are dealt by ranges of (group,
order), so that a large group covers several ranges. Every range numbers its own rows; the ranges
of a group are counted, and the counts before a range are added to the places in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.operators.joins import TARGET_ROWS, lookup_join
from flipside.session import materialize

# monotonically_increasing_id() keeps the partition above this bit and the place in it below.
PLACE_BITS = 33


def dealt_by_range(rows: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """The rows in ranges of about ``target_rows`` of ``keys``, written with ``__range`` and, in order, ``__row``.

    Rows that tie in all keys are numbered first, so that equal rows too fill several ranges.
    """
    written = materialize(rows.withColumn("__tie", F.monotonically_increasing_id()), "ranges-rows")
    ranges = max(1, -(-written.count() // target_rows))
    keys = [*keys, "__tie"]
    dealt = written.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__tie")
    numbered = materialize(dealt.withColumn("__row", F.monotonically_increasing_id()), "ranges")
    return numbered.withColumn("__range", F.shiftright("__row", PLACE_BITS))


def marked(rows: DataFrame, group: Sequence[str]) -> Column:
    """The group as one text; a null, which would not join, has a mark of its own."""
    kinds = dict(rows.dtypes)
    shown = [F.hex(name) if kinds[name] == "binary" else F.col(name).cast("string") for name in group]
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("+"), value), F.lit("-")) for value in shown]))


def with_places(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    place: str = "place",
    size: str = "size",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``place``, from 1 by ``order`` inside the ``group``, and the ``size`` of the group.

    Rows that tie in ``order`` are placed in any order, but each gets a place of its own. A null is
    a value like others, and first in order.
    """
    numbered = dealt_by_range(rows, [*group, *order], target_rows).withColumn("__group", marked(rows, group))
    runs = numbered.groupBy("__range", "__group").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    # A group has one run in each of its ranges.
    before = W.partitionBy("__group").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counted = materialize(
        runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn(size, F.sum("__n").over(W.partitionBy("__group"))),
        "runs",
    )
    key = ["__range", "__group"]
    sizes = counted.select(*key, F.col("__n").alias("n"))
    joined = lookup_join(numbered, counted.drop("__n"), key, sizes, F.col("__row"), source=counted)
    return joined.withColumn(place, F.col("__before") + F.col("__row") - F.col("__first") + 1).select(
        *rows.columns, place, size
    )
