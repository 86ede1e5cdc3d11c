"""Confusion counts, scores for the positive class, threshold sweeps and picking a winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.rounding import round_half_even

# 0.20 to 0.70 in steps of 0.05.
THRESHOLDS = tuple(k / 100 for k in range(20, 71, 5))


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return predictions.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def prf(counts: DataFrame, keep: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Precision, recall, F1 of class 1 and accuracy from confusion counts, unrounded."""
    return counts.select(
        *keep,
        precision().alias(f"{prefix}precision_target_1"),
        recall().alias(f"{prefix}recall_target_1"),
        f1().alias(f"{prefix}f1_target_1"),
        accuracy().alias(f"{prefix}accuracy"),
    )


def threshold_counts(
    scores: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts for predicting 1 where ``score >= threshold``.

    A score passes the first ``passed`` thresholds, so rows are counted once by that number and
    the counts summed from the top: the cost does not grow with the number of thresholds.
    """
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    y = F.col("y_true") == 1
    counted = scores.groupBy(
        *by, F.size(F.filter(grid, lambda t: F.col("score") >= t)).alias("passed")
    ).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    # At most len(thresholds) + 1 bins per group.
    bins = counted.groupBy(*by).agg(F.collect_list(F.struct("passed", "pos", "neg")).alias("bins"))

    def total(field: str, reached: bool) -> Column:
        chosen = F.filter("bins", lambda b: (b["passed"] > F.col("position")) == F.lit(reached))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, b: n + b[field])

    return bins.select(*by, "bins", F.posexplode(grid).alias("position", "threshold")).select(
        *by,
        "position",
        "threshold",
        total("pos", True).alias("tp"),
        total("neg", True).alias("fp"),
        total("pos", False).alias("fn"),
        total("neg", False).alias("tn"),
    )


def threshold_sweep(
    scores: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    counts = threshold_counts(scores, thresholds, by)
    return prf(counts, (*by, "position", "threshold", "tp", "fp", "fn", "tn"))


def best_row(
    table: DataFrame,
    metric: str,
    position: str = "position",
    by: Sequence[str] = (),
    digits: int | None = 4,
) -> DataFrame:
    """The row with the highest metric, the first by position among equals.

    The choice is made on the metric rounded to four digits, half to even by its exact value, as published
    tables show it; ``digits=None`` compares the exact values.
    """
    value = F.col(metric) if digits is None else round_half_even(F.col(metric), digits)
    best_first = (value.desc(), F.col(position).asc())
    if not by:
        return table.orderBy(*best_first).limit(1)
    order = W.partitionBy(*by).orderBy(*best_first)
    return table.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
