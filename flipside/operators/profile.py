"""How common each surface feature is and how it goes with the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.surface import LENGTH_EDGES, length_bin, length_labels, surface_flags


def _rate(positives: Column, n: Column) -> Column:
    return F.when(n > 0, positives / n)


def surface_profile(corpus: DataFrame, edges: Sequence[int] = LENGTH_EDGES) -> DataFrame:
    """One row per (feature, group): n, share of all rows, positive rate, lift over the overall
    rate. Groups nobody falls into keep their row, with NULL rates.

    All counts come from a single aggregation over one scan; only its one result row is unfolded.
    """
    flags = surface_flags(F.col("text"))
    features = corpus.select(
        F.col("target").cast("bigint").alias("target"),
        F.length("text").alias("char_len"),
        *[flag.alias(name) for name, flag in flags.items()],
    ).withColumn("bin", length_bin(F.col("char_len"), edges))

    groups = [("overall", "all", F.lit(True))]
    for name in flags:
        groups += [(name, "present", F.col(name)), (name, "absent", ~F.col(name))]
    groups += [("char_len_bin", label, F.col("bin") == label) for label in length_labels(edges)]

    sums = []
    for i, (_, _, inside) in enumerate(groups):
        sums.append(F.count_if(inside).alias(f"n_{i}"))
        sums.append(F.coalesce(F.sum(F.when(inside, F.col("target"))), F.lit(0)).alias(f"pos_{i}"))
    counted = features.agg(*sums)

    unfolded = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(feature).alias("feature"),
                        F.lit(group).alias("group"),
                        F.col(f"n_{i}").alias("n"),
                        F.col(f"pos_{i}").alias("positives"),
                        F.col("n_0").alias("n_total"),
                        F.col("pos_0").alias("positives_total"),
                    )
                    for i, (feature, group, _) in enumerate(groups)
                ]
            )
        )
    )
    rate = _rate(F.col("positives"), F.col("n"))
    overall = _rate(F.col("positives_total"), F.col("n_total"))
    return unfolded.select(
        "feature",
        "group",
        "n",
        F.round(_rate(100.0 * F.col("n"), F.col("n_total")), 2).alias("pct_of_total"),
        F.round(rate, 4).alias("pos_rate"),
        F.round(rate - overall, 4).alias("pos_rate_vs_overall"),
    )


def surface_contrast(profile: DataFrame) -> DataFrame:
    """Positive rate with the feature minus the rate without it."""
    flags = profile.filter(F.col("group").isin("present", "absent"))
    rates = flags.groupBy("feature").agg(
        F.max(F.when(F.col("group") == "present", F.col("pos_rate"))).alias("present_rate"),
        F.max(F.when(F.col("group") == "absent", F.col("pos_rate"))).alias("absent_rate"),
    )
    return rates.withColumn("contrast", F.round(F.col("present_rate") - F.col("absent_rate"), 4))
