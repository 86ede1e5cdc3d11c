"""Naive Bayes as plain aggregation, and the majority-class floor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.operators.features import vocabulary
from flipside.operators.joins import lookup_join
from flipside.session import materialize


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log_odds(positive: str, negative: str, mass: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """Smoothed log-odds per term from its positive and negative mass."""
    totals = mass.groupBy(*by).agg(
        F.sum(positive).alias("all_pos"), F.sum(negative).alias("all_neg"), F.count("*").alias("size")
    )
    # One row per feature set.
    wide = mass.join(F.broadcast(totals), list(by)) if by else mass.crossJoin(F.broadcast(totals))
    pos = F.ln((F.col(positive) + alpha) / (F.col("all_pos") + alpha * F.col("size")))
    neg = F.ln((F.col(negative) + alpha) / (F.col("all_neg") + alpha * F.col("size")))
    return wide.select(*by, "term", (pos - neg).alias("log_odds"))


def token_log_odds(terms: DataFrame, by: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """Multinomial log-odds per train term, from token counts."""
    return _log_odds("tokens_pos", "tokens_neg", vocabulary(terms), by, alpha)


def mean_log_odds_scores(
    tf: DataFrame, log_odds: DataFrame, terms: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Score each document by the sigmoid of the mean log-odds over its known tokens, no prior.

    The mean keeps long documents away from 0 and 1. ``tf`` needs ``keep_empty=True``: a document
    without known tokens scores 0.5.
    """
    joined = lookup_join(
        tf, log_odds, [*by, "term"], terms.select(*by, "term", "n"), F.col("id"), how="left", source=terms
    )
    return mean_scores(joined, by)


def mean_scores(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The scores from term rows with their ``log_odds``, null for a term the model does not know."""
    known = F.when(F.col("log_odds").isNotNull(), F.col("tf"))
    mean = F.sum(F.col("tf") * F.col("log_odds")) / F.nullif(F.sum(known), F.lit(0))
    scored = joined.groupBy(*by, "id", "target", "split").agg(
        sigmoid(F.coalesce(mean, F.lit(0.0))).alias("score")
    )
    return scored.withColumnRenamed("target", "y_true")


def predict_at(scores: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Add ``y_pred``. Classifiers predict 1 strictly above the threshold, sweeps from it on."""
    hit = F.col("score") > threshold if strict else F.col("score") >= threshold
    return scores.withColumn("y_pred", hit.cast("int"))


def fit_weighted_bayes(weights: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Multinomial log-odds per train term, from TF-IDF weights."""
    train = weights.filter((F.col("split") == "train") & F.col("weight").isNotNull())
    mass = train.groupBy("term").agg(
        F.sum(F.when(F.col("target") == 1, F.col("weight")).otherwise(0.0)).alias("mass_pos"),
        F.sum(F.when(F.col("target") == 0, F.col("weight")).otherwise(0.0)).alias("mass_neg"),
    )
    return materialize(_log_odds("mass_pos", "mass_neg", mass, (), alpha), "bayes")


def weighted_bayes_scores(
    weights: DataFrame, log_odds: DataFrame, terms: DataFrame, documents: DataFrame
) -> DataFrame:
    """Posterior of class 1 under multinomial naive Bayes with the unsmoothed class prior.

    ``weights`` needs ``keep_unknown=True`` over ``keep_empty=True`` counts, so that a document
    without known terms is scored by the prior alone.
    """
    train = documents.filter(F.col("split") == "train")
    prior = train.agg(
        F.ln(F.count_if(F.col("target") == 1) / F.count_if(F.col("target") == 0)).alias("prior")
    )
    evidence = (
        lookup_join(weights, log_odds, ["term"], terms.select("term", "n"), F.col("id"), how="left")
        .groupBy("id", "target", "split")
        .agg(F.coalesce(F.sum(F.col("weight") * F.col("log_odds")), F.lit(0.0)).alias("evidence"))
    )
    return evidence.crossJoin(F.broadcast(prior)).select(
        "id",
        F.col("target").alias("y_true"),
        "split",
        sigmoid(F.col("evidence") + F.col("prior")).alias("score"),
        (F.col("evidence") + F.col("prior") > 0).cast("int").alias("y_pred"),
    )


def top_terms(weights: DataFrame, weight: str, k: int = 15, key: str = "term") -> DataFrame:
    """The k heaviest terms of either side, ranked from 1. Equal weights rank by name."""
    sides = []
    for side, value in (("positive", -F.col(weight)), ("negative", F.col(weight))):
        top = weights.orderBy(value, key).limit(k)
        # The k rows that are left, collected in order and numbered.
        sides.append(
            top.agg(
                F.sort_array(F.collect_list(F.struct(value.alias("o"), F.col(key), F.col(weight)))).alias("t")
            ).select(F.lit(side).alias("side"), F.posexplode("t").alias("rank", "e"))
        )
    both = sides[0].unionByName(sides[1])
    return both.select("side", (F.col("rank") + 1).alias("rank"), f"e.{key}", f"e.{weight}")


def majority_floor(documents: DataFrame) -> DataFrame:
    """Predict train's most frequent class everywhere; the smaller label wins a tie."""
    counts = documents.filter(F.col("split") == "train").agg(
        (F.count_if(F.col("target") == 1) > F.count_if(F.col("target") == 0)).cast("int").alias("y_pred")
    )
    return documents.select("id", F.col("target").alias("y_true"), "split").crossJoin(F.broadcast(counts))


def balanced_weights(documents: DataFrame) -> DataFrame:
    """Train rows with ``class_weight`` n / (2 * n_class), so both classes weigh the same."""
    train = documents.filter(F.col("split") == "train")
    counts = train.groupBy("target").agg(F.count("*").alias("n_class"))
    total = train.agg(F.count("*").alias("n"))
    weights = counts.crossJoin(F.broadcast(total)).select(
        "target", (F.col("n") / (2 * F.col("n_class"))).alias("class_weight")
    )
    # One row per class.
    return train.join(F.broadcast(weights), "target")
