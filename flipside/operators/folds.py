"""Out-of-fold scores: every training row is scored by a model that has not seen its label.

Folds are cut by a hash of the id. Counts are additive, so the Bayes model without a fold is that of
all training rows minus the fold's own counts: all models come from one pass over the terms. Rows
outside train belong to no fold and are scored by the whole model, which is the model without the
empty fold ``NO_FOLD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.operators.joins import lookup_join
from flipside.session import materialize

FOLDS = 5
NO_FOLD = -1


def fold_of(id_: Column, folds: int = FOLDS) -> Column:
    """The fold of an id, from the first 24 bits of a hash."""
    digits = F.substring(F.md5(F.concat(F.lit("fold:"), id_.cast("string"))), 1, 6)
    return (F.conv(digits, 16, 10).cast("bigint") % folds).cast("int")


def with_folds(documents: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add ``fold``: that of the id for rows of train, ``NO_FOLD`` for all others."""
    return documents.withColumn("fold", F.when(F.col("split") == "train", fold_of(F.col("id"), folds)).otherwise(NO_FOLD))


def fold_statistics(tf: DataFrame) -> DataFrame:
    """Written ``(fold, term, n, df, tokens_pos, tokens_neg)`` of term rows with their document's ``fold``.

    ``n`` counts all rows, the rest only those of train, as in ``term_statistics``.
    """
    train = (F.col("split") == "train") & (F.col("tf") > 0)
    tokens = lambda c: F.sum(F.when(train & (F.col("target") == c), F.col("tf")).otherwise(0))
    counted = tf.groupBy("fold", "term").agg(
        F.count("*").alias("n"), F.count_if(train).alias("df"), tokens(1).alias("tokens_pos"), tokens(0).alias("tokens_neg")
    )
    return materialize(counted, "fold-terms")


def complement_log_odds(statistics: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Written ``(fold, term, log_odds)``: smoothed log-odds by all folds but the named one.

    A term that only its own fold holds is unknown to that fold's model and has no row. Terms are
    looked up under the folds that hold them, so a term has at most one row per fold.
    """
    counts = ("df", "tokens_pos", "tokens_neg")
    whole = statistics.groupBy("term").agg(*[F.sum(c).alias(f"all_{c}") for c in counts]).filter("all_df > 0")
    whole = materialize(whole, "all-terms")
    # A term has at most as many rows as there are folds, and one more.
    joined = statistics.join(whole, "term")
    rest = [(F.col(f"all_{c}") - F.col(c)).alias(c) for c in counts]
    # Per fold: its tokens of either class, and the terms that no other fold holds.
    own = joined.groupBy("fold").agg(
        F.sum("tokens_pos").alias("own_pos"), F.sum("tokens_neg").alias("own_neg"), F.count_if(F.col("df") == F.col("all_df")).alias("own_terms")
    )
    totals = whole.agg(
        F.sum("all_tokens_pos").alias("sum_pos"), F.sum("all_tokens_neg").alias("sum_neg"), F.count("*").alias("terms")
    )
    # One row per fold, and a single row.
    sizes = own.crossJoin(F.broadcast(totals)).select(
        "fold",
        (F.col("sum_pos") - F.col("own_pos")).alias("n_pos"),
        (F.col("sum_neg") - F.col("own_neg")).alias("n_neg"),
        (F.col("terms") - F.col("own_terms")).alias("size"),
    )
    known = joined.select("fold", "term", *rest).filter("df > 0").join(F.broadcast(sizes), "fold")
    side = lambda tokens, n: F.ln((F.col(tokens) + alpha) / (F.col(n) + alpha * F.col("size")))
    odds = side("tokens_pos", "n_pos") - side("tokens_neg", "n_neg")
    return materialize(known.select("fold", "term", odds.alias("log_odds")), "fold-odds")


def out_of_fold_join(tf: DataFrame, log_odds: DataFrame, statistics: DataFrame) -> DataFrame:
    """Term rows with the log-odds of their fold's model, null where it does not know the term."""
    counts = statistics.select("fold", "term", "n")
    return lookup_join(tf, log_odds, ["fold", "term"], counts, F.col("id"), "left")
