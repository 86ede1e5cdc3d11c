"""Scorers with one interface: split documents and text variants in, written scores out.

Scores have the columns ``variant, id, split, y_true, score, y_pred``. The Bayes scorer is pure
aggregation; the logistic scorer fits one linear model per variant. Both also return the fitted
term statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.operators.bayes import mean_scores, predict_at
from flipside.operators.features import NO_TERM, counted_terms, fit_terms, text_vectors
from flipside.operators.folds import FOLDS, complement_log_odds, fold_statistics, out_of_fold_join, with_folds
from flipside.operators.linear import Candidate, fit_linear, predict
from flipside.plans.deltas import delta_counts, delta_margins, delta_scores, delta_statistics, full_statistics, variant_totals
from flipside.plans.variants import TextVariant, count_variants
from flipside.session import materialize

Scorer = Callable[[DataFrame, Sequence[TextVariant]], tuple[DataFrame, DataFrame]]

SCORE_COLUMNS = ("variant", "id", "split", "y_true", "score", "y_pred")


def variant_terms(documents: DataFrame, variants: Sequence[TextVariant]) -> tuple[DataFrame, DataFrame]:
    """Term counts of every document under every variant, and the fitted term statistics.

    Counts are written once, a row per document and variant; the statistics and the scoring read
    them from there.
    """
    counted = materialize(count_variants(documents, variants), "counts")
    tf = counted_terms(counted, F.col("counts"), ["variant"], keep_empty=True)
    return tf, fit_terms(tf, ["variant"])


def bayes_scorer(threshold: float = 0.30, splits: Sequence[str] | None = None) -> Scorer:
    """Scores every variant by its difference from the first; only the differences are written.

    With ``splits``, only rows of these are scored; what is learned does not depend on it.
    """

    def score(documents: DataFrame, variants: Sequence[TextVariant]) -> tuple[DataFrame, DataFrame]:
        counted = delta_counts(documents, variants)
        terms, changed = delta_statistics(counted)
        totals = materialize(variant_totals(terms, changed, variants), "variant-totals")
        judged = counted if splits is None else counted.filter(F.col("split").isin(*splits))
        scores = delta_scores(delta_margins(judged, terms, changed), totals)
        return predict_at(scores, threshold).select(*SCORE_COLUMNS), full_statistics(terms, changed, variants)

    return score


def out_of_fold_scores(documents: DataFrame, variant: TextVariant, threshold: float = 0.30, folds: int = FOLDS) -> DataFrame:
    """Written Bayes scores in which no training row was seen by its model:
    ``fold, id, split, y_true, score, y_pred``."""
    foldless = materialize(count_variants(documents, [variant]), "counts")
    tf = with_folds(counted_terms(foldless, F.col("counts"), keep_empty=True), folds)
    statistics = fold_statistics(tf)
    joined = out_of_fold_join(tf, complement_log_odds(statistics.filter(F.col("term") != NO_TERM)), statistics)
    scores = predict_at(mean_scores(joined, ["fold"]), threshold)
    return materialize(scores.select("fold", "id", "split", "y_true", "score", "y_pred"), "scores")


def logistic_scorer(c: float = 1.0, max_iter: int = 100) -> Scorer:
    def score(documents: DataFrame, variants: Sequence[TextVariant]) -> tuple[DataFrame, DataFrame]:
        tf, terms = variant_terms(documents, variants)
        vectors = text_vectors(tf, terms, documents, ["variant"])
        candidates = [Candidate("lr", c, max_iter=max_iter)]
        models = fit_linear(vectors.filter("split = 'train'"), candidates, "variant")
        scored = predict(vectors, models, "variant").withColumnRenamed("feature_set", "variant")
        return materialize(scored.select(*SCORE_COLUMNS), "scores"), terms

    return score
