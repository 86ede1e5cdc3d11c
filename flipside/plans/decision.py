"""Investigation 4: threshold, strength, class weight and classifier, chosen on dev and frozen."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.operators.bayes import fit_weighted_bayes, weighted_bayes_scores
from flipside.operators.features import idf_table, text_vectors, tfidf
from flipside.operators.folds import FOLDS, NO_FOLD, with_folds
from flipside.operators.linear import Candidate, LinearModel, certificates, fit_linear, predict
from flipside.operators.metrics import best_row, confusion, prf, threshold_sweep
from flipside.operators.splits import FrozenDecision, open_splits
from flipside.plans.scoring import variant_terms
from flipside.plans.variants import STRIP_URLS, TextVariant
from flipside.session import materialize

# The strengths tried, and the stochastic classifier's penalty per row.
C_VALUES = (0.3, 1.0, 3.0, 10.0, 30.0)
SGD_ALPHA = 1e-4

C_SWEEP = tuple(Candidate(f"C={c:g}", c) for c in C_VALUES)
BALANCED = Candidate("class_weight=balanced", balanced=True)
LINEAR_SVC = Candidate("LinearSVC", loss="hinge")
# The objective that stochastic descent approaches, solved to the end.
SGD_LOGISTIC = Candidate("SGDClassifier(log_loss)", alpha=SGD_ALPHA)
NAIVE_BAYES = "MultinomialNB"

GROUPS = (
    {c.label: "C_sweep" for c in C_SWEEP}
    | {BALANCED.label: "class_weight"}
    | {LINEAR_SVC.label: "alt_classifier", NAIVE_BAYES: "alt_classifier", SGD_LOGISTIC.label: "alt_classifier"}
)


def naive_bayes_scores(documents: DataFrame, variant: TextVariant = STRIP_URLS) -> DataFrame:
    """Multinomial naive Bayes on TF-IDF weights: ``id, y_true, split, score, y_pred``."""
    tf, terms = variant_terms(documents, [variant])
    tf, terms = tf.drop("variant"), terms.drop("variant")
    weights = tfidf(tf, idf_table(terms, documents), terms, keep_unknown=True)
    return weighted_bayes_scores(weights, fit_weighted_bayes(weights), terms, documents)


def linear_scores(
    documents: DataFrame, candidates: tuple[Candidate, ...], variant: TextVariant = STRIP_URLS
) -> DataFrame:
    """Scores of all candidates, fitted together on one feature set, as a written table."""
    vectors, models = _fitted(documents, candidates, variant)
    return materialize(predict(vectors, models).drop("feature_set"), "scores")


def _fitted(
    documents: DataFrame, candidates: tuple[Candidate, ...], variant: TextVariant
) -> tuple[DataFrame, list[LinearModel]]:
    tf, terms = variant_terms(documents, [variant])
    vectors = text_vectors(tf.drop("variant"), terms.drop("variant"), documents)
    return vectors, fit_linear(vectors.filter("split = 'train'"), candidates)


def certified_scores(
    documents: DataFrame, candidates: tuple[Candidate, ...], variant: TextVariant = STRIP_URLS
) -> tuple[DataFrame, DataFrame]:
    """The models' certificates, and the written scores with ``margin_error`` and ``certified``."""
    vectors, models = _fitted(documents, candidates, variant)
    proofs = certificates(models)
    return proofs, materialize(predict(vectors, models, proofs=proofs).drop("feature_set"), "scores")


def out_of_fold_classes(documents: DataFrame, candidate: Candidate, variant: TextVariant = STRIP_URLS, folds: int = FOLDS) -> DataFrame:
    """Written scores in which no training row was fitted by its model: ``fold, id, split, y_true, score, y_pred,
    certified``. Rows outside train are scored by the model of all folds.

    All models share one table of vectors; terms and their weights, which no label enters, come from all of train.
    """
    tf, terms = variant_terms(documents, [variant])
    vectors = text_vectors(tf.drop("variant"), terms.drop("variant"), documents)
    vectors = with_folds(vectors, folds)
    each = {fold: replace(candidate, label=f"{candidate.label} without {fold}", leave_out=fold) for fold in range(folds)}
    models = fit_linear(vectors.filter("split = 'train'"), (candidate, *each.values()))
    scored = predict(vectors, models, proofs=certificates(models))
    own = F.create_map(*[F.lit(x) for fold, one in {NO_FOLD: candidate, **each}.items() for x in (fold, one.label)])
    found = with_folds(scored, folds).filter(F.col("label") == own[F.col("fold")])
    return materialize(found.drop("feature_set", "label"), "scores")


def certificate_table(proofs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per model: rows fitted and scored, positive classes, and classes its certificate leaves open."""
    counts = scores.groupBy("label").agg(
        F.count("*").alias("n_scored"), F.sum("y_pred").alias("n_positive"), F.count_if(~F.col("certified")).alias("n_uncertified")
    )
    return proofs.join(counts, "label").select(
        "label", "n_fit", "converged", "n_scored", "n_positive", "n_uncertified", "epsilon", "delta"
    )


def candidate_quality(scores: DataFrame) -> DataFrame:
    """Dev precision, recall and F1 per label, unrounded, in the order of GROUPS."""
    order = [(i, group, label) for i, (label, group) in enumerate(GROUPS.items())]
    listed = scores.sparkSession.createDataFrame(order, "position bigint, group string, label string")
    dev = open_splits(scores, ["dev"])
    return listed.join(prf(confusion(dev, ["label"]), ["label"], "dev_"), "label").drop("dev_accuracy")


def with_combo(scores: DataFrame, sweep: DataFrame, quality: DataFrame) -> DataFrame:
    """The best strength's scores (found at one half) cut at the best threshold (found at C=1)."""
    best_c = best_row(quality.filter(F.col("group") == "C_sweep"), "dev_f1_target_1").select("label")
    strengths = F.create_map(*[F.lit(x) for c in C_SWEEP for x in (c.label, c.c)])
    best_t = best_row(sweep, "f1_target_1").select("threshold")
    # Both are single rows.
    chosen = best_c.crossJoin(best_t)
    return (
        scores.join(F.broadcast(chosen), "label")
        .withColumn("y_pred", (F.col("score") >= F.col("threshold")).cast("int"))
        .withColumn("c", strengths[F.col("label")])
        .withColumn("label", F.format_string("%s+threshold=%s", "label", "threshold"))
    )


def rounded(table: DataFrame) -> DataFrame:
    return table.select(
        *[F.round(c, 4).alias(c) if kind == "double" and c != "threshold" else F.col(c) for c, kind in table.dtypes]
    )


def candidate_table(linear: DataFrame, bayes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All dev candidates with the combination last, and the combination's scores.

    ``linear`` are the scores of C_SWEEP, BALANCED, LINEAR_SVC and SGD_LOGISTIC, ``bayes`` those of
    naive Bayes. ``beats_combo`` marks candidates with a higher dev F1 than the combination.
    """
    columns = ["label", "id", "split", "y_true", "score", "y_pred"]
    scores = linear.select(*columns).unionByName(
        bayes.withColumn("label", F.lit(NAIVE_BAYES)).select(*columns)
    )
    quality = materialize(candidate_quality(scores), "quality")
    sweep = threshold_sweep(open_splits(linear.filter("label = 'C=1'"), ["dev"]))
    combo = materialize(with_combo(linear, sweep, quality), "combo")
    combo_quality = prf(confusion(open_splits(combo, ["dev"]), ["label"]), ["label"], "dev_").select(
        F.lit(len(GROUPS)).cast("bigint").alias("position"),
        F.lit("combo").alias("group"),
        "label",
        "dev_precision_target_1",
        "dev_recall_target_1",
        "dev_f1_target_1",
    )
    to_beat = combo_quality.select(F.round("dev_f1_target_1", 4).alias("combo_f1"))
    table = rounded(quality.unionByName(combo_quality)).crossJoin(F.broadcast(to_beat))
    return table.withColumn("beats_combo", F.col("dev_f1_target_1") > F.col("combo_f1")).drop("combo_f1"), combo


def freeze_combo(ticket: str, model_name: str, table: DataFrame, combo: DataFrame) -> FrozenDecision:
    """The decision record of the combination."""
    chosen = combo.select("c", "threshold").first()
    f1 = table.filter(F.col("group") == "combo").first().dev_f1_target_1
    reason = f"C={chosen.c:g} and threshold={chosen.threshold:g} chosen on dev (dev F1={f1:.4f})"
    return FrozenDecision(ticket, model_name, f"adopt_c{chosen.c:g}_tuned_threshold", reason, chosen.threshold)


def best_threshold_predictions(scores: DataFrame) -> DataFrame:
    """All rows cut at the threshold with the best dev F1."""
    best = best_row(threshold_sweep(open_splits(scores, ["dev"])), "f1_target_1").select("threshold")
    return scores.crossJoin(F.broadcast(best)).withColumn(
        "y_pred", (F.col("score") >= F.col("threshold")).cast("int")
    )

