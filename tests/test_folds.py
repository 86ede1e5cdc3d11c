"""Out-of-fold scores: no row is scored by a model that saw it, whatever its label."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flipside.operators.folds import NO_FOLD, with_folds
from flipside.operators.linear import Candidate
from flipside.plans.decision import out_of_fold_classes
from flipside.plans.scoring import out_of_fold_scores
from flipside.plans.variants import BASELINE

WORDS = ["storm", "flood", "fire", "calm", "sunny", "picnic", "news", "today", "rain"]


def corpus_rows(flipped=None):
    rows = []
    for i in range(120):
        words = [WORDS[(i * k + k * k) % len(WORDS)] for k in range(1, 2 + i % 6)] + ([f"only{i}"] if i % 7 == 0 else [])
        target = int(i % 3 == 0) if i != flipped else 1 - int(i % 3 == 0)
        rows.append((i, "train" if i < 90 else "dev" if i < 110 else "heldout", target, " ".join(words) if i % 29 else ""))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, split string, target int, text string")


def plain_scores(rows, folds):
    """Every model counted anew from the rows it may see."""
    found = {}
    for i, split, target, text in rows:
        counts = {0: Counter(), 1: Counter()}
        for j, other, label, words in rows:
            if other == "train" and (folds[i] == NO_FOLD or folds[j] != folds[i]):
                counts[label].update(words.split())
        vocabulary = set(counts[0]) | set(counts[1])
        known = [word for word in text.split() if word in vocabulary]
        odds = [
            math.log((counts[1][w] + 1) / (counts[1].total() + len(vocabulary))) - math.log((counts[0][w] + 1) / (counts[0].total() + len(vocabulary)))
            for w in known
        ]
        found[i] = 1 / (1 + math.exp(-sum(odds) / len(odds))) if odds else 0.5
    return found


def test_scores_equal_models_counted_anew(spark):
    rows = corpus_rows()
    folds = {r.id: r.fold for r in with_folds(frame(spark, rows)).collect()}
    assert set(folds.values()) == {NO_FOLD, 0, 1, 2, 3, 4}
    assert {i for i, fold in folds.items() if fold == NO_FOLD} == set(range(90, 120))
    scored = {r.id: r for r in out_of_fold_scores(frame(spark, rows), BASELINE).collect()}
    assert {i: r.score for i, r in scored.items()} == pytest.approx(plain_scores(rows, folds))
    assert {i: r.fold for i, r in scored.items()} == folds


@pytest.mark.parametrize("row", [3, 14, 50])
def test_a_row_s_label_does_not_enter_its_score(spark, row):
    before = {r.id: r for r in out_of_fold_scores(frame(spark, corpus_rows()), BASELINE).collect()}
    after = {r.id: r for r in out_of_fold_scores(frame(spark, corpus_rows(flipped=row)), BASELINE).collect()}
    same = {i for i, r in before.items() if r.fold == before[row].fold}
    assert all(before[i].score == pytest.approx(after[i].score, abs=1e-12) for i in same)
    assert any(abs(before[i].score - after[i].score) > 1e-6 for i in before if i not in same)


def test_a_label_does_not_enter_a_linear_score(spark):
    found = []
    for rows in (corpus_rows(), corpus_rows(flipped=14)):
        scored = out_of_fold_classes(frame(spark, rows), Candidate("LR"), BASELINE)
        found.append({r.id: r for r in scored.collect()})
    before, after = found
    assert len(before) == 120
    same = {i for i, r in before.items() if r.fold == before[14].fold}
    assert all(before[i].score == pytest.approx(after[i].score, abs=1e-4) for i in same)
    assert any(abs(before[i].score - after[i].score) > 1e-3 for i in before if i not in same)


def test_no_rows(spark):
    assert out_of_fold_scores(frame(spark, corpus_rows()).limit(0), BASELINE).count() == 0
    assert with_folds(frame(spark, corpus_rows()).limit(0)).filter(F.col("fold") > 0).count() == 0
