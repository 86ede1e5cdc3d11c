"""Variants as signed differences: the same scores as counting every variant anew, written for changed texts only."""

import pytest
from pyspark.sql import functions as F

from flipside.operators.bayes import mean_log_odds_scores, token_log_odds
from flipside.plans import deltas as D
from flipside.plans.scoring import bayes_scorer, variant_terms
from flipside.plans.variants import BASELINE, NGRAM_VARIANTS, NORMALIZATION_VARIANTS, STRIP_URLS, TOKENIZER_VARIANTS


@pytest.fixture(scope="module")
def documents(spark):
    texts = ["storm hits the coast", "Storm Hits http://a.b/storm now", "@bob calm &amp; sunny", "#calm day", "", "!!", "http://only.url", "calm calm day"]
    rows = [
        (i, "train" if i % 10 < 6 else "dev" if i % 10 < 8 else "heldout", int(i * 7 % 3 == 0), f"{texts[i % 8]} {'x' + str(i % 11) if i % 3 else ''}")
        for i in range(80)
    ]
    return spark.createDataFrame(rows, "id bigint, split string, target int, text string").repartition(4)


@pytest.mark.parametrize("variants", [NORMALIZATION_VARIANTS, TOKENIZER_VARIANTS, NGRAM_VARIANTS, (BASELINE,)], ids=["steps", "tokens", "bigrams", "one"])
def test_scores_equal_those_of_variants_counted_anew(documents, variants):
    scored, vocabulary = bayes_scorer(0.3)(documents, variants)
    tf, terms = variant_terms(documents, variants)
    anew = mean_log_odds_scores(tf, token_log_odds(terms, ["variant"]), terms, ["variant"]).collect()
    found = {(r.variant, r.id): r.score for r in scored.collect()}
    assert found == pytest.approx({(r.variant, r.id): r.score for r in anew})
    assert len(found) == 80 * len(variants)
    known = lambda frame: sorted((r.variant, r.term, r.df) for r in frame.filter("df > 0").collect())
    assert known(vocabulary) == known(terms)


def test_only_changed_documents_have_entries(documents):
    counted = D.delta_counts(documents, (BASELINE, STRIP_URLS))
    changed = {r.id for r in D.delta_rows(counted).collect()}
    assert changed == {r.id for r in documents.filter(F.col("text").contains("http")).collect()}
    entries = [(r.sign, r.term) for r in D.delta_rows(counted).filter("id = 6").collect()]
    assert sorted(entries) == [(-1, "http"), (-1, "only"), (-1, "url")]
    assert D.delta_rows(D.delta_counts(documents.limit(0), NORMALIZATION_VARIANTS)).count() == 0


def test_a_variant_s_vocabulary_size(documents):
    terms, changed = D.delta_statistics(D.delta_counts(documents, NORMALIZATION_VARIANTS))
    sizes = {r.variant: r.vocab_size for r in D.variant_totals(terms, changed, NORMALIZATION_VARIANTS).collect()}
    _, anew = variant_terms(documents, NORMALIZATION_VARIANTS)
    assert sizes == {r.variant: r["count"] for r in anew.filter("df > 0").groupBy("variant").count().collect()}


def test_only_the_named_splits_are_scored(documents):
    """The same scores, learned from all rows; rows of other splits get no margin."""
    every, vocabulary = bayes_scorer(0.3)(documents, NORMALIZATION_VARIANTS)
    some, same = bayes_scorer(0.3, ["dev", "heldout"])(documents, NORMALIZATION_VARIANTS)
    key = lambda r: (r.variant, r.id)
    found = {key(r): r.score for r in some.collect()}
    assert found == pytest.approx({key(r): r.score for r in every.filter("split <> 'train'").collect()})
    assert len(found) == 32 * len(NORMALIZATION_VARIANTS)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, vocabulary.collect()))
