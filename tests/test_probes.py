"""Vectors of all settings of the probes from one lookup."""

import pytest
from pyspark.sql import functions as F

from flipside.operators.features import text_vectors, written_vectors
from flipside.plans import probes
from flipside.plans.probes import Setting, setting_vectors
from flipside.plans.scoring import variant_terms
from flipside.plans.variants import NGRAM_VARIANTS


def test_setting_vectors_are_those_of_each_setting_alone(spark, monkeypatch):
    """All sets of the probes come from one lookup: the same vectors as with ``text_vectors`` per set, repeated ids included."""
    texts = ["a cat sat", "a cat and a dog sat", "dogs bark", "", "a cat", "the dog sat sat sat", "rare word"]
    rows = [(i % 6, i % 2, "train" if i < 5 else "dev", text) for i, text in enumerate(texts)]
    documents = spark.createDataFrame(rows, "id bigint, target int, split string, text string")
    settings = [Setting("g", "a"), Setting("g", "b", sublinear=True), Setting("g", "c", min_df=2), Setting("g", "d", ngrams="1-2")]
    collected = []
    monkeypatch.setattr(probes, "written_vectors", lambda rows, by: collected.append(rows) or written_vectors(rows, by))
    joined = setting_vectors(documents, settings)
    # Rows that were grouped, by the table they come from: one per document and n-gram range, whatever the number of sets.
    assert collected[0].select("id", "held").distinct().count() < collected[0].count()
    assert set(joined.columns) == {"feature_set", "split", "id", "target", "size", "indices", "values"}
    for setting in settings:
        tf, terms = variant_terms(documents, [v for v in NGRAM_VARIANTS if v.label == setting.ngrams])
        alone = text_vectors(tf, terms, documents, ["variant"], sublinear=setting.sublinear)
        if setting.min_df == 1:
            shown = lambda table: sorted((r.id, r.split, r.size, r.indices, [round(v, 12) for v in r["values"]]) for r in table.collect())
            assert shown(joined.filter(F.col("feature_set") == setting.feature_set)) == shown(alone)
    frequent = joined.filter("feature_set LIKE '%min_df=2%'").collect()
    assert len(frequent) == 7 and all(not r["values"] or sum(v * v for v in r["values"]) == pytest.approx(1) for r in frequent)
