import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flipside.llm import queries
from flipside.session import materialize
from tests.llm.conftest import document_rows
from tests.llm.test_duplicates import plain_components
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The input and output of every stage, as rows."""
    docs = queries.read_table(spark, folder, "documents")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, docs, folder), f"test-{name}")
        found.append((name, docs, kept))
        docs = kept
    return {name: (docs.collect(), kept.collect(), docs.columns, kept.columns) for name, docs, kept in found}


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_copies", "near_copies", "packing"]


@pytest.mark.parametrize("name", ["toxicity", "quality", "exact_copies", "near_copies"])
def test_stages_keep_whole_documents(stages, name):
    before, after, columns, kept_columns = stages[name]
    assert columns == kept_columns
    assert set(after) <= set(before) and 0 < len(after) < len(before)


@pytest.mark.parametrize(("name", "label", "bad"), [("toxicity", "toxic", 1), ("quality", "quality", 0)])
def test_filters_follow_the_labels(spark, folder, stages, name, label, bad):
    before, after, *_ = stages[name]
    kept = {row.doc_id for row in after}
    labels = {row.doc_id: row[label] for row in queries.read_table(spark, folder, "labels").collect()}
    known = [(labels[row.doc_id], row.doc_id in kept) for row in before if row.doc_id in labels]
    assert np.mean([stays == (label != bad) for label, stays in known]) > 0.93


def test_exact_copies_go(stages):
    before, after, *_ = stages["exact_copies"]
    first = {}
    for row in before:
        first[row.text] = min(row.doc_id, first.get(row.text, row.doc_id))
    assert {row.doc_id for row in after} == set(first.values())


def test_one_of_each_near_copy_stays(stages):
    before, after, *_ = stages["near_copies"]
    expected = {doc for doc, _, component in plain_components([(row.doc_id, row.text) for row in before]) if doc == component}
    assert {row.doc_id for row in after} == expected


def test_everything_kept_is_packed(stages):
    before, after, *_ = stages["packing"]
    tokenizer = Tokenizer.from_file(corpus_pipeline.WORD_BPE)
    check_packing(after, 2048)
    lengths = {}
    for row in after:
        lengths[row.doc_id] = lengths.get(row.doc_id, 0) + row.length
    assert lengths == {row.doc_id: len(tokenizer.encode(row.text, add_special_tokens=False).ids) + 1 for row in before}


def test_awkward_documents_pass_every_stage(spark, awkward, no_documents, tmp_path):
    labels = [(doc_id, number % 2, 0) for number, (doc_id, _) in enumerate(document_rows()) if doc_id is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for documents in (awkward, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, documents, str(tmp_path)).columns == awkward.columns
            assert stage(spark, documents, str(tmp_path)).filter(F.col("doc_id") < 0).count() == 0


def by_rows(rows):
    return sorted(((row.doc_id, row.text, row.n) for row in rows), key=str)


def test_exact_copies_go_row_by_row(spark):
    """Null ids, an id of several texts and repeated rows: one row of each text stays."""
    rows = [(None, "x"), (None, "x"), (None, None), (None, ""), (3, "B"), (10, "A"), (10, "B"), (None, "B"), (7, "C"), (7, "C"), (8, "C")]
    docs = spark.createDataFrame([(doc, text, n) for n, (doc, text) in enumerate(rows)], "doc_id bigint, text string, n int").coalesce(1)
    kept = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert by_rows(kept) == sorted([(None, "x", 0), (None, None, 2), (3, "B", 4), (10, "A", 5), (7, "C", 8)], key=str)


def test_near_copies_go_row_by_row(spark):
    words = [f"w{number}" for number in range(60)]
    base, near, other = " ".join(words), " ".join([*words[:-1], "y"]), " ".join(f"v{number}" for number in range(60))
    rows = [(None, other), (None, other + " z"), (5, near), (4, base), (5, "five words of its own here"), (4, base), (None, near), (6, None), (None, "")]
    docs = spark.createDataFrame([(doc, text, n) for n, (doc, text) in enumerate(rows)], "doc_id bigint, text string, n int").coalesce(1)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(row.n for row in kept) == [0, 3, 4, 7, 8]


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_filters_decide_row_by_row(spark, folder, stages, name):
    """The same texts without ids, or all under one id, are kept as they are under their own."""
    before, after, *_ = stages[name]
    stage, kept = dict(corpus_pipeline.STAGES)[name], {row.doc_id for row in after}
    docs = queries.read_table(spark, folder, "documents")
    docs = docs.filter(F.col("doc_id").isin([row.doc_id for row in before]))
    awkward = docs.withColumn("n_chars", F.col("doc_id"))
    more = awkward.withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(awkward.withColumn("doc_id", F.lit(-1).cast("bigint")))
    # The unlabelled rows change nothing in what is learned.
    found = [row.n_chars for row in stage(spark, awkward.unionByName(more), folder).collect()]
    assert sorted(found) == sorted([*kept] * 3)
