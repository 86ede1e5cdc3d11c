import hashlib
import math

import pytest
from pyspark.sql import functions as F

from flipside.functions.terms import tokens
from flipside.operators import features, hashing


def plain_cell(word, width):
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % width, -1 if int(digest[8], 16) % 2 else 1


def plain_cells(text, width):
    cells = {}
    for word in text.lower().split():
        bucket, sign = plain_cell(word, width)
        cells[bucket] = cells.get(bucket, 0) + sign
    return {bucket: value for bucket, value in cells.items() if value}


@pytest.fixture(scope="module")
def documents(spark):
    words = [f"word{number}" for number in range(90)]
    texts = [" ".join(words[(7 * row * step) % 90] for step in range(row % 13)) for row in range(60)]
    rows = [(row, row % 2, "train" if row % 3 else "dev", text) for row, text in enumerate(texts)]
    rows += [(90, 0, "dev", "unseen terms alone"), (91, 1, "train", None), (None, 1, "train", "word1 word2"), (None, 0, "train", "word3")]
    return spark.createDataFrame(rows, "id bigint, target int, split string, text string")


@pytest.mark.parametrize("width", [4, 64, hashing.WIDTH])
def test_weights_equal_the_definition(documents, width):
    """Many collisions in few buckets, rows without an id each for themselves."""
    cells = hashing.hashed_cells(documents, tokens(F.col("text")), width)
    found = hashing.hashed_tfidf(cells, hashing.bucket_idf(cells), width).collect()
    rows = [(row.id, row.split, plain_cells(row.text or "", width)) for row in documents.collect()]
    train = [held for _, split, held in rows if split == "train"]
    df = {bucket: sum(bucket in held for held in train) for bucket in {bucket for held in train for bucket in held}}
    expected = []
    for row_id, _, held in rows:
        raw = {b: tf * (math.log((1 + len(train)) / (1 + df[b])) + 1) for b, tf in held.items() if b in df}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        expected += [(str(row_id), b, held[b], round(x / norm, 9)) for b, x in raw.items()]
    assert sorted((str(row.id), row.bucket, row.tf, round(row.weight, 9)) for row in found) == sorted(expected)


def test_collisions_are_counted(documents):
    counted = features.term_frequencies(documents, tokens(F.col("text")))
    found = {row.bucket: row for row in hashing.collisions(features.term_statistics(counted), 16).collect()}
    shared = {}
    for word in {word for row in documents.collect() if row.split == "train" for word in (row.text or "").split()}:
        bucket, sign = plain_cell(word, 16)
        shared.setdefault(bucket, []).append(sign)
    assert {bucket: (row.n_terms, row.n_negative) for bucket, row in found.items()} == {
        bucket: (len(signs), signs.count(-1)) for bucket, signs in shared.items() if len(signs) > 1
    }
    assert all(row.most_df <= row.sum_df for row in found.values())


def test_no_documents(documents):
    cells = hashing.hashed_cells(documents.limit(0), tokens(F.col("text")), 8)
    assert hashing.hashed_tfidf(cells, hashing.bucket_idf(cells), 8).count() == 0


def test_norms_are_summed_before_cells_become_rows(spark):
    """Not once per cell of a document, which grows with the square of its length."""
    documents = spark.createDataFrame([(1, 0, "train", "aa bb cc aa")], "id bigint, target int, split string, text string")
    cells = hashing.hashed_cells(documents, tokens(F.col("text")))
    plan = hashing.hashed_tfidf(cells, hashing.bucket_idf(cells))._jdf.queryExecution().optimizedPlan().toString()
    above, generate, _ = plan.partition("Generate")
    assert generate and "aggregate(" not in above.lower()
