"""Corpus preparation in stages: toxicity, quality, exact copies, near copies, packing.

Every stage reads what its predecessor kept and decides for each row by itself, whether its id is
unique, shared or null: rows are numbered by their place in their files, stages decide on narrow tables
by that number, and the rejected numbers go to the rows, so that no filter shuffles texts. The filters
learn from the ``labels`` table of the folder and from the texts they are given; the packing packs
every row.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.llm import exact_dedup, ngram_join, packing, pattern_grammar, quadratic
from flipside.llm.common import ROW, fold, numbered, read_table, texts, unnumbered, without_rows
from flipside.session import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TOXIC_FROM = 0.7
GOOD_FROM = 0.5


def in_training(doc_id: Column) -> Column:
    return fold(doc_id, 3) != 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    rows = numbered(docs, "toxicity-rows")
    model = pattern_grammar.fit_grammar(texts(rows), labels, in_training(F.col("id")))
    scores = pattern_grammar.score_texts(model, texts(rows, ROW)).withColumnRenamed("doc_id", ROW)
    gone = materialize(scores.filter(F.col("score") >= TOXIC_FROM).select(ROW), "toxic")
    return unnumbered(without_rows(rows, gone), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    rows = numbered(docs, "quality-rows")
    vectors = materialize(quadratic.document_statistics(rows, number=ROW), "statistics")
    model = quadratic.fit_quality(vectors.select("id", "x"), labels, in_training(F.col("id")))
    scores = quadratic.score_vectors(model, vectors.select(F.col(ROW).alias("id"), "x")).withColumnRenamed("doc_id", ROW)
    gone = materialize(scores.filter(F.col("score") < GOOD_FROM).select(ROW), "poor")
    return unnumbered(without_rows(rows, gone), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_copies", drop_copies),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

# Learned scores and the packing rule are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
