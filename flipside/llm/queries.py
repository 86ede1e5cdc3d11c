"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.llm import (
    cover_tree,
    exact_dedup,
    line_runs,
    merkle,
    ngram_join,
    packing,
    pattern_grammar,
    perspective,
    ppm,
    prefix_table,
    quadratic,
    token_grammar,
    whitening,
)
from flipside.llm.common import fold, id_text, read_table
from flipside.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_grammar(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    token_grammar.write_token_shards(read_table(spark, folder, "documents"), path, WORD_BPE, end_id=2)
    return token_grammar.read_token_shards(spark, path)


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return fold(doc_id, 3) != 1


def decided(scores: DataFrame, threshold: float, *more: str) -> DataFrame:
    return scores.select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *more,
    )


@query
def op4_pattern_grammar(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    scores = pattern_grammar.score_toxicity(documents, labels, in_training(F.col("id")))
    return decided(scores, 0.7, "n_clauses")


@query
def op5_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return perspective.rotate_perspectives(read_table(spark, folder, "conversations"))


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, folder, "documents"), keep="largest")


@query
def op8_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), WORD_BPE, end_id=0)


@query
def op9_quadratic_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    return decided(quadratic.score_quality(documents, labels, in_training(F.col("id"))), 0.5)


@query
def op10_cover_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.top_inner_products(read_table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op2_partial_matching(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score_documents(read_table(spark, folder, "documents"), fold(F.col("id"), 10) != 0)


@query
def op3_prefix_table(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_table.encode_and_decode(read_table(spark, folder, "documents"), PIECE_BPE)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, folder, "documents"))


@query
def op11_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_runs.drop_repeated_lines(read_table(spark, folder, "documents"), min_documents=5, min_length=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op12_refined_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"), components=16)


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = [F.col(name) for name in MANIFEST_FIELDS]
    tampered = merkle.leaf_digest([*fields[:-1], F.replace(fields[-1], F.lit("\n"), F.lit(""))])
    leaves = read_table(spark, folder, "documents").select(
        F.col("doc_id").cast("bigint").alias("id"),
        merkle.group_key(F.col("source")).alias("group"),
        merkle.leaf_digest(fields).alias("leaf"),
        F.when(F.crc32(id_text(F.col("doc_id"))) % 2 == 0, tampered).alias("tampered"),
    )
    path = scratch_path(spark, "merkle")
    merkle.write_manifest(leaves, path)
    proved = merkle.prove(spark, path, spark.read.parquet(f"{path}/leaves"))
    found = proved.select(
        F.col("id").alias("doc_id"),
        merkle.hexed(F.col("leaf")).alias("leaf"),
        merkle.hexed(F.col("subroot")).alias("subroot"),
        merkle.hexed(F.col("root")).alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
