"""Vocabularies, TF-IDF weights, one-hot levels and feature vectors.

Term tables are long: one row per document and term. ``by`` names columns that keep several
feature sets (normalization variants, n-gram ranges) apart in the same table, so that a sweep
over variants is one job and not one job per variant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.terms import let, term_counts
from flipside.operators.joins import lookup_join
from flipside.session import materialize

# Keys that are sorted in one task when a vocabulary is numbered.
BUCKET_KEYS = 1 << 16

# Stands for "no term" so that a document without tokens keeps a row; tokens have at least one
# character, so it cannot collide with one.
NO_TERM = ""


def counted_terms(
    documents: DataFrame, counts: Column, by: Sequence[str] = (), keep_empty: bool = False
) -> DataFrame:
    """Rows ``(by..., id, target, split, term, tf)`` from each document's array of counts."""
    carried = [*by, "id", "target", "split"]
    # The outer form: for the inner one Spark derives a filter that counts every document twice.
    rows = documents.select(*carried, F.inline_outer(counts))
    if not keep_empty:
        return rows.filter(F.col("term").isNotNull())
    return rows.withColumns(
        {
            "term": F.coalesce("term", F.lit(NO_TERM)),
            "tf": F.coalesce("tf", F.lit(0).cast("bigint")),
        }
    )


def term_frequencies(
    documents: DataFrame, words: Column, by: Sequence[str] = (), keep_empty: bool = False
) -> DataFrame:
    """The same from each document's words, counted inside its row."""
    return counted_terms(documents, term_counts(words), by, keep_empty)


def term_statistics(tf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per term: ``n`` rows over all splits, and from train only the document frequency ``df``
    and the token counts of each class.

    Only df and the token counts may enter a model; ``n`` just tells the joins how many rows a
    term will bring.
    """
    train = (F.col("split") == "train") & (F.col("tf") > 0)
    in_class = lambda c: F.sum(F.when(train & (F.col("target") == c), F.col("tf")).otherwise(0))
    return tf.groupBy(*by, "term").agg(
        F.count("*").alias("n"),
        F.count_if(train).alias("df"),
        in_class(0).alias("tokens_neg"),
        in_class(1).alias("tokens_pos"),
    )


def fit_terms(tf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The term statistics as a written table: it is read by every later step."""
    return materialize(term_statistics(tf, by), "terms")


def vocabulary(terms: DataFrame, min_df: int = 1) -> DataFrame:
    return terms.filter(F.col("df") >= min_df)


def train_size(documents: DataFrame) -> DataFrame:
    """One row ``n_train``."""
    return documents.agg(F.count_if(F.col("split") == "train").alias("n_train"))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def idf_table(terms: DataFrame, documents: DataFrame, by: Sequence[str] = (), min_df: int = 1) -> DataFrame:
    return (
        vocabulary(terms, min_df)
        .crossJoin(F.broadcast(train_size(documents)))
        .select(*by, "term", "df", smooth_idf(F.col("df"), F.col("n_train")).alias("idf"))
    )


def tf_weight(tf: Column, sublinear: Column | bool = False) -> Column:
    sublinear = F.lit(sublinear) if isinstance(sublinear, bool) else sublinear
    return F.when(sublinear, 1 + F.ln(tf)).otherwise(tf.cast("double"))


def tfidf(
    tf: DataFrame,
    idf: DataFrame,
    terms: DataFrame,
    by: Sequence[str] = (),
    sublinear: bool = False,
    keep_unknown: bool = False,
) -> DataFrame:
    """Add the unit-length ``weight`` to term rows.

    Terms outside the fitted vocabulary drop out, as they do when dev and held-out texts are
    transformed with what was fitted on train; ``keep_unknown`` keeps them with a NULL weight.
    """
    how = "left" if keep_unknown else "inner"
    raw = tf_weight(F.col("tf"), sublinear) * F.col("idf")
    document = W.partitionBy(*by, "id")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(document))
    weighted = (
        lookup_join(tf, idf, [*by, "term"], terms.select(*by, "term", "n"), F.col("id"), how, source=terms)
        .withColumn("raw", raw)
        .withColumn("weight", F.col("raw") / norm)
    )
    return weighted.select(*by, "id", "target", "split", "term", "tf", "weight")


def with_index(rows: DataFrame, by: Sequence[str] = (), key: str = "term") -> DataFrame:
    """Number the keys of each feature set 0..n-1 as ``idx``, and give the count ``size``.

    Keys are hashed into buckets of about BUCKET_KEYS, bucket sizes are summed up, and only a bucket
    at a time is sorted.
    """
    rows = materialize(rows, "keys")
    buckets = -(-rows.count() // BUCKET_KEYS) or 1
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    running = W.partitionBy(*by).orderBy("bucket") if by else W.partitionBy(F.lit(0)).orderBy("bucket")
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    offsets = (
        bucketed.groupBy(*by, "bucket")
        .agg(F.count("*").alias("n_bucket"))
        .withColumn("offset", F.sum("n_bucket").over(running) - F.col("n_bucket"))
        .withColumn("size", F.sum("n_bucket").over(whole))
        .drop("n_bucket")
    )
    within = F.row_number().over(W.partitionBy(*by, "bucket").orderBy(key))
    return (
        bucketed.withColumn("within", within)
        .join(F.broadcast(offsets), [*by, "bucket"])
        .withColumn("idx", (F.col("offset") + F.col("within") - 1).cast("int"))
        .withColumn("size", F.col("size").cast("int"))
        .drop("bucket", "within", "offset")
    )


def unit_length(entries: Column) -> Column:
    """Scale array<struct<idx, weight>> to length one; an empty or zero array stays as it is."""
    length = F.sqrt(
        F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"])
    )
    return let(
        length,
        lambda n: F.transform(
            entries,
            lambda e: F.struct(
                e["idx"].alias("idx"),
                F.when(n > 0, e["weight"] / n).otherwise(e["weight"]).alias("weight"),
            ),
        ),
    )


def vector_table(
    rows: DataFrame, by: Sequence[str] = (), name: str = "vectors", normalized: bool = True
) -> DataFrame:
    """Written table ``(by..., split, id, target, size, indices, values)`` of sparse vectors.

    ``rows`` are ``(by..., id, target, split, idx, weight, size)``; a row with a NULL idx only
    keeps its document alive. Fits pass over the vectors many times, so they are written once,
    one folder per feature set.
    """
    carried = [*by, "split", "id", "target"]
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "weight"))
    collected = rows.groupBy(*carried).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.max("size").alias("size")
    )
    return written_vectors(collected, by, name, normalized)


def written_vectors(collected: DataFrame, by: Sequence[str] = (), name: str = "vectors", normalized: bool = True) -> DataFrame:
    """The vectors of rows ``(by..., id, target, split, size, entries)`` with ordered entries."""
    if normalized:
        collected = collected.withColumn("entries", unit_length(F.col("entries")))
    vectors = collected.select(
        *by, "split", "id", "target",
        "size",
        F.transform("entries", lambda e: e["idx"]).alias("indices"),
        F.transform("entries", lambda e: e["weight"]).alias("values"),
    )
    return materialize(vectors, name, partition_by=tuple(by))


def text_vectors(
    tf: DataFrame,
    terms: DataFrame,
    documents: DataFrame,
    by: Sequence[str] = (),
    min_df: int = 1,
    sublinear: bool = False,
) -> DataFrame:
    """Unit-length TF-IDF vectors of every document.

    ``tf`` must come with ``keep_empty=True`` so that documents without known terms get a zero
    vector and are still scored.
    """
    indexed = materialize(with_index(idf_table(terms, documents, by, min_df), by), "vocabulary")
    sizes = indexed.groupBy(*by).agg(F.max("size").alias("size"))
    rows = lookup_join(
        tf,
        indexed.select(*by, "term", "idx", "idf"),
        [*by, "term"],
        terms.select(*by, "term", "n"),
        F.col("id"),
        how="left",
    ).withColumn("weight", tf_weight(F.col("tf"), sublinear) * F.col("idf"))
    # One row per feature set.
    sized = rows.join(F.broadcast(sizes), list(by)) if by else rows.crossJoin(F.broadcast(sizes))
    return vector_table(sized, by)


def one_hot(documents: DataFrame, column: str = "keyword", missing: str = "__missing__") -> DataFrame:
    """Long one-hot rows ``(id, split, level)``: NULL is a level of its own, and a level train has
    not seen gives the document no row."""
    levels = documents.filter(F.col("split") == "train").select(F.coalesce(column, F.lit(missing)).alias("level"))
    levels = materialize(levels.distinct(), "levels")
    rows = documents.select("id", "split", F.coalesce(column, F.lit(missing)).alias("level"))
    counts = rows.groupBy("level").agg(F.count("*").alias("n"))
    return lookup_join(rows, levels, ["level"], counts, F.col("id"))
