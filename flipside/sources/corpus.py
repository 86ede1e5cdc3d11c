"""Readers: labelled corpora from CSV or parquet, split lists and contracts from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.session import spread

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("target", T.IntegerType()),
    ]
)

CONTRACT_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("reference_floor_f1", T.DoubleType()),
        T.StructField("reference_baseline_f1", T.DoubleType()),
        T.StructField("tolerance", T.DoubleType()),
        T.StructField("notes", T.StringType()),
    ]
)

# Cell texts that mean "no value" in a nullable column.
NULL_TOKENS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
}


def null_tokens_to_null(column: Column) -> Column:
    return F.when(~column.isin(*NULL_TOKENS), column)


def read_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Quoted multi-line CSV. Such a file cannot be cut, so a large corpus should come as many
    files or as parquet."""
    rows = spark.read.options(**CSV_OPTIONS).schema(CORPUS_SCHEMA).csv(path)
    return rows.withColumns(
        {name: null_tokens_to_null(F.col(name)) for name in ("keyword", "location")}
    ).withColumn("text", F.coalesce("text", F.lit("")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus by its file ending: .csv as above, anything else as parquet."""
    if path.rstrip("/").endswith(".csv"):
        return read_csv_corpus(spark, path)
    return spark.read.schema(CORPUS_SCHEMA).parquet(path)


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id lists ``{"train_ids": [...], ...}`` as rows ``(id, split, pos)``."""
    ids = T.ArrayType(T.LongType())
    names = ("train", "dev", "heldout")
    schema = T.StructType([T.StructField(f"{name}_ids", ids) for name in names])
    lists = spark.read.schema(schema).json(path, multiLine=True)
    parts = [
        lists.select(F.posexplode(f"{name}_ids").alias("pos", "id")).select(
            "id", F.lit(name).alias("split"), F.col("pos").cast("bigint").alias("pos")
        )
        for name in names
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split lists from JSON, or a parquet table ``(id, split, pos)``, which also suits lists too
    long for one JSON document."""
    if path.rstrip("/").endswith(".json"):
        return read_split_lists(spark, path)
    return spark.read.parquet(path).select("id", "split", "pos")


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTRACT_SCHEMA).json(path, multiLine=True)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The fixture tables as a corpus: low quality is the positive class."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("keyword"),
        F.col("source").alias("location"),
        "text",
        (1 - F.col("quality")).cast("int").alias("target"),
    )
    return spread(rows, documents, "id")


def labelled_web_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same corpus with the address and markup of the page of the same number appended, so
    that texts contain URLs, mentions, hashtags and entities."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(
        F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("page")
    )
    joined = labelled_documents(spark, folder).join(pages, "id", "left")
    return joined.withColumn("text", F.concat_ws(" ", "text", "page")).drop("page")
