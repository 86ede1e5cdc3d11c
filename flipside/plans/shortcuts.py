"""Investigation 3: how far do shallow features get without reading the text?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.functions.surface import SHORTCUT_COLUMNS, shortcut_columns
from flipside.operators.bayes import majority_floor
from flipside.operators.features import one_hot, vector_table, with_index
from flipside.operators.joins import lookup_join
from flipside.operators.linear import Candidate, LinearModel, fit_linear, predict, top_coefficients
from flipside.operators.metrics import confusion, f1
from flipside.operators.splits import open_splits
from flipside.session import materialize

# Which feature blocks each model sees.
MODELS = {
    "keyword_only": ("keyword",),
    "char_len_only": ("char_len",),
    "has_url_only": ("has_http",),
    "n_hashtags_only": ("n_hashtags",),
    "frac_upper_only": ("frac_upper",),
    "has_location_only": ("has_location",),
    "metadata_numeric_bundle": SHORTCUT_COLUMNS,
    "all_shortcuts": (*SHORTCUT_COLUMNS, "keyword"),
    "text_only": ("text",),
    "text_plus_all_shortcuts": ("text", *SHORTCUT_COLUMNS, "keyword"),
}

# What a block of features tells a classifier: something about the task, an artifact of how texts
# were written or collected, or the text itself.
KINDS = {
    "text": "text",
    "keyword": "task",
    "char_len": "artifact",
    "has_http": "artifact",
    "n_hashtags": "artifact",
    "frac_upper": "artifact",
    "has_location": "context",
}


def feature_note(blocks: Sequence[str]) -> str:
    """A model's note, derived from its blocks: their kinds, and the blocks if they are few."""
    if not blocks:
        return "none: majority class"
    kinds = sorted({KINDS[block] for block in blocks})
    named = ", ".join(blocks) if len(blocks) <= 2 else f"{len(blocks)} blocks"
    return f"{' + '.join(kinds)}: {named}"


def shortcut_features(documents: DataFrame) -> DataFrame:
    columns = shortcut_columns(F.col("text"), F.col("location"))
    return documents.select("id", "target", "split", *[c.alias(n) for n, c in columns.items()])


def keyword_index(documents: DataFrame) -> DataFrame:
    """The one-hot levels of train and their feature numbers."""
    levels = one_hot(documents).filter("split = 'train'").select("level").distinct()
    return materialize(with_index(levels, key="level"), "levels")


def shortcut_vectors(documents: DataFrame, levels: DataFrame, text: DataFrame) -> DataFrame:
    """Vectors of all models in one table, keyed by ``model``.

    ``text`` are the text vectors of the same documents. Every block is a long table of entries;
    a model is a choice of blocks laid side by side, so its entries are the blocks' entries
    shifted by where the block begins.
    """
    sizes = {name: 1 for name in SHORTCUT_COLUMNS}
    sizes["keyword"] = levels.count()
    sizes["text"] = text.agg(F.max("size")).first()[0] or 0

    document = ["id", "target", "split"]
    numbers = F.array(
        *[
            F.struct(F.lit(n).alias("block"), F.lit(0).alias("idx"), F.col(n).cast("double").alias("weight"))
            for n in SHORTCUT_COLUMNS
        ]
    )
    entries = shortcut_features(documents).select(*document, F.inline(numbers)).filter("weight != 0")
    leveled = documents.select(*document, F.coalesce("keyword", F.lit("__missing__")).alias("level"))
    level_counts = leveled.groupBy("level").agg(F.count("*").alias("n"))
    keyword = lookup_join(
        leveled, levels.select("level", "idx"), ["level"], level_counts, F.col("id")
    ).select(*document, F.lit("keyword").alias("block"), "idx", F.lit(1.0).alias("weight"))
    words = text.select(*document, F.lit("text").alias("block"), F.arrays_zip("indices", "values").alias("e")).select(
        *document, "block", F.inline("e").alias("idx", "weight")
    )
    # Keeps a document in models none of whose blocks have an entry for it.
    alive = documents.select(
        *document, F.lit("alive").alias("block"), F.lit(None).cast("int").alias("idx"), F.lit(0.0).alias("weight")
    )
    layout = []
    for model, blocks in MODELS.items():
        total, start = sum(sizes[b] for b in blocks), 0
        layout.append((model, "alive", 0, total))
        for block in blocks:
            layout.append((model, block, start, total))
            start += sizes[block]
    # A few rows per model.
    placed = documents.sparkSession.createDataFrame(layout, "model string, block string, start int, size int")
    rows = entries.unionByName(keyword).unionByName(words).unionByName(alive)
    shifted = rows.join(F.broadcast(placed), "block").withColumn("idx", F.col("idx") + F.col("start"))
    return vector_table(shifted, ["model"], normalized=False)


def shortcut_models(documents: DataFrame, text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of models with dev and held-out F1, and the keyword model's heaviest levels.

    A diagnostic audit: nothing is chosen from the held-out figures.
    """
    spark = documents.sparkSession
    levels = keyword_index(documents)
    vectors = shortcut_vectors(documents, levels, text)
    models = fit_linear(vectors.filter("split = 'train'"), [Candidate("lr")], "model")
    judged = open_splits(vectors, ["dev", "heldout"], diagnostic=True)
    scored = predict(judged, models, "model").select("feature_set", "split", "y_true", "y_pred")
    floor = open_splits(majority_floor(documents), ["dev", "heldout"], diagnostic=True)
    every = scored.unionByName(floor.select(F.lit("floor").alias("feature_set"), "split", "y_true", "y_pred"))
    quality = (
        confusion(every, ["feature_set", "split"])
        .groupBy(F.col("feature_set").alias("model"))
        .agg(
            F.round(F.max(F.when(F.col("split") == "dev", f1())), 4).alias("dev_f1_target_1"),
            F.round(F.max(F.when(F.col("split") == "heldout", f1())), 4).alias("heldout_f1_target_1"),
        )
    )
    sizes = {m.feature_set: m.size for m in models} | {"floor": 1}
    described_models = {"floor": (), **MODELS}
    rows = [(i, name, sizes[name], feature_note(blocks)) for i, (name, blocks) in enumerate(described_models.items())]
    described = spark.createDataFrame(rows, "position bigint, model string, n_features bigint, feature_type_note string")
    table = described.join(quality, "model").select(
        "position", "model", "n_features", "dev_f1_target_1", "heldout_f1_target_1", "feature_type_note"
    )
    keyword_model: LinearModel = next(m for m in models if m.feature_set == "keyword_only")
    return table, top_coefficients(keyword_model, levels, "level")

