"""Exact duplicates: one group per distinct text, found by a 128-bit hash and confirmed by bytes.

Only built-in functions run here. Hashes are counted first, 16 bytes a text, and a text whose hash is
its own is a group by itself. Only texts that share their hash are grouped by the hash and the text
itself, so two texts with the same hash form two groups; copies within a task fold into one row before
the shuffle, however many there are. Rows then look up their group by hash and sha256, which tells two
texts of one hash apart, and the rows of a group larger than a task should hold are cut into pieces.

Of each group one row is kept: that of the smallest (or largest) id, before rows without id; of several
such rows the one numbered first.

Edge cases: a null text is empty, and all empty texts are one group; a group whose ids are all null has
a null ``keep_id``, and one of its rows is kept; of rows that repeat with the id that stays, one is kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import ROW, numbered, texts, unnumbered, without_rows
from flipside.operators.joins import lookup_join
from flipside.session import materialize


def exact_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per document: the id its group keeps (the ``smallest`` or ``largest``), the group's
    size, whether this row stays, and the sha256 of its text."""
    rows = texts(numbered(documents, "exact-rows"), id_column, text_column, F.col(ROW))
    return group_members(rows, keep).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col(ROW) == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def shared_groups(rows: DataFrame, keep: str) -> DataFrame:
    """Written ``(hash, text_sha256, keep_id, keep_row, group_size)`` of the texts with a hash that
    several of the ``rows (ROW, id, text, hash)`` have."""
    counts = materialize(rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "shared-hashes")
    alike = lookup_join(rows, counts.select("hash"), ["hash"], counts, F.col(ROW), "left_semi")
    # Largest first; a null id comes after all others, and a smaller number before a larger.
    order = {"largest": F.col("id"), "smallest": -F.col("id")}[keep]
    best = F.max(F.struct(order.alias("order"), (-F.col(ROW)).alias("row"), F.col("id"))).alias("best")
    groups = alike.groupBy("hash", "text").agg(best, F.count("*").alias("group_size")).filter("group_size > 1")
    return materialize(
        groups.select(
            "hash", F.sha2("text", 256).alias("text_sha256"), F.col("best.id").alias("keep_id"), (-F.col("best.row")).alias("keep_row"),
            "group_size",
        ),
        "exact-groups",
    )


def group_members(rows: DataFrame, keep: str) -> DataFrame:
    """``rows (ROW, id, text)`` as ``(ROW, id, hash, text_sha256, keep_id, keep_row, group_size)``."""
    rows = rows.withColumn("hash", F.unhex(F.md5("text")))
    groups = shared_groups(rows, keep)
    members = rows.select(ROW, "id", "hash", F.sha2("text", 256).alias("text_sha256"))
    key = ["hash", "text_sha256"]
    found = lookup_join(members, groups, key, groups.select(*key, F.col("group_size").alias("n")), F.col(ROW), "left")
    own = {"keep_id": "id", "keep_row": ROW, "group_size": F.lit(1).cast("bigint")}
    alone = F.col("group_size").isNull()
    return found.withColumns(
        {name: F.when(alone, F.col(other) if isinstance(other, str) else other).otherwise(F.col(name)) for name, other in own.items()}
    )


def drop_exact_copies(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    rows = numbered(documents, "exact-rows")
    members = group_members(texts(rows, id_column, text_column, F.col(ROW)), keep)
    gone = materialize(members.filter(F.col(ROW) != F.col("keep_row")).select(ROW), "exact-copies")
    return unnumbered(without_rows(rows, gone), documents.columns)
