"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup table is broadcast only if its measured size is below this.
BROADCAST_BYTES = 64 << 20

# A key with more rows than this is hot and is cut into pieces of about this many rows.
TARGET_ROWS = 1 << 17


def measured_bytes(table: DataFrame) -> int:
    """Size of a table's values: 16 bytes per field, the length of strings and binaries, and that of
    an array's, map's or structure's JSON, which no plain value exceeds by much."""
    per_row = F.lit(16 * len(table.columns))
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            per_row = per_row + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            per_row = per_row + F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return table.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0))).first()[0]


def fits_broadcast(table: DataFrame) -> bool:
    return measured_bytes(table) <= BROADCAST_BYTES


def hot_pieces(key_counts: DataFrame, on: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Keys of more than ``target_rows`` rows and the pieces each is cut into."""
    return key_counts.filter(F.col("n") > target_rows).select(
        *on, F.ceil(F.col("n") / target_rows).alias("__pieces")
    )


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    key_counts: DataFrame,
    spread: Column,
    how: str = "inner",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Shuffle join that cuts each hot key into pieces of about ``target_rows`` rows.

    ``key_counts`` holds the ``on`` columns and ``n``, the number of fact rows of each key. Fact
    rows of a hot key pick a piece by hashing ``spread``; the lookup row of that key is repeated
    once per piece. A piece is as large whatever the size of the data, so the list of hot keys
    grows with it: it is broadcast only if its measured size allows.
    """
    on = list(on)
    pieces = hot_pieces(key_counts, on, target_rows)
    if fits_broadcast(pieces):
        pieces = F.broadcast(pieces)
    pieces_or_one = F.coalesce("__pieces", F.lit(1))
    salted_facts = facts.join(pieces, on, "left").withColumn(
        "__piece", F.pmod(F.xxhash64(spread), pieces_or_one)
    )
    repeated = (
        lookup.join(pieces, on, "left")
        .withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces_or_one - 1)))
        .drop("__pieces")
    )
    joined = salted_facts.join(repeated, [*on, "__piece"], how)
    return joined.drop("__piece", "__pieces")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    key_counts: DataFrame,
    spread: Column,
    how: str = "inner",
    source: DataFrame | None = None,
) -> DataFrame:
    """Broadcast ``lookup`` if its measured size allows, else run the salted shuffle join.

    ``source`` names the written table ``lookup`` is computed from, row by row, and is measured
    in its place.
    """
    if fits_broadcast(lookup if source is None else source):
        return facts.join(F.broadcast(lookup), list(on), how)
    return salted_join(facts, lookup, on, key_counts, spread, how)
