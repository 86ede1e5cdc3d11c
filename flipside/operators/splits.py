"""Split tables ``(id, split, pos)``: making, applying and checking them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The documented seed and the 60/20/20 split as cumulative percentages.
SEED = 3102
CUTS = (("train", 60), ("dev", 80), ("heldout", 100))

# Rows that are ranked in one task to find a cut.
BUCKET_ROWS = 1 << 16


class SplitError(ValueError):
    """A split list does not fit the corpus."""


def order_key(id_column: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_column.cast("string")))


def _cut_rows(rows: DataFrame, cuts: Sequence[tuple[str, int]]) -> DataFrame:
    """The last row of each split but the final one: ``(target, split, pos, id)``.

    Rows are counted per class and leading hash digits first, with as many digits as make buckets
    of at most about BUCKET_ROWS. Only buckets that hold a cut are ranked row by row, so no class
    is ever sorted in one task.
    """
    n, digits = rows.count(), 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    bucketed = rows.withColumn("bucket", F.substring("pos", 1, digits))
    by_class = W.partitionBy("target")
    buckets = (
        bucketed.groupBy("target", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(by_class.orderBy("bucket")))
        .withColumn("total", F.sum("n").over(by_class))
    )
    wanted = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(p).alias("pct")) for s, p in cuts[:-1]])
    cut_buckets = (
        buckets.select("*", F.inline(wanted))
        .withColumn("rank", F.floor(F.col("total") * F.col("pct") / 100))
        .filter((F.col("upto") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
        .select("target", "bucket", "split", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )
    within = W.partitionBy("target", "bucket", "split").orderBy("pos", "id")
    # One row per class and cut.
    return (
        bucketed.join(F.broadcast(cut_buckets), ["target", "bucket"])
        .withColumn("at", F.row_number().over(within))
        .filter(F.col("at") == F.col("rank"))
    )


@dataclass(frozen=True)
class SplitRule:
    """A fitted split: per class and split the last row, as ``(target, split, pos, id)``."""

    seed: int
    cuts: tuple[tuple[str, int], ...]
    last_rows: tuple[tuple[int, str, str, int], ...]

    def assign(self, rows: DataFrame) -> DataFrame:
        """Add ``pos`` and ``split``. Every row decides from its own hash: no join, no shuffle."""
        at = F.struct("pos", "id")
        split = F.when(F.lit(False), F.lit(""))
        for name, _ in self.cuts[:-1]:
            for target, of, pos, row_id in self.last_rows:
                if of == name:
                    last = F.struct(F.lit(pos), F.lit(row_id).cast("bigint"))
                    split = split.when((F.col("target") == target) & (at <= last), F.lit(name))
        return rows.withColumn("pos", order_key(F.col("id"), self.seed)).withColumn(
            "split", split.otherwise(F.lit(self.cuts[-1][0]))
        )


def fit_split(rows: DataFrame, seed: int = SEED, cuts: Sequence[tuple[str, int]] = CUTS) -> SplitRule:
    """Order each class by the md5 of seed and id and find where the given percentages of it,
    rounded down, end. Reads only ``id`` and ``target``; one row per class and cut comes back."""
    keyed = rows.select("id", "target", order_key(F.col("id"), seed).alias("pos"))
    last = _cut_rows(keyed, cuts).select("target", "split", "pos", "id").collect()
    return SplitRule(seed, tuple(cuts), tuple(tuple(r) for r in last))


def stratified_split(
    rows: DataFrame, seed: int = SEED, cuts: Sequence[tuple[str, int]] = CUTS
) -> DataFrame:
    return fit_split(rows, seed, cuts).assign(rows)


def missing_ids(corpus: DataFrame, splits: DataFrame) -> DataFrame:
    return splits.join(corpus.select("id"), "id", "left_anti")


def tag_split(corpus: DataFrame, splits: DataFrame) -> DataFrame:
    """Every corpus row with its split and list position; NULL where no list names it."""
    return corpus.join(splits.select("id", "split", "pos"), "id", "left")


def select_split(
    corpus: DataFrame, splits: DataFrame, name: str, strict: bool = True
) -> DataFrame:
    """The rows of one split with their list position in ``pos``.

    Raises SplitError when a listed id is not in the corpus. Order by ``pos`` where list order
    matters; the rows themselves stay distributed.
    """
    listed = splits.filter(F.col("split") == name)
    if strict:
        absent = missing_ids(corpus, listed).select("id").limit(5).collect()
        if absent:
            raise SplitError(f"{name}: ids not in the corpus, such as {[r.id for r in absent]}")
    return corpus.join(listed.select("id", "split", "pos"), "id")


def split_coverage(corpus: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: corpus size, ids in no split, ids listed more than once, listed ids not found."""
    listed = splits.groupBy("id").agg(F.count("*").alias("listings"))
    both = corpus.select("id", F.lit(1).alias("in_corpus")).join(listed, "id", "full")
    return both.agg(
        F.count_if(F.col("in_corpus").isNotNull()).alias("n_rows"),
        F.count_if(F.col("in_corpus").isNotNull() & F.col("listings").isNull()).alias("n_unassigned"),
        F.count_if(F.col("listings") > 1).alias("n_listed_twice"),
        F.count_if(F.col("in_corpus").isNull()).alias("n_unknown"),
    )


def require_coverage(corpus: DataFrame, splits: DataFrame) -> None:
    """Raise SplitError unless the splits are disjoint, known and cover every row."""
    found = split_coverage(corpus, splits).first()
    if found.n_unassigned or found.n_listed_twice or found.n_unknown:
        raise SplitError(f"splits do not partition the corpus: {found.asDict()}")


def split_balance(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("target") == 1).alias("n_positive"),
        F.count_if(F.col("target") == 0).alias("n_negative"),
    )


@dataclass(frozen=True)
class FrozenDecision:
    """What was decided on dev. Held-out rows may be scored only under one of these."""

    ticket: str
    model_name: str
    decision: str
    reason: str
    threshold: float | None = None


def open_splits(
    rows: DataFrame,
    splits: Sequence[str],
    frozen: FrozenDecision | None = None,
    diagnostic: bool = False,
) -> DataFrame:
    """Rows of the named splits. Held-out rows need a frozen decision, or ``diagnostic=True`` for
    audits that choose nothing."""
    if "heldout" in splits and frozen is None and not diagnostic:
        raise SplitError("held-out rows may be scored only for a frozen decision")
    return rows.filter(F.col("split").isin(*splits))
