"""Label quality: copies with conflicting labels, confident disagreements, reviews, error floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.functions.normalize import dedup_key, snippet
from flipside.operators.joins import fits_broadcast, salted_join
from flipside.operators.ranking import with_places
from flipside.session import materialize

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("original_label", T.IntegerType()),
        T.StructField("proposed_label", T.IntegerType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("confidence", T.StringType()),
    ]
)

def text_groups(corpus: DataFrame, key: Column | None = None) -> DataFrame:
    """Corpus rows with the dedup key of their text and its digest ``group_key``.

    Rows are shuffled by the 32-byte digest, never by the text itself.
    """
    key = dedup_key(F.col("text")) if key is None else key
    return corpus.withColumn("dedup_key", key).withColumn(
        "group_key", F.unhex(F.sha2("dedup_key", 256))
    )


def label_groups(grouped: DataFrame) -> DataFrame:
    """Per group of copies: size, label counts and majority label (NULL on a tie).

    Only counters are aggregated, so that copies are folded in hash tables before the shuffle.
    """
    stats = grouped.groupBy("group_key").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("target") == 1).alias("n_pos"),
        F.count_if(F.col("target") == 0).alias("n_neg"),
    )
    majority = F.when(F.col("n_pos") > F.col("n_neg"), 1).when(F.col("n_pos") < F.col("n_neg"), 0)
    return stats.withColumn("majority_label", majority.cast("int"))


def conflicting(groups: DataFrame) -> DataFrame:
    return groups.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def conflict_members(grouped: DataFrame) -> DataFrame:
    """The rows of all groups of copies whose labels disagree, with their group's counts.

    ``grouped`` holds ``id, target, split, dedup_key, group_key``. It is written once, narrowed to
    what the findings show, and then read for the counts and for the rows. Few groups conflict, so
    only their counts are joined back.
    """
    narrow = grouped.select("id", "target", "split", "group_key", snippet(F.col("dedup_key")).alias("snippet"))
    narrow = materialize(narrow, "text-groups")
    groups = materialize(conflicting(label_groups(narrow)), "conflicts")
    key = ["group_key"]
    if fits_broadcast(groups):
        return narrow.join(F.broadcast(groups), key)
    return salted_join(narrow, groups, key, groups.select("group_key", "n"), F.col("id"))


def duplicate_conflicts(members: DataFrame) -> DataFrame:
    """An audit record for every row of ``conflict_members``.

    The evidence names the group by its digest and gives its counts; ``group_members`` lists who is
    in it. A held-out row is only flagged; a tied group is ambiguous; any other row is to be fixed
    to its group's majority.
    """
    evidence = F.format_string(
        "dup group key=%s rows=%d positives=%d text='%s'",
        F.hex("group_key"), F.col("n"), F.col("n_pos"), F.col("snippet"),
    )
    tie = F.col("majority_label").isNull()
    heldout = F.col("split") == "heldout"
    return members.select(
        "id",
        F.lit("duplicate_label_conflict").alias("issue_type"),
        evidence.alias("evidence"),
        F.col("target").alias("original_label"),
        F.when(~heldout, F.col("majority_label")).alias("proposed_label"),
        F.when(heldout, "keep_but_flag").when(tie, "ambiguous").otherwise("fix").alias("disposition"),
        F.when(tie, "low").otherwise("high").alias("confidence"),
    )


def group_members(members: DataFrame) -> DataFrame:
    """Who is in each conflicting group, in order: ``(group_key, place, id, label)`` per member.

    Members are placed by id from 1; those that share an id, by label. A group may be any share of
    the rows: it is ordered in ranges, not in one task.
    """
    named = members.select(F.hex("group_key").alias("group_key"), "id", F.col("target").alias("label"))
    placed = with_places(named, ["group_key"], ["id", "label"])
    return placed.select("group_key", "place", "id", "label")


def error_floor(grouped: DataFrame) -> DataFrame:
    """Errors no deterministic model can avoid: rows outside their group's larger label."""
    return conflicting(label_groups(grouped)).agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.least("n_pos", "n_neg")), F.lit(0)).alias("error_floor"),
    )


def likely_mislabels(
    scores: DataFrame,
    low: float = 0.10,
    high: float = 0.90,
    very_low: float = 0.05,
    very_high: float = 0.95,
    model: str = "LR(C=3)",
) -> DataFrame:
    """Train and dev rows whose label a model contradicts with confidence.

    ``scores`` holds ``id, y_true, split, score, keyword``. Held-out rows are never looked at, and
    a single model is no ground to propose a label.
    """
    negative = (F.col("y_true") == 0) & (F.col("score") > high)
    positive = (F.col("y_true") == 1) & (F.col("score") < low)
    evidence = F.format_string(
        "%s label=%d but p(target=1)=%.4f %s, keyword=%s, split=%s",
        F.lit(model),
        F.col("y_true"),
        F.col("score"),
        F.when(negative, f"> {high}").otherwise(f"< {low}"),
        F.coalesce("keyword", F.lit("(none)")),
        F.col("split"),
    )
    sure = (F.col("score") > very_high) | (F.col("score") < very_low)
    return scores.filter((F.col("split") != "heldout") & (negative | positive)).select(
        "id",
        F.lit("likely_mislabel").alias("issue_type"),
        evidence.alias("evidence"),
        F.col("y_true").alias("original_label"),
        F.lit(None).cast("int").alias("proposed_label"),
        F.lit("keep_but_flag").alias("disposition"),
        F.when(sure, "high").otherwise("medium").alias("confidence"),
    )


def audit_table(*findings: DataFrame) -> DataFrame:
    table = findings[0]
    for more in findings[1:]:
        table = table.unionByName(more)
    return table


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("issue_type", "disposition").agg(F.count("*").alias("n"))


def review_overlay(audit: DataFrame, reviews: DataFrame, rename_rejects: bool = True) -> DataFrame:
    """Apply verdicts ``(id, verdict, new_label)`` to the likely_mislabel rows.

    Verdicts are fix, ambiguous and reject_false_positive; only a fix proposes ``new_label``.
    ``rename_rejects`` also shows a reject under its own issue type, as the published table does.
    An id may have one verdict only; ``require_reviews_match`` names those that have more.
    """
    detector = F.col("issue_type") == "likely_mislabel"
    verdict = F.when(detector, F.col("verdict"))
    one_each = F.when(F.count("*") > 1, F.raise_error(F.lit("more than one verdict for an id")))
    verdicts = reviews.groupBy("id").agg(
        F.coalesce(one_each.cast("string"), F.max("verdict")).alias("verdict"), F.max("new_label").alias("new_label")
    )
    joined = audit.join(verdicts, "id", "left")
    renamed = F.when(verdict == "reject_false_positive", verdict).otherwise(F.col("issue_type"))
    return joined.select(
        "id",
        (renamed if rename_rejects else F.col("issue_type")).alias("issue_type"),
        "evidence",
        "original_label",
        F.when(verdict.isNull(), F.col("proposed_label"))
        .when(verdict == "fix", F.col("new_label"))
        .alias("proposed_label"),
        F.coalesce(verdict, "disposition").alias("disposition"),
        "confidence",
    )


def review_coverage(audit: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed ids that match no finding, and findings nobody reviewed."""
    found = audit.filter(F.col("issue_type") == "likely_mislabel").select("id")
    unmatched = reviews.join(found, "id", "left_anti").select("id", F.lit("no_such_finding").alias("problem"))
    unreviewed = found.join(reviews, "id", "left_anti").select("id", F.lit("not_reviewed").alias("problem"))
    return unmatched.unionByName(unreviewed)


def require_reviews_match(audit: DataFrame, reviews: DataFrame) -> None:
    twice = reviews.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one verdict for ids such as {[r.id for r in twice]}")
    lost = review_coverage(audit, reviews).filter(F.col("problem") == "no_such_finding").limit(5).collect()
    if lost:
        raise ValueError(f"reviewed ids without a finding, such as {[r.id for r in lost]}")


def relabel_overlay(corpus: DataFrame, audit: DataFrame) -> DataFrame:
    """Training labels with the audit's fixes next to the originals. Held-out labels never
    change; if several findings propose a label for one id, they must agree to be applied."""
    proposals = (
        audit.filter(F.col("proposed_label").isNotNull())
        .groupBy("id")
        .agg(F.min("proposed_label").alias("low"), F.max("proposed_label").alias("high"))
        .select("id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("proposed_label"))
    )
    joined = corpus.join(proposals, "id", "left")
    usable = F.when(F.col("split") != "heldout", F.col("proposed_label"))
    return joined.select(
        "id",
        "split",
        F.col("target").alias("original_label"),
        usable.alias("proposed_label"),
        F.coalesce(usable, "target").alias("target"),
    )
