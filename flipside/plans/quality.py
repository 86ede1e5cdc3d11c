"""Investigation 5: which labels are wrong or contradict each other?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.functions.normalize import dedup_key
from flipside.operators.audit import (
    audit_table,
    conflict_members,
    duplicate_conflicts,
    likely_mislabels,
    text_groups,
)
from flipside.operators.linear import Candidate
from flipside.plans.decision import linear_scores

AUDIT_MODEL = Candidate("LR(C=3)", 3.0)


def document_lines(documents: DataFrame) -> DataFrame:
    """The corpus at line grain: each distinct non-blank line of a document, under the document's
    id, label and split."""
    keys = F.array_distinct(F.transform(F.split("text", "\n"), dedup_key))
    return (
        documents.select("id", "target", "split", F.explode_outer(keys).alias("dedup_key"))
        .filter(F.col("dedup_key") != "")
        .transform(lambda lines: text_groups(lines, F.col("dedup_key")))
    )


def with_keyword(scores: DataFrame, documents: DataFrame) -> DataFrame:
    return scores.join(documents.select("id", "keyword"), "id")


def audit(documents: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Duplicate conflicts over all splits and model disagreements on train and dev."""
    if scores is None:
        scores = linear_scores(documents, (AUDIT_MODEL,))
    known = scores.filter(F.col("split") != "heldout")
    return audit_table(
        duplicate_conflicts(conflict_members(text_groups(documents))),
        likely_mislabels(with_keyword(known, documents)),
    )
