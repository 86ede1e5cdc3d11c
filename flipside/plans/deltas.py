"""Text variants as signed differences from the first variant.

A document's terms are counted once, under the first variant; any other variant that counts it
differently adds the entries that differ, with the sign +1 for its own and -1 for the first one's. All
statistics are sums over entries, so those of a variant are the first one's plus its signed entries.

The Bayes score of a document is the mean of its tokens' log-odds, and a term's log-odds are a part of
its own, the difference of the logarithms of its counts, and a part that all terms of the variant share.
So the document's sum changes only by its signed entries and by terms of its own whose statistics the
variant has changed; a document with neither keeps the first variant's sums. What is written and joined
grows with the changed texts, not with the number of variants.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.normalize import rewritten
from flipside.functions.terms import term_counts
from flipside.operators.bayes import sigmoid
from flipside.operators.joins import lookup_join
from flipside.plans.variants import TextVariant
from flipside.session import materialize

COUNTS = "array<struct<term: string, tf: bigint>>"
# Not part of any term.
TAB = "\t"


def entry_texts(counts: Column) -> Column:
    """The entries as texts, as which they are told apart by hash."""
    return F.transform(counts, lambda e: F.concat(e["term"], F.lit(TAB), e["tf"].cast("string")))


def signed_entries(base: Column, other: Column) -> Column:
    """array<struct<sign, term, tf>> of what ``other`` counts differently from ``base``, both as entry texts."""

    def entries(sign: int, left: Column, right: Column) -> Column:
        return F.transform(
            F.array_except(left, right),
            lambda e: F.struct(
                F.lit(sign).alias("sign"),
                F.substring_index(e, TAB, 1).alias("term"),
                F.substring_index(e, TAB, -1).cast("bigint").alias("tf"),
            ),
        )

    return F.concat(entries(1, other, base), entries(-1, base, other))


def delta_counts(documents: DataFrame, variants: Sequence[TextVariant]) -> DataFrame:
    """Written ``(id, target, split, counts, deltas)``, a row per document: counts under the first variant,
    and per variant that differs its place and signed entries."""
    texts = documents.select(
        "id", "target", "split", *[rewritten(F.col("text"), *v.steps).alias(f"text{i}") for i, v in enumerate(variants)]
    )
    first = variants[0]
    counted = [F.coalesce(term_counts(first.terms(F.col("text0"))), F.array().cast(COUNTS)).alias("counts")]
    for i, v in enumerate(variants[1:], 1):
        counts = F.coalesce(term_counts(v.terms(F.col(f"text{i}"))), F.array().cast(COUNTS))
        if v.tokenizer == first.tokenizer:
            counts = F.when(F.col(f"text{i}") != F.col("text0"), counts)
        counted.append(counts.alias(f"counts{i}"))
    # A column that is used more than once is computed once, in a step of its own.
    several = texts.select("id", "target", "split", *counted)
    several = several.select(
        "id", "target", "split", "counts", entry_texts(F.col("counts")).alias("shown"),
        *[entry_texts(F.col(f"counts{i}")).alias(f"shown{i}") for i in range(1, len(variants))],
    )
    deltas = [
        F.struct(F.lit(i).alias("place"), signed_entries(F.col("shown"), F.col(f"shown{i}")).alias("entries"))
        for i in range(1, len(variants))
    ]
    changed = F.array().cast("array<struct<place: int, entries: array<struct<sign: int, term: string, tf: bigint>>>>")
    if deltas:
        changed = F.filter(F.array(*deltas), lambda d: F.size(d["entries"]) > 0)
    return materialize(several.select("id", "target", "split", "counts", changed.alias("deltas")), "delta-counts")


def _sums(rows: DataFrame, by: Sequence[str], sign: Column) -> DataFrame:
    """Signed sums per term: rows, and from train documents and tokens of either class."""
    train = F.col("split") == "train"
    tokens = lambda c: F.sum(F.when(train & (F.col("target") == c), sign * F.col("tf")).otherwise(0))
    return rows.groupBy(*by, "term").agg(
        F.count("*").alias("n"),
        F.sum(F.when(train, sign).otherwise(0)).alias("df"),
        tokens(0).alias("tokens_neg"),
        tokens(1).alias("tokens_pos"),
    )


def base_rows(counted: DataFrame) -> DataFrame:
    return counted.select("id", "target", "split", F.inline("counts"))


def delta_rows(counted: DataFrame) -> DataFrame:
    rows = counted.select("id", "target", "split", F.inline("deltas")).select("id", "target", "split", "place", F.inline("entries"))
    return rows.withColumn("sign", F.col("sign").cast("bigint"))


def own_part(known: Column, positive: Column, negative: Column, alpha: float) -> Column:
    """What a term's own counts add to its log-odds; 0 if the model does not know it."""
    return F.when(known, F.ln(positive + alpha) - F.ln(negative + alpha)).otherwise(0.0)


def delta_statistics(counted: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Written term statistics of the first variant, and of every (place, term) with signed entries.

    Both hold ``known`` and ``part`` of the term's log-odds; the second also ``was_known`` and ``was_part``, those
    of the first variant, and the changes ``d_df, d_tokens_neg, d_tokens_pos``.
    """
    terms = _sums(base_rows(counted), [], F.lit(1).cast("bigint"))
    known = F.col("df") > 0
    terms = terms.withColumns({"known": known, "part": own_part(known, F.col("tokens_pos"), F.col("tokens_neg"), alpha)})
    terms = materialize(terms, "base-terms")
    changes = _sums(delta_rows(counted), ["place"], F.col("sign"))
    renamed = changes.select("place", "term", "n", *[F.col(c).alias(f"d_{c}") for c in ("df", "tokens_neg", "tokens_pos")])
    joined = renamed.join(terms.drop("n"), "term", "left")
    now = {c: F.coalesce(c, F.lit(0)) + F.col(f"d_{c}") for c in ("df", "tokens_neg", "tokens_pos")}
    known = now["df"] > 0
    changed = joined.select(
        "place", "term", "n", "d_df", "d_tokens_neg", "d_tokens_pos",
        F.coalesce("known", F.lit(False)).alias("was_known"), F.coalesce("part", F.lit(0.0)).alias("was_part"),
        known.alias("known"), own_part(known, now["tokens_pos"], now["tokens_neg"], alpha).alias("part"),
    )
    return terms, materialize(changed, "changed-terms")


def variant_totals(
    terms: DataFrame, changed: DataFrame, variants: Sequence[TextVariant], alpha: float = 1.0
) -> DataFrame:
    """One row per variant: ``place, variant, vocab_size`` and ``shared``, the part common to its log-odds."""
    spark = terms.sparkSession
    whole = terms.filter("known").agg(
        F.sum("tokens_pos").alias("pos"), F.sum("tokens_neg").alias("neg"), F.count("*").alias("size")
    )
    moved = changed.groupBy("place").agg(
        F.sum("d_tokens_pos").alias("d_pos"),
        F.sum("d_tokens_neg").alias("d_neg"),
        F.sum(F.col("known").cast("bigint") - F.col("was_known").cast("bigint")).alias("d_size"),
    )
    listed = spark.createDataFrame([(i, v.label) for i, v in enumerate(variants)], "place int, variant string")
    # One row per variant, and a single row.
    rows = listed.join(F.broadcast(moved), "place", "left").crossJoin(F.broadcast(whole))
    now = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0)) for c in ("pos", "neg", "size")}
    shared = F.ln(now["neg"] + alpha * now["size"]) - F.ln(now["pos"] + alpha * now["size"])
    return rows.select("place", "variant", now["size"].alias("vocab_size"), F.when(now["size"] > 0, shared).otherwise(0.0).alias("shared"))


def delta_margins(counted: DataFrame, terms: DataFrame, changed: DataFrame) -> DataFrame:
    """Written ``(id, target, split, total, tokens, changes)``, a row per document: the sum of its known tokens'
    own parts and their number under the first variant, and what each variant that differs adds."""
    # A term has at most one change per variant.
    moved = changed.withColumns({"d_part": F.col("part") - F.col("was_part"), "d_known": F.col("known").cast("int") - F.col("was_known").cast("int")})
    moved = moved.filter("d_part != 0 OR d_known != 0").groupBy("term").agg(F.collect_list(F.struct("place", "d_part", "d_known")).alias("moved"))
    lookup = terms.select("term", "part", F.col("known").cast("int").alias("known")).join(moved, "term", "left")
    lookup = materialize(lookup, "term-parts")
    found = lookup_join(base_rows(counted), lookup, ["term"], terms.select("term", "n"), F.col("id"))
    start = F.array(F.struct(F.lit(0).alias("place"), F.col("part").alias("d_part"), F.col("known").alias("d_known")))
    each = found.select("id", "tf", F.inline(F.concat(start, F.coalesce("moved", F.array().cast("array<struct<place: int, d_part: double, d_known: int>>")))))
    added = each.select("id", "place", (F.col("tf") * F.col("d_part")).alias("part"), (F.col("tf") * F.col("d_known")).alias("known"))
    key = ["place", "term"]
    own = changed.select(*key, "part", F.col("known").cast("int").alias("known"))
    entered = lookup_join(delta_rows(counted), own, key, changed.select(*key, "n"), F.col("id"), source=changed)
    weight = F.col("sign") * F.col("tf")
    entered = entered.select("id", "place", (weight * F.col("part")).alias("part"), (weight * F.col("known")).alias("known"))
    sums = added.unionByName(entered).groupBy("id", "place").agg(F.sum("part").alias("part"), F.sum("known").alias("known"))
    per_document = sums.groupBy("id").agg(F.collect_list(F.struct("place", "part", "known")).alias("sums"))
    joined = counted.select("id", "target", "split").join(per_document, "id", "left")
    return materialize(joined.withColumn("sums", F.coalesce("sums", F.array().cast("array<struct<place: int, part: double, known: bigint>>"))), "margins")


def delta_scores(margins: DataFrame, totals: DataFrame) -> DataFrame:
    """``(variant, id, split, y_true, score)`` of every document and variant; 0.5 without known tokens."""
    # One row per variant.
    every = margins.crossJoin(F.broadcast(totals))
    add = lambda field, zero: F.aggregate(
        F.filter("sums", lambda s: (s["place"] == 0) | (s["place"] == F.col("place"))), F.lit(zero).cast("double" if field == "part" else "bigint"),
        lambda total, s: total + s[field],
    )
    summed = every.withColumns({"part": add("part", 0.0), "tokens": add("known", 0)})
    margin = F.when(F.col("tokens") > 0, F.col("part") / F.col("tokens") + F.col("shared")).otherwise(0.0)
    return summed.select("variant", "id", "split", F.col("target").alias("y_true"), sigmoid(margin).alias("score"))


def full_statistics(terms: DataFrame, changed: DataFrame, variants: Sequence[TextVariant]) -> DataFrame:
    """``(variant, term, df)`` of all variants' vocabularies."""
    parts = []
    for place, variant in enumerate(variants):
        own = changed.filter(F.col("place") == place).select("term", "d_df")
        joined = terms.select("term", "df").join(own, "term", "full")
        df = F.coalesce("df", F.lit(0)) + F.coalesce("d_df", F.lit(0))
        parts.append(joined.select(F.lit(variant.label).alias("variant"), "term", df.alias("df")))
    return reduce(DataFrame.unionByName, parts)
