"""Tokens, n-grams and per-document term counts, all computed inside the document's own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipside.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, pattern: str = P.TOKEN, lowercase: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(pattern), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """The tokens followed by every pair of neighbours, joined by one space."""

    def add_pairs(w: Column) -> Column:
        following = F.slice(w, F.lit(2), F.size(w))
        pairs = F.zip_with(w, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, F.array_compact(pairs))

    return let(words, add_pairs)


def term_counts(words: Column) -> Column:
    """array<struct<term, tf>> of one document.

    Sorts the tokens and measures the runs, so that counting within a document needs no shuffle:
    a document never spans rows.
    """

    def runs(ordered: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(
            positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, i: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(s, i + 1), F.size(ordered)) - start)
                    .cast("bigint")
                    .alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)))
