"""Shallow features of a text: presence flags, length bins and shortcut numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipside.functions import patterns as P

# Right-closed upper edges of the character-length bins.
LENGTH_EDGES = (0, 40, 80, 120, 160)

SHORTCUT_COLUMNS = ("char_len", "has_http", "n_hashtags", "frac_upper", "has_location")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def surface_flags(text: Column) -> dict[str, Column]:
    return {
        "has_url": matches(text, P.URL),
        "has_mention": matches(text, P.MENTION),
        "has_hashtag": matches(text, P.HASHTAG),
        "has_emoji": matches(text, P.EMOJI),
        "has_exclamation": F.contains(text, F.lit("!")),
        "has_allcaps_word": matches(text, P.ALL_CAPS_WORD),
        "has_digit": matches(text, P.DIGIT),
    }


def length_labels(edges: Sequence[int] = LENGTH_EDGES) -> list[str]:
    """Bin names in order: the first bin shows its lowest edge, the others start one above."""
    return [
        f"{low if i == 0 else low + 1}-{high}"
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]


def length_bin(length: Column, edges: Sequence[int] = LENGTH_EDGES) -> Column:
    """Right-closed bins, lowest edge included. A length outside the edges is in no bin."""
    bins = F.when(length < edges[0], F.lit(None).cast("string"))
    for label, high in zip(length_labels(edges), edges[1:]):
        bins = bins.when(length <= high, F.lit(label))
    return bins


def shortcut_columns(text: Column, location: Column) -> dict[str, Column]:
    """Numeric shortcuts. ``has_http`` is the plain substring test, ``has_url`` above the pattern."""
    letters = F.regexp_count(text, F.lit(P.LETTER))
    upper = F.regexp_count(text, F.lit(P.UPPER))
    return {
        "char_len": F.length(text),
        "has_http": F.contains(F.lower(text), F.lit("http")).cast("int"),
        "n_hashtags": F.regexp_count(text, F.lit(P.HASHTAG)),
        "frac_upper": F.when(letters > 0, upper / letters).otherwise(F.lit(0.0)),
        "has_location": F.coalesce(
            F.regexp_replace(location, P.SPACES, "") != "", F.lit(False)
        ).cast("int"),
    }
