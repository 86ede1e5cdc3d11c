"""Text variants: which normalization steps, which case, which tokenizer, which n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions import patterns as P
from flipside.functions.normalize import rewritten
from flipside.functions.terms import term_counts, tokens, with_bigrams


@dataclass(frozen=True)
class TextVariant:
    label: str
    steps: tuple[str, ...] = ()
    preserve_case: bool = False
    pattern: str = P.TOKEN
    bigrams: bool = False

    def words(self, text: Column) -> Column:
        """The variant's terms. Tokens hold no whitespace, so collapsing it would not change them."""
        return self.terms(rewritten(text, *self.steps))

    def terms(self, text: Column) -> Column:
        """The terms of a text that the steps have been applied to."""
        found = tokens(text, self.pattern, lowercase=not self.preserve_case)
        return with_bigrams(found) if self.bigrams else found

    @property
    def tokenizer(self) -> tuple:
        return self.preserve_case, self.pattern, self.bigrams


BASELINE = TextVariant("baseline_no_cleaning")
STRIP_URLS = TextVariant("strip_urls", ("strip_urls",))

# One change at a time from the baseline.
NORMALIZATION_VARIANTS = (
    BASELINE,
    STRIP_URLS,
    TextVariant("strip_mentions", ("strip_mentions",)),
    TextVariant("strip_hashtag_symbol", ("strip_hashtag_symbol",)),
    TextVariant("unescape_html", ("unescape_html",)),
    TextVariant("strip_emoji", ("strip_emoji",)),
    TextVariant("preserve_case", preserve_case=True),
)

TOKENIZER_VARIANTS = (
    TextVariant("default_tokenizer", ("strip_urls",)),
    TextVariant("punct_preserving_tokenizer", ("strip_urls",), pattern=P.TOKEN_OR_PUNCTUATION),
)

NGRAM_VARIANTS = (TextVariant("1-1"), TextVariant("1-2", bigrams=True))


def count_variants(documents: DataFrame, variants: Sequence[TextVariant]) -> DataFrame:
    """Each document once per variant: ``variant, id, target, split, counts``, from one scan.

    A text is tokenized and counted once per tokenizer; a variant whose steps leave it as it is
    takes over these counts.
    """
    tokenizers = list(dict.fromkeys(v.tokenizer for v in variants))
    first = {v.tokenizer: v for v in reversed(variants)}
    prepared = documents.select(
        "id",
        "target",
        "split",
        "text",
        *[term_counts(first[t].terms(F.col("text"))).alias(f"plain{i}") for i, t in enumerate(tokenizers)],
        *[rewritten(F.col("text"), *v.steps).alias(f"text{i}") for i, v in enumerate(variants) if v.steps],
    )
    counted = []
    for i, v in enumerate(variants):
        counts = F.col(f"plain{tokenizers.index(v.tokenizer)}")
        if v.steps:
            own = F.col(f"text{i}")
            counts = F.when(own == F.col("text"), counts).otherwise(term_counts(v.terms(own)))
        counted.append(F.struct(F.lit(v.label).alias("variant"), counts.alias("counts")))
    return prepared.select("id", "target", "split", F.inline_outer(F.array(*counted)))


def variant_table(documents: DataFrame, variants: Sequence[TextVariant]) -> DataFrame:
    """The variants' parameters as rows, in order."""
    rows = [(i, v.label, ",".join(v.steps), v.preserve_case, v.pattern) for i, v in enumerate(variants)]
    return documents.sparkSession.createDataFrame(
        rows, "position bigint, variant string, normalize_steps string, preserve_case boolean, token_pattern string"
    )
