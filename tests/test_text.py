"""Column functions against Python's own Unicode-aware regular expressions."""

import html
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from flipside.functions import normalize as N
from flipside.functions import patterns as P
from flipside.functions import surface as S
from flipside.functions.references import unescape
from flipside.functions.rounding import round_half_even
from flipside.functions.terms import term_counts, tokens, with_bigrams

EMOJI = re.compile(re.sub(r"\\x\{(\w+)\}", lambda code: chr(int(code[1], 16)), P.EMOJI))

STRINGS = [
    "",
    "   ",
    "a@b.com wrote @bob_1 and @",
    "&#64;bob &amp;amp; &quot;x&quot; &notanentity; &copy2 &#x1F600; AT&T",
    "a # b ## #tag#tag2 foo#bar #é #_",
    "HTTP://X http https://t.co/a b xwww.y www. www.z end",
    "tabs\tand\nlines\r\n\x0b\x1c\x85 nbsp\u00a0\u2028x\u3000",
    "été x²y １２ 你好世界 ١٢",
    "\U0001f600\U0001f680 ok ☀❤ \U0001f1e9\U0001f1ea fin ❶❷",
    "!!!? what?! A!",
    "ABC_ AB cd EF9 GH-IJ ÉÉ ⅠⅡ Ⓐ",
    "Mixed CASE Text, text; TEXT text a",
    "no letters 123 456",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "id int, text string")


def column(rows, expression):
    return [r.v for r in rows.select("id", expression.alias("v")).orderBy("id").collect()]


# What each step makes of a text, written out by hand.
EXPECTED = {
    "unescape_html": {
        "a@b.com wrote @bob_1 and @": "a@b.com wrote @bob_1 and @",
        "&#64;bob &amp;amp; &quot;x&quot; &notanentity; &copy2 &#x1F600; AT&T": '@bob &amp; "x" ¬anentity; ©2 \U0001f600 AT&T',
    },
    "strip_urls": {
        STRINGS[5]: "HTTP://X http b x www. end",
        "a # b ## #tag#tag2 foo#bar #é #_": "a # b ## #tag#tag2 foo#bar #é #_",
    },
    "strip_mentions": {
        "a@b.com wrote @bob_1 and @": "a .com wrote and @",
        "&#64;bob &amp;amp; &quot;x&quot; &notanentity; &copy2 &#x1F600; AT&T": (
            "&#64;bob &amp;amp; &quot;x&quot; &notanentity; &copy2 &#x1F600; AT&T"
        ),
    },
    "strip_hashtag_symbol": {"a # b ## #tag#tag2 foo#bar #é #_": "a # b ## tagtag2 foobar é _"},
    "strip_emoji": {"\U0001f600\U0001f680 ok ☀❤ \U0001f1e9\U0001f1ea fin ❶❷": "ok fin"},
}
ALL_STEPS = {
    "&#64;bob &amp;amp; &quot;x&quot; &notanentity; &copy2 &#x1F600; AT&T": '&amp; "x" ¬anentity; ©2 AT&T',
    STRINGS[5]: "HTTP://X http b x www. end",
    "tabs\tand\nlines\r\n\x0b\x1c\x85 nbsp\u00a0\u2028x\u3000": "tabs and lines nbsp x",
    "a # b ## #tag#tag2 foo#bar #é #_": "a # b ## tagtag2 foobar é _",
    "   ": "",
}


@pytest.mark.parametrize("step", N.STEP_ORDER)
def test_each_step(rows, step):
    found = dict(zip(STRINGS, column(rows, N.normalize(F.col("text"), step)), strict=True))
    assert {text: found[text] for text in EXPECTED[step]} == EXPECTED[step]


@pytest.mark.parametrize("steps", [N.STEP_ORDER, N.STEP_ORDER[::-1]])
def test_all_steps_in_any_order(rows, steps):
    found = dict(zip(STRINGS, column(rows, N.normalize(F.col("text"), *steps)), strict=True))
    assert {text: found[text] for text in ALL_STEPS} == ALL_STEPS


REFERENCES = [
    "&#0;|&#x0;|&#13;|&#128;|&#x80;|&#129;|&#159;|&#55296;|&#xDFFF;|&#1114111;|&#1114112;|&#99999999999999;|&#00000065;",
    "&#1;|&#11;|&#12;|&#31;|&#127;|&#64976;|&#65534;|&#x1FFFF;|&#X41|&#65|&#x;|&#;|&#xZZ;|&;|& a|&",
    "&lt|&ltx;|&LT;|&amp|&ampamp;|&notit;|&notin;|&notin|&copy2|&frac12x|&NotEqualTilde;|&fjlig;|&hellip|&hellip;",
    "&amp;lt;|&amp;amp;amp;|&&amp;&|&thisnameislongerthananyofthenamesinthetable;|&nbsp;|&Aacute&aacute;",
    "no reference at all", "", "\U0001f600&#x1F600;&copy;\u00e9",
]


def test_references_match_the_standard_library(spark):
    frame = spark.createDataFrame(list(enumerate(REFERENCES)), "id int, text string")
    assert column(frame, unescape(F.col("text"))) == [html.unescape(text) for text in REFERENCES]


def test_every_name_is_decoded(spark):
    names = sorted(html5)
    frame = spark.createDataFrame([(i, f"a&{name} &{name}=") for i, name in enumerate(names)], "id int, text string")
    assert column(frame, unescape(F.col("text"))) == [html.unescape(f"a&{name} &{name}=") for name in names]


def test_no_step_is_the_same_column():
    text = F.col("text")
    assert N.normalize(text) is text


def test_unknown_step():
    with pytest.raises(ValueError):
        N.normalize(F.col("text"), "strip_everything")


def test_decoded_entities_feed_later_steps(spark):
    row = spark.createDataFrame([("x &#64;bob y",)], "text string")
    assert row.select(N.normalize(F.col("text"), "unescape_html", "strip_mentions")).first()[0] == "x y"


def test_null_text_stays_null(spark):
    row = spark.createDataFrame([(None,)], "text string")
    assert row.select(N.normalize(F.col("text"), *N.STEP_ORDER)).first()[0] is None


def test_known_entities_decode_once(spark):
    row = spark.createDataFrame([("&amp;quot; &quot;",)], "text string")
    decoded = N.unescape_entities(F.col("text"), {"&amp;": "&", "&quot;": '"'})
    assert row.select(decoded).first()[0] == '&quot; "'


def test_dedup_key_and_snippet(rows):
    want = [re.sub(r"\s+", " ", t.strip().lower()) for t in STRINGS]
    assert column(rows, N.dedup_key(F.col("text"))) == want
    cut = [t[:10] + ("..." if len(t) > 10 else "") for t in STRINGS]
    assert column(rows, N.snippet(F.col("text"), 10)) == cut


def test_flags_match_python(rows):
    want = {
        "has_url": r"https?://\S+|www\.\S+",
        "has_mention": r"@\w+",
        "has_hashtag": r"#(\w+)",
        "has_emoji": EMOJI.pattern,
        "has_exclamation": "!",
        "has_allcaps_word": r"\b[A-Z]{2,}\b",
        "has_digit": r"\d",
    }
    for name, flag in S.surface_flags(F.col("text")).items():
        assert column(rows, flag) == [bool(re.search(want[name], t)) for t in STRINGS], name


def test_shortcut_numbers_match_python(rows):
    got = S.shortcut_columns(F.col("text"), F.lit("x"))
    assert column(rows, got["char_len"]) == [len(t) for t in STRINGS]
    assert column(rows, got["has_http"]) == [int("http" in t.lower()) for t in STRINGS]
    assert column(rows, got["n_hashtags"]) == [len(re.findall(r"#\w+", t)) for t in STRINGS]
    upper = [sum(c.isupper() for c in t) for t in STRINGS]
    letters = [sum(c.isalpha() for c in t) for t in STRINGS]
    assert column(rows, got["frac_upper"]) == pytest.approx([u / n if n else 0.0 for u, n in zip(upper, letters)])


def test_has_location(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "  "), (3, " Oslo ")], "id int, location string")
    assert column(rows, S.shortcut_columns(F.lit("x"), F.col("location"))["has_location"]) == [0, 0, 0, 1]


def test_length_bins_are_right_closed(spark):
    rows = spark.createDataFrame([(n, n) for n in (0, 1, 40, 41, 80, 120, 121, 160, 161)], "id int, n int")
    assert column(rows, S.length_bin(F.col("n"))) == [
        "0-40", "0-40", "0-40", "41-80", "41-80", "81-120", "121-160", "121-160", None,
    ]


@pytest.mark.parametrize(
    ("ours", "python"), [(P.TOKEN, r"(?u)\b\w\w+\b"), (P.TOKEN_OR_PUNCTUATION, r"(?u)\b\w\w+\b|[!?]")]
)
def test_tokens_match_python(rows, ours, python):
    # A combining accent is no word character for either side.
    assert column(rows, tokens(F.col("text"), ours)) == [re.findall(python, t.lower()) for t in STRINGS]


def test_counts_and_bigrams(rows):
    counted = column(rows, term_counts(with_bigrams(tokens(F.col("text")))))
    for text, got in zip(STRINGS, counted):
        words = re.findall(r"(?u)\b\w\w+\b", text.lower())
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        assert {e.term: e.tf for e in got or []} == {g: grams.count(g) for g in grams}
        assert len(got or []) == len(set(grams))


def test_rounding_equals_python_on_a_million_values(spark):
    """Ties in decimal, ties in binary, signs, and values of any size."""
    kind = F.pmod(F.col("id"), F.lit(5))
    tie = (F.floor(F.col("id") / 5) + 0.5) / 10000.0
    value = (
        F.when(kind == 0, tie)
        .when(kind == 1, -tie / 7.0)
        .when(kind == 2, F.rand(1))
        .when(kind == 3, F.floor(F.rand(2) * 100000) / F.lit(2.0 ** 17))
        .otherwise(F.randn(3) * 1000)
    )
    rows = spark.range(1_000_000).select(value.alias("x"))
    found = rows.select("x", *[round_half_even(F.col("x"), d).alias(f"d{d}") for d in (0, 2, 4, 9)]).toPandas()
    for digits in (0, 2, 4, 9):
        assert found[f"d{digits}"].tolist() == [round(x, digits) for x in found["x"].tolist()]


def test_rounding_of_values_without_digits(spark):
    values = [2.675, 0.5, 1.5, -0.5, 2.0**60, float("inf"), None]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select(round_half_even(F.col("x"), 0).alias("r"), round_half_even(F.col("x"), 2).alias("s"))
    assert [tuple(r) for r in rows.collect()] == [(3.0, 2.67), (0.0, 0.5), (2.0, 1.5), (0.0, -0.5), (2.0**60, 2.0**60), (float("inf"),) * 2, (None, None)]
