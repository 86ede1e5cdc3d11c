"""HTML character references, decoded by Column expressions.

The names come from the standard library's table and reach the executors as one literal map.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipside.functions.terms import let

# A reference as HTML5 delimits it; the semicolon may be missing.
REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32}+;?)"
# Names that HTML5 also knows without a semicolon are at most this long; the shortest has two letters.
LONGEST_OPEN = max(len(name) for name in html5 if not name.endswith(";"))
SHORTEST_OPEN = min(len(name) for name in html5 if not name.endswith(";"))

REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
LAST_CODE = 0x10FFFF


def windows_character(code: int) -> str:
    """What a code between 0x80 and 0x9F stands for: the windows-1252 character, if there is one."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def name_map() -> Column:
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def is_never_a_character(code: Column) -> Column:
    """Controls and noncharacters, which a reference cannot produce."""
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159)
    return control | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(65536)) >= 65534)


def numeric_character(digits: Column, base: int) -> Column:
    """The character of a number; a number of more digits than any code has is out of range."""
    significant = F.regexp_replace(digits, "^0+", "")
    code = F.conv(significant, base, 10).cast("bigint")
    windows = F.from_json(
        F.lit(json.dumps({str(code): windows_character(code) for code in range(0x80, 0xA0)})), "map<string,string>"
    )
    return let(
        F.when(significant == "", F.lit(0)).when(F.length(significant) > 7, F.lit(LAST_CODE + 1)).otherwise(code),
        lambda n: F.when(n == 0, F.lit(REPLACEMENT))
        .when(n == 13, F.lit("\r"))
        .when(n.between(0x80, 0x9F), F.try_element_at(windows, n.cast("string")))
        .when(n.between(0xD800, 0xDFFF) | (n > LAST_CODE), F.lit(REPLACEMENT))
        .when(is_never_a_character(n), F.lit(""))
        .otherwise(character(n)),
    )


def named_character(name: Column) -> Column:
    """The whole name, or else the longest name that it begins with and that needs no semicolon."""
    names = name_map()
    choices = [F.try_element_at(names, name)]
    for size in range(LONGEST_OPEN, SHORTEST_OPEN - 1, -1):
        prefix = F.substring(name, 1, size)
        rest = F.substring(name, size + 1, 64)
        choices.append(F.when(F.length(name) > size, F.concat(F.try_element_at(names, prefix), rest)))
    return F.coalesce(*choices)


def decoded_reference(reference: Column) -> Column:
    body = F.substring(reference, 2, 1 << 20)
    digits = F.rtrim(body, F.lit(";"))
    return (
        F.when(F.lower(F.substring(body, 1, 2)) == "#x", numeric_character(F.substring(digits, 3, 1 << 20), 16))
        .when(F.substring(body, 1, 1) == "#", numeric_character(F.substring(digits, 2, 1 << 20), 10))
        .otherwise(F.coalesce(named_character(body), reference))
    )


def unescape(text: Column) -> Column:
    """Every named and numeric reference decoded once, as HTML5 does; texts without an ampersand
    are left alone."""
    between = F.split(text, REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = F.zip_with(
        between, found, lambda before, reference: F.concat(before, F.coalesce(decoded_reference(reference), F.lit("")))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(joined, "")).otherwise(text)
