"""Columns that read a JSON text strictly: the whole text must be exactly one JSON value.

Spark's JSON functions accept a valid prefix and ignore what follows it, so ``{} x`` passes.
Each text is therefore parsed once as the first element of ``[<text>,<END_MARK>]``. If the mark
comes back as the second element, the parser has read through the whole text and found one
value in it. A text can only imitate this by spelling the mark itself:

* As digits: such a text takes the second test below.
* As a string with escapes: ``holds_one_value`` refuses a string.
* As a floating-point number: the mark is odd and above 2**53, so no double equals it.

A text that holds the mark's digits must also parse in ``{"r":<text>}``. After its first value
an array goes on with a value or ``]`` and an object with a name or ``}``, so a text that is
more than one value cannot satisfy both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**53 + 1.
END_MARK = "9007199254740993"

# The parser takes numbers of up to 1,000 characters. A longer run of digits is cut to this many
# before it is parsed: whole part, fraction and exponent then stay below the limit together, a
# number stays one and a leading zero stays wrong. No name or word of a contract has such a run.
MAX_DIGITS = 300
# Beyond these the parser refuses text that may be JSON: 1,000 levels, names of 50,000
# characters. Its limits on strings (20 million) and whole values (128 MiB) are far above. Such
# text gets its verdict from ``token_fold``.
MAX_LEVELS = 1_000
MAX_NAME = 50_000


def _parse(text: Column) -> Column:
    run = f"([0-9]{{{MAX_DIGITS}}})[0-9]+"
    # A shorter text cannot hold such a run, and is not searched.
    long_run = (F.octet_length(text) > MAX_DIGITS) & text.rlike(run)
    return F.try_parse_json(F.when(long_run, F.regexp_replace(text, run, "$1")).otherwise(text))


def may_exceed_limits(text: Column) -> Column:
    """Whether a refused text may be JSON that the parser has limits against.

    All that it refuses for its limits is among these texts: objects, arrays and strings of more
    than ``MAX_NAME`` bytes, and objects and arrays with more than ``MAX_LEVELS`` brackets.
    """
    space = F.lit(" \t\n\r")
    begins, ends = F.ltrim(text, space), F.rtrim(text, space)
    nests = (begins.startswith("{") & ends.endswith("}")) | (begins.startswith("[") & ends.endswith("]"))
    whole = nests | (begins.startswith('"') & ends.endswith('"'))
    # Not by translate, which takes many times as long.
    levels = F.length(text) - F.length(F.regexp_replace(text, r"[\[{]++", ""))
    may = (whole & (F.octet_length(text) > MAX_NAME)) | (nests & (levels > MAX_LEVELS))
    return F.coalesce(may, F.lit(False))


def _may_be_json(text: Column) -> Column:
    """False for text that its first and last characters show not to be JSON.

    A refused text costs the parser an exception, many times the price of an accepted one. Cut
    off records and free text, the usual reasons, are mostly recognised here without.
    """
    first = F.substring(text, 1, 1)
    ends_in_space = text.endswith(" ") | text.endswith("\n") | text.endswith("\r") | text.endswith("\t")
    return (
        F.when(first == "{", text.endswith("}") | ends_in_space)
        .when(first == "[", text.endswith("]") | ends_in_space)
        .otherwise(first.isin(*'"-0123456789tfn \t\n\r'))
    )


def marked_document(text: Column) -> Column:
    """The text as first element of a variant array that ends in the mark, or NULL."""
    return F.when(_may_be_json(text), _parse(F.concat(F.lit("["), text, F.lit(f",{END_MARK}]"))))


def spells_mark_within_value(text: Column) -> Column:
    """The second test, for a text that holds the mark's digits; NULL for any other text."""
    return F.when(
        text.contains(END_MARK),
        _parse(F.concat(F.lit('{"r":'), text, F.lit("}"))).isNotNull(),
    )


def holds_one_value(document: Column, second_test: Column) -> Column:
    """Whether the text behind a marked document is one JSON value and nothing else."""
    mark_read = F.try_variant_get(document, "$[1]", "bigint") == F.lit(int(END_MARK))
    mark_is_string = F.try_variant_get(document, "$[1]", "binary").isNotNull()
    return F.coalesce(mark_read & ~mark_is_string & F.coalesce(second_test, F.lit(True)), F.lit(False))


def top_level_names(document: Column) -> Column:
    """Names of the object in a marked document; NULL if it is not an object.

    The empty struct as value type keeps the values unread: no payload is copied or converted,
    and a name whose value is JSON null is still listed.
    """
    return F.map_keys(F.try_variant_get(document, "$[0]", "map<string,struct<>>"))


def string_field(document: Column, name: str) -> Column:
    """The field's value if it is a JSON string, else NULL.

    Of all JSON types only a string converts to binary. A conversion to string would also take
    numbers and would render nested values, recursing once per level.
    """
    return F.try_variant_get(document, f"$[0]['{name}']", "binary").cast("string")


def opens_array(text: Column) -> Column:
    """Whether the first character after JSON white space is a bracket."""
    return F.ltrim(text, F.lit(" \t\n\r")).startswith("[")
