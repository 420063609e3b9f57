r"""Read a JSON text of any depth, width and length, by rewriting it.

Spark's JSON parser has limits on nesting levels, lengths of names and strings, and sizes of
values. What it refuses only for these is read here with built-in functions that have none.
Regular expressions rewrite the whole text at once, so that a token costs nanoseconds; possessive
quantifiers keep them from recursing.

First the text becomes a shape of the characters ``{}[],pv``: ``p`` is a name with its colon, ``v``
any other value. Every later rewriting keeps a valid shape valid and an invalid one invalid:

* An object or array of nothing but ``v`` is a ``v``.
* A ``v`` beside another element of the same array, or a ``pv`` in an object, can go.
* What is left is peaks: a run of opening brackets, then one of closing brackets, with a separator
  before the next peak, ``,`` in an array and ``;`` (for ``,p``) in an object.

One fold over the peaks keeps the open brackets as a text. A chain of any depth is a single peak.

Of a valid object, the names that a contract asks for are looked for at all levels; a fold over
those found adds up the brackets between them and keeps what is at the top level.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordgauge.contract import Contract

# Tokens of RFC 8259.
_STRING = r'"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_STRINGS_END = rf'\A[^"]*+(?:{_STRING}[^"]*+)*+\z'
# Characters that no JSON text holds stand for a string and another scalar.
_TEXT, _SCALAR = "\x01", "\x02"

#: How often flat objects and arrays are taken for values before the rest is put in order.
_FLATTENED = 3
_FLAT = r"\{(?:pv(?:,pv)*+)?+\}|\[(?:v(?:,v)*+)?+\]"
_ORDERED = (
    # Beside an opening bracket.
    (r"\[(?:v,)++(?=[v\[{])", "["),
    (r"\{(?:pv,)++(?=p)", "{"),
    # Between closing brackets, and between a closing and an opening one.
    (r"(?<=[\]}])(?:,v)++(?=\])", ""),
    (r"(?<=[\]}])(?:,pv)++(?=\})", ""),
    (r"(?<=[\]}])(?:,v)*+,(?=[\[{])", ","),
    (r"(?<=[\]}])(?:,pv)*+,p(?=[\[{])", ";"),
    # The innermost, then objects that open; ``<`` is an object whose name was seen.
    (r"\[v\]", "[]"),
    (r"\{(?:pv)?+\}", "<}"),
    (r"\{p(?=[\[{<])", "<"),
)
_PEAK = r"[\[<]++[\]}]++"
_PEAKS = rf"\A{_PEAK}(?:[,;]{_PEAK})*+\z"

# Strings and names of a text that is known to be valid.
_VALID_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ESCAPED = r'[^"\\]*+(?:\\.[^"\\]*+)++'
_SPACE = r"[ \t\n\r]*+"


def _once(value: Column, use) -> Column:
    """``use(value)``, as an element, so that the value is made once."""
    return F.transform(F.array(value), use)[0]


def _shape(text: Column) -> Column:
    """The text as a shape; NULL if a token is none of JSON's."""

    def lettered(tokens: Column) -> Column:
        pairs = F.regexp_replace(F.regexp_replace(tokens, f"{_TEXT}:", "p"), f"[{_TEXT}{_SCALAR}]", "v")
        return F.when(tokens.rlike(rf"\A[{{}}\[\],:{_TEXT}{_SCALAR}]*+\z"), pairs)

    strings = F.regexp_replace(text, _STRING, _TEXT)
    tokens = F.regexp_replace(F.regexp_replace(strings, rf"{_NUMBER}|true|false|null", _SCALAR), r"[ \t\n\r]++", "")
    usable = text.rlike(_STRINGS_END) & ~text.rlike(f"[{_TEXT}{_SCALAR}]")
    return F.when(usable, _once(tokens, lettered))


def _closes(peaks: Column) -> Column:
    """Whether each closing bracket meets its opening one, and each separator its kind."""

    def step(opened: Column, peak: Column) -> Column:
        separated = F.when(peak.startswith(","), opened.endswith("[")).when(peak.startswith(";"), opened.endswith("<")).otherwise(True)
        higher = F.concat(opened, F.regexp_replace(peak, r"[,;\]}]++", ""))
        closing = F.reverse(F.regexp_replace(peak, r"[,;\[<]++", ""))
        closed = F.replace(F.replace(closing, F.lit("]"), F.lit("[")), F.lit("}"), F.lit("<"))
        left = _once(higher, lambda h: F.when(h.endswith(closed), F.substring(h, F.lit(1), F.length(h) - F.length(closed))))
        return F.when(separated, left)

    units = F.regexp_extract_all(peaks, F.lit(f"[,;]?+{_PEAK}"), F.lit(0))
    return F.coalesce(F.aggregate(units, F.lit(""), step) == "", F.lit(False))


def _is_json(text: Column) -> Column:
    def judged(shape: Column) -> Column:
        for pattern, instead in _ORDERED:
            shape = F.regexp_replace(shape, pattern, instead)
        return _once(shape, lambda s: F.when(s == "v", True).when(s.rlike(_PEAKS), _closes(s)).otherwise(False))

    shape = _shape(text)
    for _ in range(_FLATTENED):
        shape = F.regexp_replace(shape, _FLAT, "v")
    return F.coalesce(judged(shape), F.lit(False))


def _decoded(token: Column, longest: int) -> Column:
    """The text of a string token; NULL if it is longer than any that matters."""
    # An escape takes six characters at most for one of the text.
    short = F.length(token) <= 6 * longest + 2
    escaped = F.get_json_object(F.concat(F.lit('{"s":'), token, F.lit("}")), "$.s")
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(short, F.when(token.contains("\\"), escaped).otherwise(plain))


def _found(text: Column, contract: Contract) -> Column:
    """``names`` and ``word`` of a text that is a valid object."""
    known = [*dict.fromkeys((*contract.required, contract.vocab_field))]
    longest = max(map(len, (*known, *contract.vocab)))
    spelt = "|".join("".join(rf"\x{{{ord(c):x}}}" for c in name) for name in known)
    named = rf'"(?:{spelt}|{_ESCAPED})"{_SPACE}:{_SPACE}'
    # Other strings go, and with them their brackets.
    slim = F.regexp_replace(text, rf"(?s)({named}(?:{_VALID_STRING})?+)|{_VALID_STRING}", "$1")
    # Each name that may be meant, with what lies before it; the rest is not searched again and again.
    units = F.regexp_extract_all(slim, F.lit(rf'(?s)\G[^"]*+{named}(?:{_VALID_STRING})?+'), F.lit(0))

    def unit(u: Column) -> Column:
        before = F.regexp_extract(u, r'\A[^"]*+', 0)
        name = F.regexp_extract(u, rf'(?s)\A[^"]*+({_VALID_STRING})', 1)
        value = F.regexp_extract(u, rf'(?s)\A[^"]*+{_VALID_STRING}{_SPACE}:{_SPACE}({_VALID_STRING})?+', 1)
        opened, closed = (F.length(F.regexp_replace(before, b, "")) for b in (r"[\]}]++", r"[\[{]++"))
        return F.struct(
            (opened - closed).alias("rise"),
            _once(name, lambda n: _decoded(n, longest)).alias("name"),
            F.when(value != "", _decoded(value, longest)).alias("value"),
        )

    def step(state: Column, u: Column) -> Column:
        depth = state["depth"] + u["rise"]
        meant = (depth == 1) & F.coalesce(u["name"].isin(*known), F.lit(False))
        return F.struct(
            depth.alias("depth"),
            F.when(meant, F.array_union(state["names"], F.array(u["name"]))).otherwise(state["names"]).alias("names"),
            F.when(meant & (u["name"] == contract.vocab_field), u["value"]).otherwise(state["word"]).alias("word"),
        )

    start = F.struct(F.lit(0).alias("depth"), *(c.alias(n) for n, c in _nothing()))
    return F.aggregate(F.transform(units, unit), start, step, lambda end: F.struct(end["names"].alias("names"), end["word"].alias("word")))


def _nothing() -> list[tuple[str, Column]]:
    return [("names", F.array().cast("array<string>")), ("word", F.lit(None).cast("string"))]


def read_tokens(text: Column, contract: Contract) -> Column:
    """``is_json``, ``nests`` (it is an object or array), ``names`` (those of the contract that
    the object has) and ``word`` (the vocabulary field's last value, if a string)."""
    begins = F.ltrim(text, F.lit(" \t\n\r"))

    def read(is_json: Column) -> Column:
        empty = F.struct(*(c.alias(n) for n, c in _nothing()))
        found = F.when(is_json & begins.startswith("{"), _found(text, contract)).otherwise(empty)
        return _once(
            found,
            lambda f: F.struct(
                is_json.alias("is_json"),
                F.coalesce(begins.startswith("{") | begins.startswith("["), F.lit(False)).alias("nests"),
                f["names"].alias("names"),
                f["word"].alias("word"),
            ),
        )

    return _once(_is_json(text), read)
