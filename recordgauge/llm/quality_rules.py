"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

The base counts and verdict are fixed: too few words, or too many words inside repeated
five-word windows. The rest is ``RULES``, a table of ratios with a lower and an upper bound.
All of it is Spark SQL; nothing leaves the row and nothing is shuffled.

Repeated windows are found by the 64-bit hash of their words. Only texts whose window hashes
are not all different go on to sort them.

Defined results: a null text counts as an empty one, has no words and fails the base rules.
Texts of any length are measured whole. Repeated rows get equal results; an empty table gives
an empty one. ``measured`` carries other columns along and replaces those of equal name; ones
named ``_words`` or ``_lines`` are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import with_columns
from recordgauge.llm.stop_words import STOP_WORDS

# The base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


class Rule(NamedTuple):
    """A ratio of two measures with its bounds, either of which may be absent."""

    name: str
    part: str
    whole: str
    least: float | None
    most: float | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 0.3),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.08, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_exclamations", "n_stop_words", "n_lines")


def _stop_forms() -> list[str]:
    """The words as written within and at the start of a sentence, not in capitals."""
    return sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS if len(w) > 1)})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five that the text has twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(at: Column) -> Column:
        # Each start covers five words, or as many as there are up to the next start.
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    def starts_of_repeated(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda one, k: F.when(
                one.hash.eqNullSafe(F.get(ordered, k - 1).hash) | one.hash.eqNullSafe(F.get(ordered, k + 1).hash),
                one.start,
            ),
        )
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("start"))))
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            _let(_let(ordered, starts_of_repeated), covered),
        ).otherwise(0)

    return F.when(F.size(words) > WINDOW, _let(hashes, of)).otherwise(0)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of its whole texts (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # A generator, so that the split texts are not computed again for each measure.
    parts = F.inline(F.array(F.struct(words.alias("_words"), lines.alias("_lines"))))
    split = docs.drop("_words", "_lines").select("*", parts)
    w, ln = F.col("_words"), F.col("_lines")
    measures = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": repeated_words(w),
        "n_exclamations": F.regexp_count(whole, F.lit("!")),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(_stop_forms()))),
        "n_lines": F.size(ln),
    }
    return with_columns(split, **{n: c.cast("long") for n, c in measures.items()}).drop("_words", "_lines")


#: The measures of the base, and those that the method adds.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_exclamations", "n_stop_words", "n_lines")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one condition; a ratio to nothing is zero."""
    verdict = F.lit(True)
    for rule in rules:
        whole = F.col(rule.whole)
        ratio = F.when(whole > 0, F.col(rule.part) / whole).otherwise(0.0)
        if rule.least is not None:
            verdict = verdict & (ratio >= rule.least)
        if rule.most is not None:
            verdict = verdict & (ratio <= rule.most)
    return verdict


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return with_columns(measured(docs, text), base_failed=base_failed, kept=~base_failed & passes(rules))


def _sql_list(words: list[str]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table in DuckDB; rows are told apart by a number, so ids may repeat."""
    bounds = [
        f"(CASE WHEN {r.whole} > 0 THEN {r.part} / {r.whole} ELSE 0.0 END) {sign} {bound}"
        for r in rules
        for sign, bound in ((">=", r.least), ("<=", r.most))
        if bound is not None
    ]
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
s AS (SELECT r, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: {{'i': i, 'win': words[i:i + {WINDOW - 1}]}})) AS s FROM w),
c AS (SELECT r, s.i AS i, count(*) OVER (PARTITION BY r, s.win) AS n FROM s),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, range({WINDOW}) AS t(k) WHERE n > 1 GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
  CAST(len(list_filter(words, lambda x: list_contains({_sql_list(_stop_forms())}, x))) AS BIGINT) AS n_stop_words,
  CAST(len(lines) AS BIGINT) AS n_lines FROM w LEFT JOIN p ON w.r = p.r)
SELECT doc_id, {", ".join(BASE)}, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND {" AND ".join(bounds)} AS kept, {", ".join(MORE)} FROM m
"""
