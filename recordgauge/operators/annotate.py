"""Give every record its parse status, its ordered problem list and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.contract import DEFAULT, Contract
from recordgauge.functions import rules, strict_json
from recordgauge.functions.token_fold import read_tokens

CHECKED = "checked"
NOT_OBJECT = "not_object"
MALFORMED = "malformed"

_ADDED = ("status", "missing", "unknown_word", "problems", "valid")
_FACTS = ("_missing", "_word_known")
_INTERIM = ("_document", "_second_test", "_names", "_word", "_one_value", "_status", "_names_missing", "_known")


def facts(df: DataFrame, contract: Contract = DEFAULT, json_col: str = "v") -> DataFrame:
    """Add ``status``, ``_missing`` and ``_word_known``, all that the rules need of a record.

    Each text is parsed once, however the result is used. The facts leave through ``inline``
    of a one-element array: Catalyst moves filters below a projection and repeats the
    projection's expressions in them, here the parse, but it moves none below a generator.
    A text that the parser refuses, and that may be JSON beyond its limits, is read token by
    token, in a step of its own: that step has no generated code, the parse keeps its.

    Sets ``spark.sql.variant.allowDuplicateKeys`` in the session, so that of two equal names
    the last one counts; the plan keeps that whatever the setting is later.
    """
    _refuse_taken_names(df)
    # Has to be set before the parse is built: the plan then carries it.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    carried = _carried(df)
    text = F.col(_quoted(json_col)) if json_col in df.columns else F.col(json_col)
    document, second_test = F.col("_document"), F.col("_second_test")
    names, word, one_value = F.col("_names"), F.col("_word"), F.col("_one_value")

    # NULL where the text has to be read again.
    status = (
        F.when(~one_value, F.when(~strict_json.may_exceed_limits(text), MALFORMED))
        .when(names.isNotNull() | strict_json.opens_array(text), CHECKED)
        .otherwise(NOT_OBJECT)
    )
    return (
        df.select(
            "*",
            strict_json.marked_document(text).alias("_document"),
            strict_json.spells_mark_within_value(text).alias("_second_test"),
        )
        .select(
            *carried,
            strict_json.top_level_names(document).alias("_names"),
            strict_json.string_field(document, contract.vocab_field).alias("_word"),
            strict_json.holds_one_value(document, second_test).alias("_one_value"),
        )
        .select(
            *carried,
            F.inline(
                F.array(
                    F.struct(
                        status.alias("_status"),
                        rules.missing_names(contract, names).alias("_names_missing"),
                        rules.in_vocabulary(contract, word).alias("_known"),
                    )
                )
            ),
        )
        .select(*carried, F.inline(_decided(text, contract)))
    )


def _decided(text: Column, contract: Contract) -> Column:
    """The facts as they are, or read from the text's tokens if the parser has not told."""
    parsed = F.array(
        F.struct(
            F.col("_status").alias("status"),
            F.col("_names_missing").alias("_missing"),
            F.col("_known").alias("_word_known"),
        )
    )

    def judged(read: Column) -> Column:
        status = (
            F.when(~read["is_json"], MALFORMED).when(read["nests"], CHECKED).otherwise(NOT_OBJECT)
        )
        return F.struct(
            status.alias("status"),
            rules.missing_names(contract, read["names"]).alias("_missing"),
            rules.in_vocabulary(contract, read["word"]).alias("_word_known"),
        )

    return F.when(F.col("_status").isNotNull(), parsed).otherwise(
        F.transform(F.array(read_tokens(text, contract)), judged)
    )


def missing_fields(df: DataFrame, contract: Contract = DEFAULT, json_col: str = "v") -> DataFrame:
    """Add ``status`` and ``missing``, the absent required names; NULL unless checked."""
    return facts(df, contract, json_col).select(
        *_carried(df), "status", F.when(_is_checked(), F.col("_missing")).alias("missing")
    )


def vocabulary_check(df: DataFrame, contract: Contract = DEFAULT, json_col: str = "v") -> DataFrame:
    """Add ``status`` and ``unknown_word``: whether the vocabulary field holds none of the
    contract's words; NULL unless checked."""
    return facts(df, contract, json_col).select(
        *_carried(df), "status", F.when(_is_checked(), ~F.col("_word_known")).alias("unknown_word")
    )


def annotate(df: DataFrame, contract: Contract = DEFAULT, json_col: str = "v") -> DataFrame:
    """Add ``status``, ``problems`` and ``valid``; works on batch and streaming frames.

    ``status`` is ``checked``, ``not_object`` (JSON, but neither object nor array) or
    ``malformed`` (not one JSON value, or NULL), at any depth and length. ``problems`` and
    ``valid`` are NULL unless the record was checked.
    """
    checked = _is_checked()
    missing, word_known = F.col("_missing"), F.col("_word_known")
    return facts(df, contract, json_col).select(
        *_carried(df),
        "status",
        F.when(checked, rules.problem_list(contract, missing, word_known)).alias("problems"),
        # Not taken from the problem list, which a filter or count then need not build.
        F.when(checked, word_known & (F.size(missing) == 0)).alias("valid"),
    )


def _is_checked() -> Column:
    return F.col("status") == CHECKED


def _carried(df: DataFrame) -> list[Column]:
    return [F.col(_quoted(name)) for name in df.columns]


def _quoted(name: str) -> str:
    # A name may hold a dot.
    return "`" + name.replace("`", "``") + "`"


def _refuse_taken_names(df: DataFrame) -> None:
    """Names are compared as the session's resolver does, with or without case."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = str if sensitive else str.lower
    own = {fold(n) for n in (*_ADDED, *_FACTS, *_INTERIM)}
    taken = sorted(n for n in df.columns if fold(n) in own)
    if taken:
        raise ValueError(f"the frame already has columns named {taken}")
