"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def per_text(fn: Callable, returns: DataType | str) -> Callable[..., Column]:
    """A Python function of one row's values as a column.

    Only the arguments travel to Python, in batches of a hundred rows, so memory is bounded by
    the longest texts and not by the size of a partition. Marked as not deterministic so that
    Catalyst neither repeats it nor moves a filter through it.
    """
    return F.udf(fn, returns, useArrow=False).asNondeterministic()


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns; columns of the same name (in any case) are replaced."""
    taken = {name.lower() for name in columns}
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *(c.alias(name) for name, c in columns.items()))


def bucket(key: str | Column, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo ``modulus``: decides who is held out."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
