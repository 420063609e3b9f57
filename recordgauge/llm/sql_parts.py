"""Expressions for the comparison SQL: DuckDB has no crc32."""

from __future__ import annotations

# The reversed polynomial of the usual CRC-32.
_POLYNOMIAL = 0xEDB88320
_ONES = 0xFFFFFFFF


def crc32_table() -> str:
    """A query of one row whose ``crc`` is the list of 256 steps."""
    step = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END"
    return (
        "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), "
        f"lambda c, k: {step})) AS crc"
    )


def crc32_of_bytes(values: str) -> str:
    """The crc32 of a list of byte values, where ``crc`` is a column in reach."""
    return (
        f"xor(list_reduce(list_prepend(CAST({_ONES} AS BIGINT), {values}), "
        f"lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), {_ONES})"
    )
