"""One row that says whether a whole batch keeps the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.operators.tally import GATE_COUNTS, gate_counters


class ContractViolation(AssertionError):
    """At least one record of a batch does not keep the contract."""


def gate(annotated: DataFrame) -> DataFrame:
    """``n_records, n_valid, n_invalid, n_not_object, n_malformed, conforms``.

    No grouping: each task sends one row of counts. An empty batch conforms with 0 records.
    """
    return gate_row(annotated.agg(*gate_counters()))


def gate_row(counted: DataFrame) -> DataFrame:
    """The same from a row of counters."""
    return counted.select(*GATE_COUNTS, (F.col("n_valid") == F.col("n_records")).alias("conforms"))


def assert_conforms(annotated: DataFrame) -> None:
    """Raise ``ContractViolation`` with the counts unless every record is valid."""
    row = gate(annotated).first()
    if not row["conforms"]:
        raise ContractViolation(", ".join(f"{k}={v}" for k, v in row.asDict().items()))
