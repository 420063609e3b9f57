"""Counts over annotated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.contract import DEFAULT, Contract
from recordgauge.operators.annotate import MALFORMED, NOT_OBJECT

GATE_COUNTS = ("n_records", "n_valid", "n_invalid", "n_not_object", "n_malformed")


def tally(annotated: DataFrame) -> DataFrame:
    """``status, valid, problems, n``: one row per distinct verdict.

    For narrow contracts: with many required names there can be nearly as many verdicts as
    records, and then nothing is counted together before the shuffle. Gate and report do not
    use it.
    """
    return annotated.groupBy("status", "valid", "problems").agg(F.count(F.lit(1)).alias("n"))


def _gate_conditions() -> tuple[Column, ...]:
    status = F.col("status")
    return (F.lit(True), F.col("valid"), ~F.col("valid"), status == NOT_OBJECT, status == MALFORMED)


def gate_counters() -> list[Column]:
    """The gate's counts as aggregates."""
    return [F.count_if(c).alias(name) for name, c in zip(GATE_COUNTS, _gate_conditions(), strict=True)]


def tallied(annotated: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """``problem, status, valid, n_records, n_occurrences``: all that the gate and the report need.

    One row for each problem, without verdict, and one for each verdict, without problem. A
    record is exploded into its problems and itself; what a task has of each is counted before
    the shuffle, so it sends a row for each name and verdict at most, and a record costs as many
    steps as it has problems, however many names the contract has.
    """
    itself = F.array(F.lit(None).cast("string"))
    problems = F.concat(F.coalesce("problems", F.array().cast("array<string>")), itself)
    return _counted(annotated.select(_twice(contract), "status", "valid", F.posexplode(problems).alias("_at", "problem")), True)


def problem_counts(annotated: DataFrame, contract: Contract) -> DataFrame:
    """``problem, n_records, n_occurrences`` of what occurs."""
    return _counted(annotated.select(_twice(contract), F.posexplode("problems").alias("_at", "problem")), False)


def _twice(contract: Contract) -> Column:
    """Where a record lists the vocabulary field again, or NULL: then it comes last, once as a
    missing name and once as an unknown word."""
    last = F.size("problems") - 1
    first = F.array_position("problems", contract.vocab_field) - 1
    return F.when((first >= 0) & (first < last), last).alias("_again")


def _counted(exploded: DataFrame, verdicts: bool) -> DataFrame:
    itself = F.col("problem").isNull()
    by = [F.when(itself, F.col(c)).alias(c) for c in ("status", "valid")] if verdicts else []
    first = F.col("_again").isNull() | (F.col("_at") != F.col("_again"))
    return exploded.groupBy("problem", *by).agg(
        F.count_if(first).alias("n_records"), F.count(F.lit(1)).alias("n_occurrences")
    )


def report_rows(counted: DataFrame) -> DataFrame:
    """The report from ``tallied``."""
    return counted.where("problem IS NOT NULL").select("problem", "n_records", "n_occurrences")


def gate_counts(counted: DataFrame) -> DataFrame:
    """The row of the gate's counts from ``tallied``."""
    n = F.when(F.col("problem").isNull(), F.col("n_occurrences")).otherwise(0)
    return counted.agg(
        *(F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(name) for name, c in zip(GATE_COUNTS, _gate_conditions(), strict=True))
    )
