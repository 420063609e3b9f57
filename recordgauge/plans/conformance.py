"""Whole checks of a table, each of which parses every record once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from recordgauge.contract import DEFAULT, Contract
from recordgauge.operators.annotate import annotate
from recordgauge.operators.gate import gate_row
from recordgauge.operators.split import read_split, write_split
from recordgauge.operators.tally import gate_counts, report_rows, tallied


@dataclass(frozen=True)
class Outcome:
    """Gate and report of one check, and the counts both are made from."""

    counts: DataFrame
    gate: DataFrame
    report: DataFrame


def _outcome(annotated: DataFrame, contract: Contract) -> Outcome:
    # A row for each name of the contract and each verdict: fetched, so that it takes one pass
    # over the records and nothing is left behind.
    counted = tallied(annotated, contract)
    kept = annotated.sparkSession.createDataFrame([tuple(r) for r in counted.collect()], counted.schema)
    return Outcome(kept, gate_row(gate_counts(kept)), report_rows(kept))


def check(df: DataFrame, contract: Contract = DEFAULT, json_col: str = "v") -> Outcome:
    """Run through the records once, count, and judge from the counts."""
    return _outcome(annotate(df, contract, json_col), contract)


def check_and_keep(
    df: DataFrame, path: str, contract: Contract = DEFAULT, json_col: str = "v"
) -> tuple[DataFrame, Outcome]:
    """Write the parted records, then count and judge from the written verdict columns alone."""
    annotated = annotate(df, contract, json_col)
    write_split(annotated, path)
    kept = read_split(df.sparkSession, path, annotated.schema)
    return kept, _outcome(kept, contract)
