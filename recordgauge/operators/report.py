"""How often each problem occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from recordgauge.contract import DEFAULT, Contract
from recordgauge.operators.tally import problem_counts


def problem_report(annotated: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """``problem, n_records, n_occurrences``; the two differ where a list names it twice.

    ``contract`` is the one the records were annotated with. Each task sends one row for each
    name at most.
    """
    return problem_counts(annotated, contract)
