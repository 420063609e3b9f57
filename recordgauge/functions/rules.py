"""The contract's rules as columns over facts already taken from a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordgauge.contract import Contract


def missing_names(contract: Contract, names: Column) -> Column:
    """Required names that ``names`` lacks, in contract order; NULL ``names`` lacks them all."""
    none = F.array().cast("array<string>")
    required = F.array(*map(F.lit, contract.required)).cast("array<string>")
    return F.array_except(required, F.coalesce(names, none))


def in_vocabulary(contract: Contract, word: Column) -> Column:
    """Whether ``word`` is one of the contract's words; never NULL."""
    return F.coalesce(word.isin(*contract.vocab), F.lit(False))


def problem_list(contract: Contract, missing: Column, word_known: Column) -> Column:
    """Missing names, then the vocabulary field if its word is unknown.

    An absent vocabulary field that is also required is listed twice, once for each rule.
    """
    return F.when(word_known, missing).otherwise(F.array_append(missing, F.lit(contract.vocab_field)))
