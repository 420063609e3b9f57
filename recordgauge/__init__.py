"""Contract checks for JSON event records on Spark DataFrames and streams."""

from recordgauge.contract import DEFAULT, Contract
from recordgauge.operators.annotate import annotate, missing_fields, vocabulary_check
from recordgauge.operators.gate import ContractViolation, assert_conforms, gate
from recordgauge.operators.report import problem_report
from recordgauge.operators.split import accepted, quarantined, read_split, split, write_split
from recordgauge.operators.tally import tallied, tally
from recordgauge.plans.conformance import check, check_and_keep
from recordgauge.sources.events import read_events, spread, stream_events
from recordgauge.streaming.annotated import write_split_stream
from recordgauge.streaming.compaction import compact

__all__ = [
    "DEFAULT",
    "Contract",
    "ContractViolation",
    "accepted",
    "annotate",
    "assert_conforms",
    "check",
    "check_and_keep",
    "compact",
    "gate",
    "missing_fields",
    "problem_report",
    "quarantined",
    "read_events",
    "read_split",
    "split",
    "spread",
    "stream_events",
    "tallied",
    "tally",
    "vocabulary_check",
    "write_split",
    "write_split_stream",
]
