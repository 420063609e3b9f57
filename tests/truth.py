"""Texts with the verdicts the contract's rules give them, and a row-wise model of the rules."""

import json
from pathlib import Path

from recordgauge import DEFAULT

_FIXTURES = Path(__file__).resolve().parent.parent / "FIXTURES.md"


def truth_table():
    block = _FIXTURES.read_text(encoding="utf-8").split("```jsonl\n")[1].split("```")[0]
    return [json.loads(line) for line in block.splitlines()]


def _refuse(_):
    raise ValueError("not JSON")


def model(text, contract=DEFAULT):
    """(status, problems) of one text, by Python's own JSON reader."""
    if text is None:
        return "malformed", None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_int=float)
    except ValueError:
        return "malformed", None
    if isinstance(value, list):
        value = {}
    elif not isinstance(value, dict):
        return "not_object", None
    problems = [name for name in contract.required if name not in value]
    word = value.get(contract.vocab_field)
    if not (isinstance(word, str) and word in contract.vocab):
        problems.append(contract.vocab_field)
    return "checked", problems
