"""What a record has to look like: required names and one closed vocabulary."""

from __future__ import annotations

import re
from dataclasses import dataclass

from recordgauge.functions.strict_json import MAX_DIGITS

# The default contract.
DEFAULT_REQUIRED = ("event_id", "kind", "occurred_at", "subject_id", "payload")
DEFAULT_VOCAB_FIELD = "kind"
DEFAULT_VOCAB = (
    "CATALOG_FROZEN",
    "CLAIM_REPLAYED",
    "DIFF_CLASSIFIED",
    "MAPPING_REVISED",
    "RELEASE_SIGNED",
)


@dataclass(frozen=True)
class Contract:
    """Ordered required top-level names, and the words one field may hold.

    ``vocab_field`` need not be among ``required``. Names and words are compared exactly
    (case, spaces and JSON type included). The contract ends up as literals in the plan, so it
    is meant for a schema-sized list, not for a dimension table.
    """

    required: tuple[str, ...] = DEFAULT_REQUIRED
    vocab_field: str = DEFAULT_VOCAB_FIELD
    vocab: tuple[str, ...] = DEFAULT_VOCAB

    def __post_init__(self) -> None:
        for part in ("required", "vocab"):
            given = getattr(self, part)
            if isinstance(given, str):
                raise TypeError(f"{part} takes a sequence of strings, not one string")
            object.__setattr__(self, part, tuple(given))
        for text in (*self.required, self.vocab_field, *self.vocab):
            if not isinstance(text, str):
                raise TypeError(f"a contract holds strings only, got {text!r}")
            if re.search(f"[0-9]{{{MAX_DIGITS}}}", text):
                raise ValueError(f"a contract holds no run of {MAX_DIGITS} digits")
        if len(set(self.required)) < len(self.required):
            raise ValueError("required names must be distinct")
        if not self.vocab_field or "'" in self.vocab_field:
            # A variant path quotes the name as ['name'] and has no escape for the quote.
            raise ValueError("vocab_field must be non-empty and hold no single quote")


DEFAULT = Contract()
