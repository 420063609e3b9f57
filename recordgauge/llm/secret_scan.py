"""Secrets in text: three fixed patterns, and random strings by their token efficiency.

A byte-pair vocabulary spends few tokens on text like the one it was built from. A random
string has no such pairs, so it needs about one token per one and a half characters. The test
takes unbroken runs of key characters, leaves out what is random by nature but no secret
(digests, UUIDs, mail addresses, times, plain numbers), and reports runs with few characters per
token. A run that is not reported whole is cut at its joints (``CUTS``) and its parts are tested
too; a leading date or time is cut off, and what follows it is tested. The host of a URL is no
secret and is left out of the run that goes on with its path.

A span is (kind, start, end) in code points, end exclusive. Base kinds are always reported;
``random`` spans are added where no base span overlaps.

Defined results: a null or empty text has no spans. Offsets are those of the whole text,
whatever its length. Repeated rows get equal results. Other columns are carried along; one
named ``spans`` (``find_secrets``) is replaced.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache

import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import per_text, with_columns

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_ASSIGNED, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: Runs of at least so many characters are tested, and reported up to so many characters a token.
MIN_RUN = 20
MAX_CHARS_PER_TOKEN = 1.9
VOCABULARY = "byte_bpe_50k.tiktoken"
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"

_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:[.=][A-Za-z0-9+/_-]+)*=*")
#: Joints of a run, coarse to fine: name and value or dotted parts, paths, words.
CUTS = tuple(re.compile(x) for x in ("[^.=]+=*", "[^/]+", "[^_+-]+"))
_LOCAL_PART = re.compile(r"[A-Za-z0-9._+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
_USER_INFO = re.compile(r"(?<=://)[^\s/@]*")
# Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMERIC = re.compile(r"[0-9+/_=.-]+")
_TIME = re.compile(
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:[T_-]?[0-9]{2}(?:[-.]?[0-9]{2}){0,2}(?:\.[0-9]+)?Z?(?:[+-][0-9]{2}-?[0-9]{2})?)?(?![0-9A-Za-z])"
)
_JOINTS = "+/_=.-"


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
    return tiktoken.Encoding(
        "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def is_identifier(run: str) -> bool:
    """Whether a run is a digest, a UUID, a time or all digits: costs tokens, but hides nothing."""
    if _NUMERIC.fullmatch(run) or _UUID.fullmatch(run) or _TIME.fullmatch(run):
        return True
    return len(run) in DIGEST_LENGTHS and _HEXADECIMAL.fullmatch(run) is not None


def looks_random(run: str, encoding: tiktoken.Encoding) -> bool:
    """Whether a run of letters, or one that mixes them with digits, costs many tokens."""
    # Joints cost a token each, so words without a digit are tested one by one.
    if not re.search(r"[A-Za-z]", run) or not (run.isalpha() or re.search(r"[0-9]", run)):
        return False
    return len(run) <= MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(run))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three fixed patterns, kind by kind."""
    spans: list[tuple[str, int, int]] = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found = (m for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED)
        spans += [("assign", *m.span()) for m in found]
    if "AKIA" in text:
        found = (m for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS)
        spans += [("access", *m.span()) for m in found]
    if _longest_word(text) >= 32:
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def _longest_word(text: str) -> int:
    # No run of the patterns holds white space, so a text of short words needs no search.
    return max(map(len, text.split()), default=0)


def _random_parts(run: str, at: int, encoding: tiktoken.Encoding, level: int = 0) -> list[tuple[int, int]]:
    """Where a run that starts at ``at``, or else its parts, cost many tokens."""
    while (time := _TIME.match(run)) and time.end() < len(run):
        rest = run[time.end() :].lstrip(_JOINTS)
        at, run = at + len(run) - len(rest), rest
    if len(run) < MIN_RUN or is_identifier(run):
        return []
    if looks_random(run, encoding):
        return [(at, at + len(run))]
    found: list[tuple[int, int]] = []
    for finer in range(level, len(CUTS)):
        parts = list(CUTS[finer].finditer(run))
        if len(parts) == 1 and len(parts[0][0]) == len(run):
            continue
        for m in parts:
            found += _random_parts(m[0], at + m.start(), encoding, finer + 1)
        break
    return found


def _address_end(text: str, start: int, end: int, user_info: list[tuple[int, int]]) -> int | None:
    """Where the mail address ends whose first part is the run; None where it is none."""
    domain = _DOMAIN.match(text, end)
    if not domain or not _LOCAL_PART.fullmatch(text, start, end):
        return None
    # In postgres://user:run@host the run is a password.
    before = bisect_right(user_info, (start, len(text))) - 1
    return None if before >= 0 and user_info[before][1] >= start else domain.end()


def random_spans(
    text: str, taken: list[tuple[str, int, int]], vocabulary: str
) -> list[tuple[str, int, int]]:
    """Runs that fail the token-efficiency test and overlap none of ``taken``."""
    if _longest_word(text) < MIN_RUN:
        return []
    spans, address = [], 0
    # Where user names and passwords of URLs stand, in order; of any length.
    user_info = [m.span() for m in _USER_INFO.finditer(text)] if "@" in text else []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if text[end : end + 1] == "@":
            address = _address_end(text, start, end, user_info) or address
            if address > end:
                continue
        # The run of an address's domain may go on with a path, and so may that of a URL's host.
        start = max(start, min(address, end))
        if start and text.startswith("://", start - 1) and text[end : end + 1] not in ("@", ":"):
            slash = text.find("/", start + 2, end)
            start = end if slash < 0 else slash + 1
        if end - start < MIN_RUN:
            continue
        for low, high in _random_parts(text[start:end], start, _encoding(vocabulary)):
            if not any(low < e and s < high for _, s, e in taken):
                spans.append(("random", low, high))
    return spans


def spans_of(text: str | None, vocabulary: str | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then by kind in the order of ``KINDS``."""
    text = text or ""
    base = base_spans(text)
    added = random_spans(text, base, vocabulary or public_tokenizers.path(VOCABULARY))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``spans``; ``vocabulary`` is a tiktoken file every executor can read."""
    found = per_text(lambda t: spans_of(t, vocabulary), SPAN_TYPE)(F.col(text))
    return with_columns(docs, spans=found)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` has added."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")

    base = F.filter(spans, lambda s: s.kind != "random")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def masked(text: str | None, vocabulary: str | None = None, mask: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones taken together, replaced by ``mask``."""
    if not text:
        return text
    parts, done = [], 0
    for _, start, end in spans_of(text, vocabulary):
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_secrets(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with secrets masked in its text and ``n_chars``, if there, brought in line.

    All rows and the other columns stay.
    """
    safe = docs.withColumn(text, per_text(lambda t: masked(t, vocabulary), "string")(F.col(text)))
    if "n_chars" not in docs.columns:
        return safe
    return safe.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
