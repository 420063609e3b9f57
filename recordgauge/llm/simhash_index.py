"""Near duplicates by SimHash fingerprints and an inverted index over their bytes.

A fingerprint has eight byte positions. Two fingerprints that differ in at most four bits
differ in at most four bytes, so they share at least four positional bytes. A posting list of
one positional byte would hold 1/256 of the corpus, so postings are kept for three positional
bytes at once: the 20 triples of ``TRIPLES`` are chosen so that any four positions contain at
least one of them, hence every linked pair meets in at least one posting list. Inside a list,
the shared positional bytes of a pair are counted, pairs below four are left out, and the rest
are verified bit by bit.

A list of more than ``LONG_LIST`` fingerprints is divided: its pairs share a fourth positional
byte, so each of the five other positions gives lists by the byte there, and every linked pair
meets in one of them. A common piece of text that fixes three bytes makes no list of its own.

Fingerprints are indexed once however many documents share them. A posting list yields a
spanning forest of its links instead of all its pairs: a breadth-first search compares each
fingerprint with the ones not reached yet, which is enough for the components.

Defined results: a null or wordless text has fingerprint zero and is linked like any other;
rows with a null or repeated doc_id are kept as rows; an empty table gives an empty result.
A component's id is the smallest non-null doc_id in it, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import per_text, with_columns
from recordgauge.llm.components import component_roots
from recordgauge.plans.scratch import discard, staged

BITS = 64
POSITIONS = 8
MAX_DIFFERING = 4
MIN_SHARED_BYTES = POSITIONS - MAX_DIFFERING
SHINGLE_WORDS = 4
SEED = 42
_CHUNK = 65_536
LONG_LIST = 4_096


def _covering_triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four positions contain one.

    The positions are dealt to three classes in a circle; taken are the triples within one
    class and those with two members in a class and one in the next (Turán's construction).
    """
    kind = [p % 3 for p in range(POSITIONS)]
    taken = []
    for triple in combinations(range(POSITIONS), 3):
        kinds = [kind[p] for p in triple]
        pair = next((k for k in kinds if kinds.count(k) == 2), None)
        if len(set(kinds)) == 1 or (pair is not None and (pair + 1) % 3 in kinds):
            taken.append(triple)
    return taken


TRIPLES = _covering_triples()
_MASKS = [sum(0xFF << (8 * p) for p in triple) for triple in TRIPLES]


def fingerprint_of(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    # bytes.lower() maps A-Z only and bytes.split() splits at \x20 and \x09-\x0D only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    width = min(width, len(words))
    first = starts[: len(words) - width + 1].tolist()
    after = (starts[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(first), _CHUNK):
        spans = zip(first[low : low + _CHUNK], after[low : low + _CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    over_half = (2 * set_bits > len(first)).astype(np.uint8)
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: Column) -> Column:
    """``fingerprint_of`` as a signed 64-bit column."""
    return per_text(lambda t: _signed(fingerprint_of(t)), "long")(text)


def as_hex(signed: Column) -> Column:
    return F.lower(F.lpad(F.hex(signed), 16, "0"))


def _linked(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` share enough positional bytes with ``one`` and pass verification."""
    difference = np.bitwise_xor(one, others)
    shared = (difference.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    linked = shared >= MIN_SHARED_BYTES
    linked[linked] = np.bitwise_count(difference[linked]) <= MAX_DIFFERING
    return linked


def spanning_links(fingerprints: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints (unsigned)."""
    left: list[int] = []
    right: list[int] = []
    rest = np.ascontiguousarray(fingerprints, dtype="<u8")
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            linked = _linked(here, rest)
            found = rest[linked]
            left.extend([int(here)] * len(found))
            right.extend(found.tolist())
            queue.extend(found)
            rest = rest[~linked]
    return left, right


def _pairs(fps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links inside lists of two, compared in one go."""
    start = bounds[:-1][np.diff(bounds) == 2]
    one, two = fps[start], fps[start + 1]
    difference = np.bitwise_xor(one, two)
    shared = (difference.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    linked = (shared >= MIN_SHARED_BYTES) & (np.bitwise_count(difference) <= MAX_DIFFERING)
    return one[linked], two[linked]


_LINK_SCHEMA = pa.schema([("left", pa.int64()), ("right", pa.int64())])


def _links_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each posting list; rows arrive sorted by list, lists may span batches."""

    def links(triple: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = (np.diff(triple) != 0) | (np.diff(key) != 0)
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(fps)]])
        one, two = _pairs(fps, bounds)
        left, right = [one], [two]
        for i in np.flatnonzero(np.diff(bounds) > 2):
            a, b = spanning_links(fps[bounds[i] : bounds[i + 1]])
            left.append(np.array(a, dtype="<u8"))
            right.append(np.array(b, dtype="<u8"))
        columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
        return pa.RecordBatch.from_arrays(columns, schema=_LINK_SCHEMA)

    held: list[tuple[np.ndarray, ...]] = []  # the list that is not known to be complete yet
    for batch in batches:
        rows = (
            batch.column("triple").to_numpy(zero_copy_only=False),
            batch.column("key").to_numpy(zero_copy_only=False),
            batch.column("fp").to_numpy(zero_copy_only=False).view("<u8"),
        )
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        goes_on = held and held[-1][0][-1] == rows[0][0] and held[-1][1][-1] == rows[1][0]
        if last == 0 and (goes_on or not held):
            held.append(rows)
            continue
        parts = [*held, tuple(x[:last] for x in rows)]
        yield links(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        held = [tuple(x[last:] for x in rows)]
    if held:
        yield links(*(np.concatenate([p[i] for p in held]) for i in range(3)))


def _finer_lists(fp: Column) -> Column:
    """Per triple, the masks of a fingerprint's four positional bytes with each other position."""
    finer = []
    for triple, mask in zip(TRIPLES, _MASKS, strict=True):
        others = (p for p in range(POSITIONS) if p not in triple)
        finer.append(
            F.array(
                *(
                    F.struct(
                        F.lit(len(TRIPLES) + p).alias("fourth"),
                        fp.bitwiseAND(F.lit(_signed(mask | (0xFF << (8 * p))))).alias("key"),
                    )
                    for p in others
                )
            )
        )
    return F.array(*finer)


def posting_lists(distinct: DataFrame, column: str = "fp", long_list: int = LONG_LIST) -> DataFrame:
    """(triple, key, fp): in which lists each fingerprint is; ``triple`` numbers the positions."""
    fp = F.col(column)
    postings = F.array(
        *(
            F.struct(F.lit(i).alias("triple"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for i, mask in enumerate(_MASKS)
        )
    )
    lists = distinct.select(fp.alias("fp"), F.explode(postings).alias("posting")).select(
        "posting.triple", "posting.key", "fp"
    )
    # Counted before the shuffle; there are few of them, at most 20 / long_list of the rows.
    long = (
        lists.groupBy("triple", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > long_list)
        .select("triple", "key", F.lit(True).alias("is_long"))
    )
    whole = F.array(F.struct(F.lit(0).alias("fourth"), F.col("key").alias("key")))
    finer = F.element_at(_finer_lists(F.col("fp")), F.col("triple") + 1)
    return (
        lists.join(long, ["triple", "key"], "left")
        .select("triple", "fp", F.explode(F.when(F.col("is_long"), finer).otherwise(whole)).alias("list"))
        .select((F.col("triple") + 100 * F.col("list.fourth")).alias("triple"), "list.key", "fp")
    )


def fingerprint_links(distinct: DataFrame, column: str = "fp", long_list: int = LONG_LIST) -> DataFrame:
    """(left, right) links that connect exactly what the 4-bit relation connects.

    ``distinct`` holds each fingerprint once and is read twice.
    """
    return (
        posting_lists(distinct, column, long_list)
        .repartition("triple", "key")
        .sortWithinPartitions("triple", "key")
        .mapInArrow(_links_of_lists, "left long, right long")
    )


def classes(fingerprints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) per distinct value of the column ``fp``."""
    members = fingerprints.groupBy("fp").agg(F.min(doc_id).alias("first_doc"))
    members, _ = staged(members, "simhash-members")
    links, path = staged(fingerprint_links(members), "simhash-links")
    roots = component_roots(links)
    discard(fingerprints.sparkSession, path)
    rooted = members.join(roots, members.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_doc"
    )
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (hex) and component_id."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"))
    slim, _ = staged(slim, "simhash-fingerprints")
    found = classes(slim)
    return slim.join(found, "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one.

    The one with the smallest doc_id stays, nulls last; of equal ids the first written row.
    """
    numbered = with_columns(
        docs, _simhash_fp=fingerprint(F.col(text)), _simhash_row=F.monotonically_increasing_id()
    )
    # Written before use: only then is a row's number the same for every reader.
    numbered, _ = staged(numbered, "simhash-documents")
    slim = numbered.select(F.col(doc_id).alias("doc_id"), F.col("_simhash_fp").alias("fp"), "_simhash_row")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_simhash_row")
    stay = (
        slim.join(classes(slim), "fp")
        .groupBy("root")
        .agg(F.min(rank).alias("first"))
        .select(F.col("first._simhash_row").alias("_simhash_row"))
    )
    return numbered.join(stay, "_simhash_row", "left_semi").select(*docs.columns)
