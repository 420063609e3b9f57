import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordgauge.llm import simhash_index as s
from recordgauge.llm.components import component_roots


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    """Index of the first member reachable, by brute force."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if linked(values[i], values[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def near(a, b):
    return bin(a ^ b).count("1") <= 4


TEXTS = [
    "", None, " \t\n", "One", "one two\x0bthree", "A B c D e F", "É é İ ß  x", "a\x1cb a\x85c d e f g",
    "same words again " * 400, "x" * 50_000, " ".join(f"w{i}" for i in range(30_000)),
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_equals_the_plain_one(text):
    assert s.fingerprint_of(text) == plain_fingerprint(text)


def test_any_four_positions_hold_a_triple():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in s.TRIPLES) for four in combinations(range(8), 4))
    assert len(s.TRIPLES) == 20


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(120)}
    for centre in list(values)[:6]:  # chains and clusters round some of them
        for _ in range(40):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            values.add(centre)
    values = sorted(values | {0, 1, (1 << 64) - 1})
    frame = spark.createDataFrame([(s._signed(v),) for v in values], "fp long").repartition(5)
    links = [(r.left % 2**64, r.right % 2**64) for r in s.fingerprint_links(frame).collect()]
    assert all(near(a, b) for a, b in links)
    roots = component_roots(s.fingerprint_links(frame))
    found = {r.node % 2**64: r.root % 2**64 for r in roots.collect()}
    groups = {}
    for v, label in zip(values, components(values, near), strict=True):
        groups.setdefault(label, set()).add(v)
    grouped = {}
    for v in values:
        grouped.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, grouped.values()))


def test_long_lists_are_divided(spark):
    """A text that fixes three bytes of every fingerprint makes no list of all of them."""
    rng = random.Random(12)
    fixed = 0x00CC0000BB0000AA
    free = 0xFF00FFFF00FFFF00
    seeds = [rng.getrandbits(64) & free for _ in range(1_500)]
    seeds += [x ^ sum(1 << b for b in rng.sample([b for b in range(64) if free >> b & 1], rng.randint(1, 5))) for x in seeds]
    values = sorted({x | fixed for x in seeds})
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    sizes = [r["count"] for r in s.posting_lists(frame, long_list=100).groupBy("triple", "key").count().collect()]
    assert max(sizes) < 100 < len(values) / 20
    assert max(r["count"] for r in s.posting_lists(frame, long_list=10**9).groupBy("triple", "key").count().collect()) == len(values)
    links = [(r.left % 2**64, r.right % 2**64) for r in s.fingerprint_links(frame, long_list=100).collect()]
    at = {v: i for i, v in enumerate(values)}
    assert all(near(a, b) for a, b in links)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    for a, b in links:
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    assert [find(i) for i in range(len(values))] == components(values, near)


def test_a_spanning_forest_has_few_links():
    rng = np.random.default_rng(1)
    around = np.unique(np.bitwise_xor(np.uint64(12345), np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    left, right = s.spanning_links(around)
    assert len(left) == len(around) - 1 and len(set(right)) == len(right)


def test_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in component_roots(links).collect()} == {0}
    assert component_roots(links.limit(0)).collect() == []


ROWS = [
    (5, "the quick brown fox jumps over the lazy dog and runs away from it"),
    (3, "THE quick brown fox jumps over the lazy dog and runs away from it"),
    (3, "the quick brown fox jumps over the lazy dog and runs away from it"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from it"),
    (9, None), (8, ""), (None, "no id and nothing like it anywhere in this table at all"),
    (7, "entirely different text that has nothing to do with any of the others"),
]


def test_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fp", F.lit("mine"))
    rows = s.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[i].component_id for i in (3, 5)} == {3}
    assert (by_id[9].component_id, by_id[8].component_id, by_id[7].component_id) == (8, 8, 7)
    assert by_id[9].fingerprint == "0" * 16
    assert sorted((r.component_id for r in rows if r.doc_id is None), key=str) == [3, None]
    assert all(r.fingerprint == f"{plain_fingerprint(t):016x}" for t in [ROWS[7][1]] for r in [by_id[7]])


def test_one_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("_Simhash_FP", F.lit(1))
    kept = s.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 8, None]
    assert s.one_per_component(docs.limit(0)).count() == 0 == s.near_duplicates(docs.limit(0)).count()


def test_query_equals_brute_force(spark):
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from recordgauge.llm.queries import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)[:400]
    if len(docs) > 400:
        pytest.skip("brute force is for the smallest tables")
    prints = [plain_fingerprint(docs[i]) for i in ids]
    expected = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, components(prints, near), strict=True)}
    rows = queries()["op10_simhash_index"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == expected
