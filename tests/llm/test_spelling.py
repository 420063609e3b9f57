import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recordgauge.llm import spelling_variants as sv


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x)) if some else None
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def words(rng, letters, sizes, n):
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.randint(3, 400) for _ in range(n)}


@pytest.mark.parametrize(
    ("letters", "sizes", "n", "bounds"),
    [
        ("abÿ", (5, 6), 400, {}),
        ("abcdÉ", (5, 6, 7), 900, {"sample": 400, "part": 60, "block": 50}),
        ("ab", (12, 13), 500, {"part": 50, "block": 20}),
    ],
)
def test_against_brute_force(spark, letters, sizes, n, bounds):
    n = words(random.Random(len(letters)), letters, sizes, n)
    found = sv.variants(spark.createDataFrame(list(n.items()), "word string, n long"), **bounds)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(found) == plain(n) and found.count() == len(n)


def test_chains_of_forms_and_ties(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzza": 5, "zzzzb": 10, "zzzzc": 10, "alone": 4}
    found = rows(sv.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert found == plain(n)
    assert ("aaaaa", "aaaab", "bbbbb", 3, 1, 6) in found and ("zzzza", "zzzzb", "zzzzb", 5, 2, 10) in found


def test_long_words(spark):
    long = "ab" * 3_000
    n = {long: 9, long[:-1]: 3, long[:50] + "c" + long[51:]: 4, long[1:]: 3}
    assert rows(sv.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain(n)


def test_word_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Straße", "ÉCOLE", "éclair", "modern", "tide", "x1wordy", "naïve×", "Modern"]) for _ in range(200)) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "modern " * 150), (7, None), (8, ""), (3, texts[3])]
    expected = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += len(run) >= 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counted = {r.word: r.n for r in sv.word_counts(df).collect()}
    assert counted == {w: n for w, n in expected.items() if n >= 3}
    assert any(w not in {"straße", "École", "éclair", "modern", "wordy", "naïve×"} for w in counted) or len(counted) >= 5


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, word string")
    assert sv.spelling_variants(empty).collect() == []


def test_parts_in_reach_miss_nothing():
    rng = random.Random(9)
    some = list(words(rng, "abcde", (7,), 3_000))
    nodes = sv.fit_parts(some, 12)
    assert sum(len(x) == 1 for x in nodes) > 4
    counts = sv.letter_counts(some).tolist()
    parts = [sv.part_of(nodes, c) for c in counts]
    for i in range(0, len(some), 7):
        up = np.maximum(np.array(counts) - counts[i], 0).sum(axis=1)
        down = np.maximum(counts[i] - np.array(counts), 0).sum(axis=1)
        for reach in ((1, 1), (1, 0), (0, 1)):
            held = {parts[j] for j in np.flatnonzero((up <= reach[0]) & (down <= reach[1]))}
            assert held <= set(sv.parts_in_reach(nodes, counts[i], *reach))
