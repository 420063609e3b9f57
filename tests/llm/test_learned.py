"""Operators that learn: small exact tests of their parts, and held-out accuracy of the queries."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.llm import compression_quality as cq
from recordgauge.llm import piece_language as pl
from recordgauge.llm import pu_toxicity as pu

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.1")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
DOCS = "doc_id long, text string, lang string, score string"


def odd_rows():
    return [(None, "a word", "en", "mine"), (1, None, None, None), (1, None, None, None), (2, "", "en", ""), (3, "x" * 40_000, "de", ""), (4, "1 2 3 …", "fr", "")]


# --- Toxicity ---


def plain_risk(w, b, x, positive, prior):
    s = 1 / (1 + np.exp(-(x @ w + b)))
    clean = s[~positive].mean() - prior * s[positive].mean()
    return prior * (1 - s[positive]).mean() + max(0.0, clean)


def test_training_lowers_the_corrected_risk():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 12)) < 0.2).astype(float)
    toxic = rng.random(400) < 0.2
    x[toxic, 0] = 1
    positive = toxic & (rng.random(400) < 0.5)
    rows, columns = np.nonzero(x)
    w, b = pu.train_one(rows, columns, positive, 12, 0.2, pu.Settings())
    assert plain_risk(w, b, x, positive, 0.2) < plain_risk(np.zeros(12), math.log(0.25), x, positive, 0.2)
    assert w.argmax() == 0 and ((x @ w + b > 0) == toxic).mean() > 0.8


def test_word_hashes():
    assert pu.word_hashes(None) == pu.word_hashes("") == pu.word_hashes("12 _ !") == []
    assert set(pu.word_hashes("Idiot, idiot!")) == {zlib.crc32(x) for x in (b"idiot", b"idio-")}


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 1), (3, 1)], "doc_id long, toxic int")
    for d, some in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        rows = pu.judge(d, some).collect()
        assert len(rows) == d.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = pu.keep_clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    held = {r.doc_id: r.held_out for r in pu.judge(docs, labels).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None)


def accuracy(spark, name, label, held_out):
    from recordgauge.llm.queries import queries

    rows = queries()[name](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert rows.count() == docs.count()
    wrong_fold = rows.select((F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out[0] == held_out[1]) != F.col("held_out"))
    assert not any(r[0] for r in wrong_fold.collect())
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(F.col(label).isNotNull())
    found = rows.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y")).collect()
    return [(r.predicted, r.y) for r in found]


@tables
def test_toxicity_held_out(spark):
    pairs = accuracy(spark, "op1_pu_toxicity", "toxic", (5, 0))
    right = sum(p == y for p, y in pairs) / len(pairs)
    precision = [y for p, y in pairs if p]
    assert right > 0.96 and sum(precision) / len(precision) > 0.95


# --- Compression ---


def test_sizes_and_dictionaries():
    good = [f"plain words of text number {i} that go on and on".encode() for i in range(200)]
    bad = [f"$$$ BUY!! NOW!! {i} *** %%%".encode() for i in range(200)]
    sizes = cq.Sizes(cq.dictionary(good), cq.dictionary(bad), 3)
    length, as_good, as_bad = sizes.of("plain words of text number 777 that go on and on")
    assert length == 48 and as_good < as_bad
    assert cq.dictionary([]) == b"" and cq.dictionary([b"a"]) == b"a"
    assert cq.Sizes(b"", b"", 3).of(None)[0] == 0


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0), (3, 1), (3, 1), (4, None)], "doc_id long, quality int")
    for d, some in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        rows = cq.judge(d, some).collect()
        assert len(rows) == d.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


@tables
def test_contradictory_quality_labels_are_no_examples(spark):
    rows = [(i, ("good text here " if i % 2 else "#$ x9 %% ") * 20 + str(i), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, i % 2) for i in range(40)]
    both = [(5, 0), (6, 1), (5, 1), (6, 0)]

    def scores(some):
        return {r.doc_id: r.score for r in cq.judge(docs, spark.createDataFrame(some, "doc_id long, quality int")).collect()}

    without = scores([x for x in labels if x[0] not in (5, 6)])
    assert scores(labels + both) == scores(both[::-1] + labels[::-1]) == without


def test_quality_held_out(spark):
    pairs = accuracy(spark, "op6_compression_quality", "quality", (4, 2))
    right = sum(p == y for p, y in pairs) / len(pairs)
    assert right > 0.96 and sum(p for p, y in pairs if y) / sum(y for _, y in pairs) > 0.97


# --- Language ---


def segmentations(word, longest):
    if not word:
        yield []
    for n in range(1, min(longest, len(word)) + 1):
        for rest in segmentations(word[n:], longest):
            yield [word[:n], *rest]


def test_forward_and_counts_equal_all_segmentations():
    rng = random.Random(8)
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        pieces = {word[i:j] for i in range(len(word)) for j in range(i + 1, min(len(word), i + 3) + 1) if rng.random() < 0.7}
        table = {p: rng.random() for p in pieces}
        values = dict(table) | {c: pl.UNKNOWN for c in set(word) if c not in table}
        total, counts = 0.0, {}
        for parts in segmentations(word, 3):
            if all(p in values for p in parts):
                weight = math.prod(values[p] for p in parts)
                total += weight
                for p in parts:
                    counts[p] = counts.get(p, 0.0) + weight
        got = pl.log_probability(word, pl.stepped({p: [v, v / 2] for p, v in table.items()}), 3, 2)
        slow, scales = pl.forward(word, {p: [v, v / 2] for p, v in table.items()}, 3, 2)
        assert scales[-1] == 0 and all(math.isclose(math.log(x), y) for x, y in zip(slow[-1], got, strict=True))
        assert math.isclose(got[0], math.log(total), rel_tol=1e-9)
        expected = pl.expected_counts(word, table, 3)
        assert all(math.isclose(expected[p], c / total, rel_tol=1e-6, abs_tol=1e-12) for p, c in counts.items())


def test_counts_of_long_words_equal_those_of_short_sums(monkeypatch):
    rng = random.Random(5)
    table = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.2, "ba": 0.1, "aba": 0.2, "▁a": 0.1}
    for _ in range(50):
        word = "▁" + "".join(rng.choice("abx") for _ in range(rng.randint(1, 40)))
        direct, logs = pl.expected_counts(word, table, 3), pl._expected_in_logs(word, table, 3)
        assert {p for p, n in direct.items() if n} == {p for p, n in logs.items() if n}
        assert all(direct[p] == pytest.approx(logs[p], rel=1e-9) for p in direct)
    long = pl.expected_counts("▁" + "ab" * 3_000, table, 3)
    assert sum(len(p) * n for p, n in long.items()) == pytest.approx(6_001)


def test_a_language_of_long_words_is_learned(spark):
    rng = random.Random(6)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(60)) for _ in range(20))
    rows = [(i, text("aeiostn"), "one") if i % 2 else (i, text("zkwjyhp"), "two") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = {r.doc_id: r.lang_pred for r in pl.judge(df).collect()}
    assert all(judged[i] == lang for i, _, lang in rows)


def test_very_long_words_do_not_underflow():
    table = {"a": [0.1, 0.2], "aa": [0.01, 0.02]}
    short, long = (pl.log_probability("a" * n, pl.stepped(table), 2, 2) for n in (300, 3_000))
    assert all(math.isfinite(x) for x in long)
    assert math.isclose(long[1] / short[1], 10, rel_tol=0.02)


def test_language_of_odd_tables(spark):
    more = [(i, t, x, None) for i in range(10, 40) for t, x in (("the cat is in the house", "en"), ("das ist nicht gut", "de"))]
    docs = spark.createDataFrame(odd_rows() + more, DOCS).withColumn("lang_pred", F.lit("mine"))
    rows = pl.judge(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1, 2, 4)] == ["und"] * 3 and by_id[1].score == 0
    assert by_id[None].lang_pred in ("en", "de")
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in pl.judge(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert pl.judge(docs.limit(0)).count() == 0


def test_model_survives_its_own_bound(monkeypatch):
    monkeypatch.setattr(pl, "MAX_WORDS", 8)
    model = pl.Model(["x", "y"], np.zeros(2), {"a": [0.9, 0.1], "b": [0.1, 0.9], pl._MARK: [0.5, 0.5]})
    assert model.predict("aaab a aa aab " * 50)[0] == "x" and model.predict("b bb bba bbb " * 50)[0] == "y"


@tables
def test_language_held_out(spark):
    from recordgauge.llm.queries import queries

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = queries()["op8_piece_language"](spark, SF_DIR).where("held_out").join(docs, "doc_id").collect()
    known = [r for r in rows if r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.98
