import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.llm import source_mixing as m

COLUMNS = "doc_id long, text string, lang string, source string, topic string"


def corpus(spark, n=3_000):
    rng = np.random.default_rng(4)
    rows = [
        (i, "w " * int(rng.integers(1, 60)), "en" if rng.random() < 0.7 else "de", f"s{min(3, int(rng.exponential()))}", f"t{i % 3}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, COLUMNS), rows


def plain_rake(cells, targets, sweeps=200):
    w = {c: float(t) for c, t in cells.items()}
    total = sum(w.values())
    for _ in range(sweeps):
        for d in range(3):
            held = {}
            for c, x in w.items():
                held[c[d]] = held.get(c[d], 0.0) + x
            w = {c: x * targets[d][c[d]] * total / held[c[d]] for c, x in w.items()}
    return w


def test_weights_equal_plain_raking(spark):
    docs, rows = corpus(spark)
    cells = {}
    for _, text, lang, source, topic in rows:
        cells[source, lang, topic] = cells.get((source, lang, topic), 0) + len(text.split())
    targets = []
    for d in range(3):
        sums = {}
        for c, t in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + t
        shares = {v: t**0.7 for v, t in sums.items()}
        targets.append({v: s / sum(shares.values()) for v, s in shares.items()})
    expected = plain_rake(cells, targets)
    got = m.mixed(docs, m.Settings(tolerance=1e-9)).select("source", "lang", "topic", "weight", "probability").distinct().collect()
    assert len(got) == len(cells)
    for r in got:
        assert r.weight == pytest.approx(expected[r.source, r.lang, r.topic], rel=1e-6)
    chances = {(r.source, r.lang, r.topic): r.probability for r in got}
    assert sum(t * chances[c] for c, t in cells.items()) == pytest.approx(0.8 * sum(cells.values()), rel=1e-6)
    open_ones = [chances[c] * t / expected[c] for c, t in cells.items() if chances[c] < 1]
    assert max(open_ones) == pytest.approx(min(open_ones), rel=1e-6)


def test_given_targets_and_sample(spark):
    docs, rows = corpus(spark)
    s = m.Settings(keep=0.4, targets={"lang": {"en": 1, "de": 1, "xx": 5}})
    kept = m.sample(docs, s)
    assert kept.columns == docs.columns
    tokens = {r.lang: r.n for r in kept.groupBy("lang").agg(F.sum(m.tokens(F.col("text"))).alias("n")).collect()}
    assert tokens["en"] / tokens["de"] == pytest.approx(1, abs=0.15)
    assert sum(tokens.values()) == pytest.approx(0.4 * sum(len(r[1].split()) for r in rows), rel=0.06)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in m.sample(docs.repartition(3), s).collect())
    with pytest.raises(ValueError, match="lang"):
        m.sample(docs, m.Settings(targets={"lang": {"xx": 1}})).count()


def test_odd_tables(spark):
    rows = [(None, "a b", None, None, None), (1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", "en", None, "t"), (3, "x " * 40_000, "de", "s", "t")]
    docs = spark.createDataFrame(rows, COLUMNS)
    clashing = docs.drop("topic").withColumn("Weight", F.lit("mine")).withColumn("kept", F.lit("no")).withColumn("n_tokens", F.lit("?"))
    everything = m.Settings(keep=1.0)
    for d in (docs, clashing):
        rows_out = m.mixed(d, everything).collect()
        assert len(rows_out) == 5 and all(0 < r.probability <= 1 for r in rows_out)
        kept = m.sample(d, everything)
        assert kept.columns == d.columns and kept.count() == 5
    assert {r.n_tokens for r in m.sample(clashing, everything).collect()} == {"?"}
    assert m.sample(docs.limit(0)).count() == 0 and m.mixed(clashing.limit(0)).count() == 0


def test_topics(spark):
    texts = {"": "blank", None: "blank", "a | b | c |": "tabular", "x%%% y###": "marked", "some words": "brief", "w " * 200: "prose", "w " * 1_500: "treatise"}
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = m.mixed(docs, m.Settings(keep=1.0)).collect()
    assert {r.text: r.topic for r in rows} == texts


def test_an_unconverged_fit_says_so(spark):
    # Every text of source a is in one language, so these targets contradict each other.
    rows = [(i, "one two three", "en" if i < 5 else "de", "a" if i < 5 else "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    fitted = m.mixed(docs, m.Settings(targets=targets, max_sweeps=5)).first().fit_error
    assert fitted > m.Settings().tolerance
    assert m.mixed(docs).first().fit_error <= m.Settings().tolerance
