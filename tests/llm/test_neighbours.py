import numpy as np
import pytest
from pyspark.sql import functions as F

from recordgauge.llm import nn_descent as nn

SMALL = nn.Settings(neighbours=8, rounds=4, kept=64, expanded=16, trees=3)


def brute(rows, query_ids, k=5):
    """Per query row the nearest other rows: cosine in double precision, ties to the smaller id."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and (v != 0).any()]
    found = {}
    for q, (i, v) in enumerate(usable):
        if i in query_ids:
            others = [(-float(v @ w) / float(np.sqrt(v @ v) * np.sqrt(w @ w)), j) for o, (j, w) in enumerate(usable) if o != q]
            found.setdefault(i, []).append([(j, -s) for s, j in sorted((round(s, 12), j) for s, j in others)[:k]])
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))


def result(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return found


def test_small_table_is_searched_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-8, 9, 6).astype(float).tolist()) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(100, 130)]  # a group of copies
    rows += [(200, [2 * x for x in rows[4][1]]), (201, [0.0] * 6), (202, None), (None, rows[5][1]), (203, [1.0, 2.0])]
    rows += [(204, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (205, [float("nan")] + [1.0] * 5), (206, [float("inf")] + [1.0] * 5)]
    got = result(nn.nearest(frame(spark, rows), "id % 10 = 0", s=SMALL))
    expected = brute([r for r in rows if r[0] != 203], {i for i, _ in rows if i is not None and i % 10 == 0})
    assert got.keys() == expected.keys()
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [round(s, 9) for _, _, s in found] == [round(s, 9) for _, s in expected[q][0]], q
        assert [i for _, i, _ in found] == [i for i, _ in expected[q][0]], q


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0])]
    got = result(nn.nearest(frame(spark, rows), "id % 50 = 0", s=SMALL))
    assert {q: [i for _, i, _ in f] for q, f in got.items()} == {0: [50], 50: [0]}
    assert nn.nearest(frame(spark, rows[:1]), "id = 0", s=SMALL).count() == 0
    assert nn.nearest(frame(spark, rows).limit(0), "id = 0", s=SMALL).count() == 0


def test_extreme_magnitudes(spark):
    rows = [(0, [1e-30, 0.0]), (1, [3e38, 1e38]), (2, [-1e-38, 1e-38])]
    got = result(nn.nearest(frame(spark, rows), "id = 0", s=SMALL))[0]
    assert [i for _, i, _ in got] == [1, 2] and got[0][2] == pytest.approx(3 / 10**0.5) and got[1][2] == pytest.approx(-(0.5**0.5))


def test_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1_500, 24)))]
    got = result(nn.nearest(frame(spark, rows).repartition(5), "id % 50 = 0"))
    expected = brute(rows, set(range(0, 1_500, 50)))
    hits = [i in {j for _, j, _ in got[q]} for q, lists in expected.items() for i, _ in lists[0]]
    assert sum(hits) / len(hits) >= 0.95


def recall(spark, vectors, step):
    """Share of the true nearest by score: a row as near as the fifth counts, whatever its id."""
    got = result(nn.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(5), f"id % {step} = 0"))
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(x), step):
        sims = x @ x[q]
        sims[q] = -2
        fifth = np.sort(sims)[-5]
        hits += [score >= fifth - 1e-12 for _, _, score in got[q]]
        assert len(got[q]) == 5
    return sum(hits) / len(hits)


@pytest.mark.parametrize("spread", [0.05, 0.001])
def test_recall_in_clusters(spark, spread):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 64))
    assert recall(spark, np.repeat(centres, 250, axis=0) + spread * rng.normal(size=(1_500, 64)), 25) >= 0.95


def test_recall_with_a_third_of_near_copies(spark):
    rng = np.random.default_rng(9)
    near = rng.normal(size=64) + 0.02 * rng.normal(size=(600, 64))
    assert recall(spark, np.concatenate([near, rng.normal(size=(1_200, 64))]), 20) >= 0.95


def test_a_node_alone_on_its_side_of_every_plane_is_linked(spark):
    rng = np.random.default_rng(10)
    centre = rng.normal(size=16)
    cone = centre + 0.05 * rng.normal(size=(1_500, 16))
    outliers = np.stack([-centre, -3 * centre + 0.1])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([outliers[:1], cone, outliers[1:]]))]
    got = result(nn.nearest(frame(spark, rows), "id % 500 = 0 or id = 1501", s=SMALL))
    assert {q: [r for r, _, _ in f] for q, f in got.items()} == dict.fromkeys([0, 500, 1000, 1500, 1501], [1, 2, 3, 4, 5])
    lone = [(i, v.tolist()) for i, v in enumerate(np.concatenate([outliers[:1], cone]))]
    assert len(result(nn.nearest(frame(spark, lone), "id = 0", s=SMALL))[0]) == 5


def test_no_group_grows_with_near_copies_or_a_common_direction(spark):
    rng = np.random.default_rng(11)
    centre = 2 * rng.normal(size=32)
    copies = centre + 0.01 * rng.normal(size=(4_000, 32))
    vectors = np.concatenate([copies, centre + rng.normal(size=(8_000, 32))])
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    nodes, path = nn._nodes(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), SMALL)
    sizes = nn._blocks(nodes, 12_000, 32, SMALL).groupBy("tree", "block", "part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * nn.BLOCK + 100
    assert nn._blocks(nodes, 12_000, 32, SMALL).count() == 12_000 * (SMALL.trees + 1)
    nn.discard(spark, path)
    hub = spark.range(1, 20_001).selectExpr("id as a", "0L as b", "false as old")
    parts, _ = nn._members(hub, 0)
    assert parts.count() == 40_000 and parts.groupBy("at", "part").count().agg(F.max("count")).first()[0] <= 2 * nn.HUB


def test_a_node_in_50_000_lists_is_no_hot_key(spark, monkeypatch):
    n = 50_000
    hub = spark.range(1, n + 1, 1, 8).selectExpr("id as a", "0L as b", "0.5 + id / 1e6 as sim", "false as old", "0 as place")
    members, hubs = nn._members(hub, 0)
    hubs = hubs.withColumnRenamed("at", "node")
    codes = spark.range(n + 1).selectExpr("id as node", "id * 2 as code")
    joined = nn._joined(members, codes, "node", "at", hubs)
    assert joined.columns == ["node", "at", "fresh", "part", "code"]
    assert joined.count() == 2 * n and joined.where("code <> 2 * node").count() == 0
    dealt = nn._in_parts(members.drop("part"), hubs, [F.col("at")], "node").groupBy("node", "part").count()
    assert dealt.agg(F.max("count")).first()[0] <= 2 * nn.HUB
    # Many hubs stay a table: the same rows without a broadcast.
    monkeypatch.setattr(nn, "MOST_BROADCAST", 0)
    members, hubs = nn._members(hub, 0)
    plan = nn._joined(members, codes, "node", "at", hubs.withColumnRenamed("at", "node"))
    assert plan.count() == 2 * n
    # What a hub is sent is cut in each task, and its best are those of all rows.
    back = hub.selectExpr("b as a", "a as b", "sim", "old")
    cut = nn._best_of_task(back, 32)
    assert cut.count() <= 32 * 8
    best = nn._best(cut, 32).orderBy("place").collect()
    assert [r.b for r in best] == list(range(n, n - 32, -1))


def test_recall_with_hubs(spark):
    """Few dimensions' worth of directions added to many: some vectors are near to most others."""
    rng = np.random.default_rng(12)
    scale = 1 / np.arange(1, 49) ** 0.5
    vectors = rng.normal(size=(2_000, 48)) * scale + 0.8 * scale
    vectors[:20] = 0.8 * scale + 0.01 * rng.normal(size=(20, 48))
    assert recall(spark, vectors, 25) >= 0.95


def test_a_group_in_several_batches_is_not_cut():
    class Two:
        num_rows = 2

        def combine_chunks(self):
            return self

        def to_batches(self):
            return [1, 2]

    with pytest.raises(ValueError):
        nn._one(Two())
