"""Approximate nearest neighbours: a graph by NN-descent, searched greedily from every query.

Equal vectors are one node of the graph, with as many of their smallest ids as a result can
need, so groups of copies neither fill each other's neighbour lists nor make pairs. A node's
code is its vector in single precision, scaled by a power of two (exact for single precision
vectors); the cosine of two codes in double precision guides building and searching. Reported
scores are computed in double precision from the original vectors of the ``rescored`` best nodes
of each query and of those that tie with the last of them within the codes' rounding.

Building. Random hyperplanes through the mean direction cut the nodes into small blocks, a few times over; each node's
nearest of its blocks are its first neighbours. A block that many share, as near copies do, is
dealt to parts of about ``BLOCK`` by a hash that differs from cut to cut. One more cut, by a hash into groups of about
``GROUP``, gives links to nodes that share no block with another. Then rounds of NN-descent: a join sends every
node's code to the nodes it is a neighbour of and that are its neighbours, there all members
meet (neighbours of neighbours), and each member learns of the closest ones it did not know.
Only pairs with a link that is new in this round are looked at. A node's list has ``neighbours``
entries; a node many others point to takes its members in groups of ``GROUP`` in random order,
and more than ``HUB`` of them in several tasks. Such a node is itself a member of many meetings:
copies of its code go to as many parts as it has ``HUB`` of them, and of what it learns every
task keeps the best before rows are dealt by node, so it gets ``neighbours`` rows a task at most.

Searching. A query that is a node starts there and at its own neighbours; each round expands the
``expanded`` best nodes not yet expanded among its best ``kept``, by joins with the links and
the codes, until no query has any left or after ``search_rounds``. Codes are fetched only for
pairs of query and node that the query's list does not hold; nodes that many queries reach are
dealt to parts as well.

Every round is a written table. Only counts and the mean direction reach the driver; the keys of
large blocks and hubs, at most one for ``HUB`` rows, are sent to all tasks while they are no more
than ``MOST_BROADCAST``.

Defined results: vectors that are null, zero, hold a null or non-finite component, have a null
id or another dimension than most (ties: the smaller) take no part; a query finds all others if
there are fewer than asked for; rows with equal ids and vectors are candidates of one another;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordgauge.plans.scratch import discard, staged

GROUP = 64
#: Rows of a few numbers each; more are joined without a hint.
MOST_BROADCAST = 100_000
BLOCK = 512
HUB = 16 * GROUP
_LEAST = -9.0
#: Cosines of codes that differ by no more than this may be in the other order.
_ROUNDING = 2.0**-22


@dataclass(frozen=True)
class Settings:
    nearest: int = 5
    neighbours: int = 32
    trees: int = 4
    rounds: int = 6
    #: Of the closest members of a group, so many are made known to a member.
    introduced: int = 8
    kept: int = 192
    expanded: int = 64
    search_rounds: int = 14
    rescored: int = 32
    seed: int = 17


# --- Arrow and numpy helpers ---------------------------------------------------------------


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _codes(batch: pa.RecordBatch, name: str = "code") -> np.ndarray:
    """The codes of a batch as unit vectors in double precision."""
    rows = batch.column(name).to_pylist()
    x = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted arrays, and their length at the end."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), dtype=bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def _whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The sorted rows, cut only where a key changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_column(batch, k) for k in keys]
        last = int(_starts(*columns)[-2])
        if last == 0 and held and all(_column(held[-1], k)[-1] == c[0] for k, c in zip(keys, columns, strict=True)):
            held.append(batch)
            continue
        if held and all(_column(held[-1], k)[-1] == c[0] for k, c in zip(keys, columns, strict=True)):
            first = int(_starts(*columns)[1])
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            if last > first:
                yield pa.Table.from_batches([batch.slice(first, last - first)])
        else:
            if held:
                yield pa.Table.from_batches(held)
            if last:
                yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _one(table: pa.Table) -> pa.RecordBatch:
    batches = table.combine_chunks().to_batches()
    if len(batches) != 1:
        raise ValueError(f"a group of {table.num_rows} rows does not fit in one Arrow batch")
    return batches[0]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})


_EDGES = "a long, b long, sim double, old boolean, place int"


def _top(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by a: the best ``size`` different b of each; old if one of equal rows is."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, "a"):
            batch = _one(table)
            a, b, sim, old = (_column(batch, c) for c in ("a", "b", "sim", "old"))
            # Equal pairs may differ in the last bits of sim, so they are found by a and b alone.
            order = np.lexsort((~old, b, a))
            order = order[_starts(a[order], b[order])[:-1]]
            order = order[np.lexsort((b[order], -sim[order], a[order]))]
            a, b, sim, old = a[order], b[order], sim[order], old[order]
            bounds = _starts(a)
            place = np.arange(len(a)) - np.repeat(bounds[:-1], np.diff(bounds))
            kept = place < size
            yield _batch(a=a[kept], b=b[kept], sim=sim[kept], old=old[kept], place=place[kept].astype(np.int32))

    return keep


def _best(rows: DataFrame, size: int) -> DataFrame:
    return rows.select("a", "b", "sim", "old").repartition("a").sortWithinPartitions("a").mapInArrow(_top(size), _EDGES)


def _best_of_task(rows: DataFrame, size: int) -> DataFrame:
    """The best ``size`` of each a in each task, before any shuffle: what is lost is in no best."""
    columns = ["a", "b", "sim", "old"]
    return rows.select(*columns).sortWithinPartitions("a").mapInArrow(_top(size), _EDGES).select(*columns)


def _closest(sims: np.ndarray, count: int) -> np.ndarray:
    count = min(count, sims.shape[1])
    return np.argpartition(-sims, count - 1, axis=1)[:, :count]


# --- Nodes ---------------------------------------------------------------------------------


def _nodes(vectors: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """(node, vector, ids, code) of the different vectors that take part."""
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    sizes = usable.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    ranked = usable.where(F.size(v) == d).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    )
    classes = (
        ranked.where(F.col("_rank") <= s.nearest + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("node"), "vector", "ids")
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("vector").to_pylist(), dtype=np.float64)
            # So that no square overflows or vanishes; a power of two rounds nothing.
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
            code = [row.tobytes() for row in x.astype(np.float32)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("vector"), batch.column("ids"), pa.array(code, pa.binary())],
                names=["node", "vector", "ids", "code"],
            )

    return staged(classes.mapInArrow(coded, "node long, vector array<double>, ids array<long>, code binary"), "ann-nodes")


# --- The graph -----------------------------------------------------------------------------


def _mean(nodes: DataFrame, n: int, d: int) -> np.ndarray:
    """The mean of the nodes' unit vectors, from one sum a task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                total += _codes(batch).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total], pa.list_(pa.float64()))})

    totals = nodes.select("code").mapInArrow(summed, "total array<double>").collect()
    return np.sum([r.total for r in totals] or [np.zeros(d)], axis=0) / max(1, n)


def _large(rows: DataFrame, size: int, *keys: str) -> DataFrame | None:
    """(keys, _parts) of the groups of more than twice ``size`` rows; None without any.

    Their number grows with the rows, so only few are fetched and broadcast; more stay a table.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * size)
    large = counts.select(*keys, F.ceil(F.col("_n") / size).alias("_parts"))
    few = large.limit(MOST_BROADCAST + 1).collect()
    if not few:
        return None
    if len(few) > MOST_BROADCAST:
        return staged(large, "ann-large")[0]
    return F.broadcast(spark.createDataFrame(few, large.schema))


def _in_parts(rows: DataFrame, large: DataFrame | None, salt: list, *keys: str) -> DataFrame:
    """``rows`` with ``part``, by a hash that deals the ``large`` groups to their number of parts."""
    if large is None:
        return rows.withColumn("part", F.lit(0).cast("long"))
    part = F.pmod(F.xxhash64(*salt), F.coalesce("_parts", F.lit(1))).alias("part")
    return rows.join(large, [*keys], "left").select(*rows.columns, part)


def _joined(many: DataFrame, one: DataFrame, key: str, by: str, large: DataFrame | None) -> DataFrame:
    """``many`` with the row ``one`` has for ``key``, which is copied to every part of a ``large`` one."""
    if large is None:
        return many.join(one, key)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_copy")
    dealt = _in_parts(many.withColumnRenamed("part", "_kept"), large, [F.col(by)], key).withColumnRenamed("part", "_copy")
    copied = one.join(large, key, "left").select(*one.columns, copies)
    return dealt.join(copied, [key, "_copy"]).drop("_copy").withColumnRenamed("_kept", "part")


def _blocks(nodes: DataFrame, n: int, d: int, s: Settings) -> DataFrame:
    """(tree, block, node, code, part): the groups of nodes on the same sides of random hyperplanes."""
    bits = max(0, math.ceil(math.log2(max(1.0, n / (BLOCK / 2)))))
    planes = np.random.default_rng(s.seed).normal(size=(s.trees, d, bits))
    mean = _mean(nodes, n, d)
    groups = max(1, n // GROUP)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _codes(batch) - mean
            for tree in range(s.trees):
                sides = (x @ planes[tree] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(sides.astype(np.int64)), batch.column("node"), batch.column("code")],
                    names=["tree", "block", "node", "code"],
                )

    dealt = nodes.select(
        F.lit(s.trees).alias("tree"), F.pmod(F.xxhash64(F.lit(s.seed), "node"), F.lit(groups)).alias("block"), "node", "code"
    )
    rows = nodes.select("node", "code").mapInArrow(placed, "tree int, block long, node long, code binary").unionAll(dealt)
    large = _large(rows, BLOCK, "tree", "block")
    return _in_parts(rows, large, [F.lit(s.seed + 1), F.col("tree"), F.col("node")], "tree", "block")


def _first_links(nodes: DataFrame, n: int, d: int, s: Settings) -> DataFrame:
    """(a, b, sim, old) within the parts of the blocks."""

    def cut(low: int, high: int) -> np.ndarray:
        """Bounds of slices of at most ``BLOCK`` rows, as even as can be: none is of one row alone."""
        return np.linspace(low, high, math.ceil((high - low) / BLOCK) + 1).astype(int)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, "tree", "block", "part"):
            whole = _one(table)
            bounds = _starts(*(_column(whole, k) for k in ("tree", "block", "part")))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                at = cut(low, high)
                for first, after in zip(at[:-1], at[1:], strict=True):
                    some = whole.slice(first, after - first)
                    if some.num_rows < 2:
                        continue
                    node, x = _column(some, "node"), _codes(some)
                    sims = x @ x.T
                    np.fill_diagonal(sims, _LEAST)
                    near = _closest(sims, min(s.neighbours // 2, len(node) - 1))
                    a = np.repeat(node, near.shape[1])
                    sim = np.take_along_axis(sims, near, axis=1).ravel()
                    yield _batch(a=a, b=node[near.ravel()], sim=sim, old=np.zeros(len(a), dtype=bool))

    return (
        _blocks(nodes, n, d, s)
        .repartition("tree", "block", "part")
        .sortWithinPartitions("tree", "block", "part", F.xxhash64("tree", "node"))
        .mapInArrow(linked, "a long, b long, sim double, old boolean")
    )


def _members(graph: DataFrame, round_: int) -> tuple[DataFrame, DataFrame | None]:
    """(at, node, fresh, part): who meets at which node, in parts where it is many; and those hubs.

    Every link is there in both directions, so a node is as often ``at`` as it is ``node``.
    """
    fresh = (~F.col("old")).alias("fresh")
    ends = graph.select(F.col("b").alias("at"), F.col("a").alias("node"), fresh).unionAll(
        graph.select(F.col("a").alias("at"), F.col("b").alias("node"), fresh)
    )
    large = _large(ends, HUB, "at")
    return _in_parts(ends, large, [F.lit(round_), F.col("at"), F.col("node")], "at"), large


def _introductions(nodes: DataFrame, graph: DataFrame, round_: int, s: Settings) -> DataFrame:
    """One NN-descent join: what the neighbours of every node's neighbours learn of each other."""
    bars = graph.where(F.col("place") == s.neighbours - 1).select(F.col("a").alias("node"), F.col("sim").alias("bar"))
    known = nodes.select("node", "code").join(bars, "node", "left").select("node", "code", F.coalesce("bar", F.lit(_LEAST)).alias("bar"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, "at", "part"):
            whole = _one(table)
            at, node, bar, fresh = (_column(whole, c) for c in ("at", "node", "bar", "fresh"))
            x = _codes(whole)
            found: list[tuple[np.ndarray, ...]] = []
            bounds = _starts(at, _column(whole, "part"))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                for first in range(low, high, GROUP):
                    part = slice(first, min(first + GROUP, high))
                    new = fresh[part]
                    if part.stop - first < 2 or not new.any():
                        continue
                    who = node[part]
                    sims = x[part] @ x[part].T
                    sims[~(new[:, None] | new[None, :])] = _LEAST
                    sims[who[:, None] == who[None, :]] = _LEAST
                    near = _closest(sims, s.introduced)
                    sim = np.take_along_axis(sims, near, axis=1)
                    better = sim > bar[part][:, None]
                    found.append((np.repeat(who, near.shape[1])[better.ravel()], who[near[better]], sim[better]))
            if found:
                a, b, sim = (np.concatenate(c) for c in zip(*found, strict=True))
                yield _batch(a=a, b=b, sim=sim, old=np.zeros(len(a), dtype=bool))

    members, hubs = _members(graph, round_)
    if hubs is not None:
        hubs = hubs.withColumnRenamed("at", "node")
    return (
        _joined(members, known, "node", "at", hubs)
        .repartition("at", "part")
        .sortWithinPartitions("at", "part", F.xxhash64(F.lit(round_), "node"))
        .mapInArrow(meet, "a long, b long, sim double, old boolean")
    )


def build(nodes: DataFrame, n: int, d: int, s: Settings) -> tuple[DataFrame, str]:
    """The neighbour graph: a's best ``neighbours`` b, with their similarity and place."""
    spark = nodes.sparkSession
    graph, path = staged(_best(_first_links(nodes, n, d, s), s.neighbours), "ann-graph")
    for round_ in range(s.rounds):
        met = _best_of_task(_introductions(nodes, graph, round_, s), s.neighbours)
        known = graph.select("a", "b", "sim", F.lit(True).alias("old"))
        before = path
        graph, path = staged(_best(known.unionAll(met), s.neighbours), "ann-graph")
        discard(spark, before)
        if not graph.where(~F.col("old")).take(1):
            break
    return graph, path


# --- Searching -----------------------------------------------------------------------------


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a, with the similarity of those that come with a code instead.

    Every a has one row with a equal to b, which holds its own code.
    """
    for table in _whole_runs(batches, "a"):
        batch = _one(table)
        a, b = _column(batch, "a"), _column(batch, "b")
        new = batch.column("sim").is_null().to_numpy(zero_copy_only=False)
        sim = batch.column("sim").fill_null(_LEAST).to_numpy(zero_copy_only=False).copy()
        own = batch.filter(pa.array(a == b))
        if new.any():
            place = np.searchsorted(_column(own, "a"), a[new])
            sim[new] = np.einsum("ij,ij->i", _codes(batch.filter(pa.array(new))), _codes(own)[place])
        yield _batch(a=a, b=b, sim=sim, old=_column(batch, "old"))


def _next(s: Settings):
    """The best nodes of each query, with those to expand next marked by place below zero."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _top(s.kept)(_compared(batches)):
            a, old, place = _column(batch, "a"), _column(batch, "old"), _column(batch, "place").copy()
            waiting = np.cumsum(~old)
            bounds = _starts(a)
            before = np.repeat(np.concatenate([[0], waiting])[bounds[:-1]], np.diff(bounds))
            place[~old & (waiting - before <= s.expanded)] = -1
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("sim"), batch.column("old"), pa.array(place)],
                names=["a", "b", "sim", "old", "place"],
            )

    return step


def _advanced(rows: DataFrame, s: Settings) -> DataFrame:
    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(_next(s), _EDGES)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """(a, b, sim, …): for each node of ``queries`` its best nodes, by greedy search of the graph."""
    spark = nodes.sparkSession
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "old")
    both = graph.select("a", "b", "sim", "old").unionAll(_best_of_task(back, 2 * s.neighbours))
    links, path_links = staged(
        _best(both, 2 * s.neighbours).groupBy("a").agg(F.collect_list("b").alias("bs")).withColumnRenamed("a", "via"),
        "ann-links",
    )
    codes = nodes.select(F.col("node").alias("b"), "code")
    own = queries.select(
        F.col("node").alias("a"), F.col("node").alias("b"), F.lit(2.0).alias("sim"), F.lit(False).alias("old"), "code"
    )
    state, path = staged(_advanced(own, s), "ann-search")
    for _ in range(s.search_rounds):
        picked = state.where("place < 0").select("a", F.col("b").alias("via"))
        if not picked.take(1):
            break
        reached = _joined(picked, links, "via", "a", _large(picked, HUB, "via")).select("a", F.explode("bs").alias("b"))
        # Dealt by the pair, so no query and no node is hot, and written to be counted and joined.
        new, path_new = staged(reached.distinct().join(state.select("a", "b"), ["a", "b"], "left_anti"), "ann-new")
        found = _joined(new, codes, "b", "a", _large(new, HUB, "b")).select(
            "a", "b", F.lit(None).cast("double").alias("sim"), F.lit(False).alias("old"), "code"
        )
        known = state.where("a <> b").select("a", "b", "sim", (F.col("old") | (F.col("place") < 0)).alias("old"), F.lit(None).cast("binary").alias("code"))
        before = path
        state, path = staged(_advanced(known.unionAll(found).unionAll(own.withColumn("old", F.lit(True))), s), "ann-search")
        discard(spark, before, path_new)
    discard(spark, path_links)
    return state, path


def _cosine(one: str, other: str):
    """Cosine in double precision; the scaling keeps squares from overflowing."""

    def of(x: str):
        v = F.col(x)
        largest = F.array(F.array_max(F.transform(v, F.abs)))
        return F.transform(largest, lambda m: F.transform(v, lambda c: c / m))[0]

    def dot(p, q):
        return F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    p, q = of(one), of(other)
    return dot(p, q) / (F.sqrt(dot(p, p)) * F.sqrt(dot(q, q)))


def nearest(
    vectors: DataFrame, queries: str, vec_id: str = "vec_id", embedding: str = "embedding", s: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every row that meets ``queries``.

    ``queries`` is a SQL condition on ``id``.
    """
    spark = vectors.sparkSession
    slim = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector")
    )
    nodes, path_nodes = _nodes(slim, s)
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    graph, path_graph = build(nodes, size.n, size.d or 0, s)
    # All rows that ask, joined with the node that holds their vector.
    asking, path_asking = staged(
        slim.where(queries).join(nodes.select("vector", "node", "code"), "vector").select("id", "node", "code"), "ann-queries"
    )
    found, path_found = search(nodes, graph, asking.dropDuplicates(["node"]).select("node", "code"), s)
    top = found.where(F.col("b") != F.col("a")).select(
        "a", "b", "sim", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")).alias("_near")
    )
    last = F.max(F.when(F.col("_near") == s.rescored, F.col("sim"))).over(Window.partitionBy("a"))
    top = top.withColumn("_last", F.coalesce(last, F.lit(_LEAST)))
    pairs = top.where((F.col("_near") <= s.rescored) | (F.col("sim") >= F.col("_last") - _ROUNDING)).select("a", "b").unionAll(
        asking.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    )
    left = nodes.select(F.col("node").alias("a"), F.col("vector").alias("va"))
    right = nodes.select(F.col("node").alias("b"), F.col("vector").alias("vb"), "ids")
    scored = pairs.join(left, "a").join(right, "b").select("a", "ids", _cosine("va", "vb").alias("score"))
    # Per class at most nearest + 1 ids, so a query's candidates are bounded.
    candidates = scored.select(F.col("a").alias("node"), "score", F.explode("ids").alias("vec_id"))
    wanted = candidates.groupBy("node").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, s.nearest + 1).alias("best")
    )
    # A query's own row is one of them or beyond them; without it the first ones are its nearest.
    own = F.array_position(F.transform("best", lambda x: x.vec_id), F.col("id")).cast("int")
    without = F.filter("best", lambda x, i: (own == 0) | (i != own - 1))
    result, _ = staged(
        asking.select("id", "node")
        .join(wanted, "node")
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(without, 1, s.nearest)).alias("_at", "_one"))
        .select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_one.vec_id").alias("vec_id"), (-F.col("_one.minus")).alias("score")),
        "ann-result",
    )
    discard(spark, path_nodes, path_graph, path_asking, path_found)
    return result
