"""Prefix trie of conversations by vertical bitmaps.

A node is a sequence of turns that conversations begin with. Conversations are dealt by range to
shards of at most ``SHARD`` consecutive ids. A shard indexes (position, turn) to the bitset of
its conversations that have this turn there, and walks depth first: the posting of the lowest
member that is left, intersected with the parent's bitset, is a child; its population count is
the number of members, its lowest bit the smallest of them, and its intersection with the
conversations that end here is the shard's end list, ascending. So a node costs a shard one
intersection, and a shard sends one row for each node, however many conversations it has.

Turns travel as 128-bit digests, never as texts. A node's key is the exclusive or of its turns'
digests, each mixed with its position. Conversations are cut into bands of ``BAND`` positions,
which are shards of their own and begin at the key that the earlier bands give, so that a very
long conversation is not one task's work either.

The shards' rows are added up by key. A node is then named by its smallest member and its depth.
The nodes of one name form a chain downwards, and a subtree is the rest of its chain and the
chains attached to that: sums go from chains to the chains they are attached to until none is
left, one round for each level of chains on chains, each round written to the shared folder.

Defined results: rows with a null conv_id are left out; a null turn comes first; of equal turn
numbers the smaller role, then the smaller text comes first; null role and text are empty;
repeated rows are turns of their own; other columns are not read; an empty table has no
conversation, hence no node, not even the root. ``conv_id - conv_id % 100`` keeps the sign of a
negative id (-150 belongs to -100).

Skew: a hot parent (or the root) in the join for its name and a hot conversation in the joins on
conv_id are split by adaptive execution; everything else is aggregated before it is shuffled. A
node's end lists meet in one task, as their hash is one sequence, but as one short row a shard,
read in order and not held.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordgauge.llm.sql_parts import crc32_of_bytes, crc32_table
from recordgauge.plans.scratch import discard, staged

SHARD = 1024
BAND = 64
#: Conversations whose ids share all but the last two digits can share an opening.
FAMILY = 100
OPENINGS = 6

_SHARD_SCHEMA = (
    "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, "
    "code_points long, ends array<long>"
)
_SHARD_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "code_points")]
    + [("ends", pa.list_(pa.int64()))]
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, t1, t2, code_points): the turns in order, as digests."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        text["role"].alias("role"),
        text["text"].alias("text"),
    ).where("conv_id IS NOT NULL")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select(
        "conv_id",
        F.row_number().over(in_order).cast("long").alias("position"),
        _half(digest, 1).alias("t1"),
        _half(digest, 17).alias("t2"),
        F.length("text").cast("long").alias("code_points"),
    )


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def opening_length(conv_id: Column) -> Column:
    """How many turns of its family's first conversation a conversation opens with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the rebuilt conversations, from ``ordered_turns`` (read repeatedly).

    Returns (conv_id, position, t1, t2, code_points) and (conv_id, n_turns).
    """
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    opens = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < OPENINGS))
    bases = opens.groupBy(F.col("conv_id").alias("first")).agg(F.max("position").alias("given"))
    members = (
        turns.groupBy("conv_id")
        .agg(F.max("position").alias("n"))
        .select("conv_id", "n", first.alias("first"), F.when(F.col("conv_id") != first, opening_length(F.col("conv_id"))).otherwise(0).alias("h"))
        .join(bases, "first", "left")
        .select("conv_id", "first", "n", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"))
    )
    own = turns.join(members.select("conv_id", "h", "taken"), "conv_id").where("position > h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "t1", "t2", "code_points"
    )
    shared = (
        members.where("taken > 0")
        .select("conv_id", "first", "taken")
        .join(opens.withColumnRenamed("conv_id", "first"), "first")
        .where("position <= taken")
        .select("conv_id", "position", "t1", "t2", "code_points")
    )
    lengths = members.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return own.unionAll(shared), lengths


def shard_nodes(turns: DataFrame, lengths: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """A row for each node and shard: keys, depth, members, smallest member, end list."""
    rows = turns.select(
        "conv_id",
        "position",
        F.xxhash64("position", "t1", "t2").alias("k1"),
        F.xxhash64("t2", "position", "t1").alias("k2"),
        "code_points",
    )
    roots = lengths.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("position", "k1", "k2", "code_points")))
    parts = rows.join(lengths, "conv_id").unionAll(roots.join(lengths, "conv_id"))
    parts = parts.withColumn("band", F.floor(F.col("position") / band).cast("long"))
    earlier = Window.partitionBy("conv_id").orderBy("band").rangeBetween(Window.unboundedPreceding, -1)
    entered = parts.select(
        "band",
        "conv_id",
        "position",
        "k1",
        "k2",
        *(F.coalesce(F.bit_xor(k).over(earlier), F.lit(0)).alias(e) for k, e in (("k1", "e1"), ("k2", "e2"))),
        "code_points",
        (F.col("position") == F.col("n_turns")).alias("last"),
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walked(batches, shard)

    return (
        entered.repartitionByRange("band", "conv_id")
        .sortWithinPartitions("band", "conv_id", "position")
        .mapInArrow(walk, _SHARD_SCHEMA)
    )


def _walked(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    n_convs, band, conv = 0, None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != band or row[1] != conv:
                if rows and (row[0] != band or n_convs == shard):
                    yield _shard(rows)
                    rows, n_convs = [], 0
                band, conv = row[0], row[1]
                n_convs += 1
            rows.append(row)
    if rows:
        yield _shard(rows)


def _shard(rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of one shard, depth first; ``rows`` are sorted by conversation and position."""
    convs: list[int] = []
    turn_at: list[dict[int, tuple[int, int]]] = []  # by conversation: its turn at a position
    postings: defaultdict[tuple, int] = defaultdict(int)
    ending: defaultdict[int, int] = defaultdict(int)
    entries: defaultdict[tuple, int] = defaultdict(int)
    code_points: dict[tuple, int] = {}
    top = rows[0][2]
    for _, conv, position, k1, k2, e1, e2, points, last in rows:
        if not convs or convs[-1] != conv:
            convs.append(conv)
            turn_at.append({})
            entries[e1, e2] |= 1 << (len(convs) - 1)
            top = min(top, position)
        i = len(convs) - 1
        turn_at[i][position] = (k1, k2)
        postings[position, k1, k2] |= 1 << i
        code_points[position, k1, k2] = points
        if last:
            ending[position] |= 1 << i
    found: list[tuple] = []
    stack = [(members, e1, e2, top) for (e1, e2), members in entries.items()]
    while stack:
        rest, p1, p2, position = stack.pop()
        while rest:
            lowest = (rest & -rest).bit_length() - 1
            k1, k2 = turn_at[lowest][position]
            child = rest & postings[position, k1, k2]
            rest ^= child
            over = child & ending[position]
            key = (p1 ^ k1, p2 ^ k2)
            found.append((*key, p1, p2, position, convs[lowest], child.bit_count(), code_points[position, k1, k2], [convs[i] for i in _bits(over)]))
            # Those that go on, if this band does; the next band's first turns enter by their key.
            on = child ^ over
            if on and position + 1 in turn_at[(on & -on).bit_length() - 1]:
                stack.append((on, *key, position + 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _SHARD_ARROW.types, strict=True)], schema=_SHARD_ARROW
    )


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's joined end lists; rows come by key and in order of their ids."""
    key, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for k1, k2, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            joined = ",".join(map(str, ends)).encode()
            if key == (k1, k2):
                digest.update(b"," + joined)
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(joined)
        if done:
            yield _ends_batch(done)
            done = []
    if key is not None:
        yield _ends_batch([(*key, digest.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha)], names=["k1", "k2", "ends_sha256"])


def trie(turns: DataFrame, lengths: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    parts, parts_path = staged(shard_nodes(turns, lengths, shard, band), "trie-shards")
    keys = ["k1", "k2"]
    ends = (
        parts.where(F.size("ends") > 0)
        .select(*keys, "ends", F.col("ends")[0].alias("_first"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "_first")
        .select(*keys, "ends")
        .mapInArrow(_hashed_ends, "k1 long, k2 long, ends_sha256 string")
    )
    sums = parts.groupBy(*keys, "depth").agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.max("code_points").alias("code_points"),
    )
    children = (
        sums.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    )
    empty = hashlib.sha256(b"").hexdigest()
    keyed = (
        sums.join(children, keys, "left")
        .join(ends, keys, "left")
        .select(
            *keys,
            F.when(F.col("depth") > 0, F.col("p1")).alias("p1"),
            F.when(F.col("depth") > 0, F.col("p2")).alias("p2"),
            "conv_id",
            "depth",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("code_points")).otherwise(0).alias("saved"),
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )
    keyed, keyed_path = staged(keyed, "trie-keyed")
    names = keyed.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes, nodes_path = staged(keyed.join(names, ["p1", "p2"], "left").drop("k1", "k2", "p1", "p2"), "trie-nodes")
    discard(spark, parts_path, keyed_path)
    received, paths = _attached_sums(nodes)
    own = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("saved").alias("saved")
    )
    at = own.unionAll(received).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    subtree = at.select(
        "conv_id", "depth", F.sum("leaves").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens")
    )
    result, _ = staged(
        nodes.join(subtree, ["conv_id", "depth"]).select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
        ),
        "trie",
    )
    discard(spark, nodes_path, *paths)
    return result


def _attached_sums(nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """What chains hand to the nodes they are attached to: (conv_id, depth, leaves, saved)."""
    tops = nodes.where("parent_conv_id <> conv_id").select(
        "conv_id", F.col("parent_conv_id").alias("onto"), (F.col("depth") - 1).alias("at")
    )
    flow = nodes.groupBy("conv_id").agg(
        F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved")
    )
    received, paths = nodes.select("conv_id", "depth", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).limit(0), []
    while True:
        moved = (
            flow.join(tops, "conv_id")
            .groupBy(F.col("onto").alias("conv_id"), F.col("at").alias("depth"))
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        )
        moved, path = staged(moved, "trie-moved")
        paths.append(path)
        if moved.isEmpty():
            return received, paths
        received = received.unionAll(moved)
        flow = moved.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns, path = staged(ordered_turns(conversations), "trie-turns")
    result = trie(*with_shared_openings(turns))
    discard(conversations.sparkSession, path)
    return result


def oracle_sql() -> str:
    """The registered query in DuckDB's SQL."""
    digits = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x))"
    return f"""
WITH ct AS MATERIALIZED ({crc32_table()}),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS turns FROM o GROUP BY conv_id),
h AS (SELECT conv_id, turns, {crc32_of_bytes(digits)} % {OPENINGS} AS h FROM own, ct),
b AS (SELECT h.conv_id, list_concat(coalesce(f.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own f ON f.conv_id = h.conv_id - h.conv_id % {FAMILY}),
m AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS over FROM b, unnest(range(len(turns) + 1)) AS u(d)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE over), '')) AS ends_sha256
  FROM m GROUP BY path, d),
c AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.path[d].t) ELSE 0 END AS saved
  FROM n LEFT JOIN c ON c.path = n.path),
s AS (SELECT x.path[1:a] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM x, unnest(range(x.d + 1)) AS u(a) GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves,
 CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.path = x.path LEFT JOIN n p ON x.d > 0 AND p.path = x.path[1:x.d - 1]
"""
