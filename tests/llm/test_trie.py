import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from recordgauge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(first, [])[:h] + turns[c][h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = set()
    for path, some in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        childless = [p for p in inside if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = ",".join(str(c) for c in sorted(some) if len(convs[c]) == len(path))
        rows.add((
            min(some), len(path), min(members[path[:-1]]) if path else None, len(some),
            sum(len(p) == len(path) + 1 for p in inside), len(childless),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in inside if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def built(spark, rows, **sizes):
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)).cache()
    found = prefix_trie.trie(*prefix_trie.with_shared_openings(turns), **sizes)
    assert found.columns == COLUMNS
    return [tuple(r) for r in found.collect()]


def table(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([rng.randint(0, 12), 100 + rng.randint(0, 60), 250, 300, -150, -100, 7_000_000_000])
        rows.append((conv, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", None, "longer text"])))
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"shard": 2, "band": 2}), (3, {"shard": 3, "band": 1})])
def test_against_brute_force(spark, seed, sizes):
    rows = table(seed, 250)
    found = built(spark, rows, **sizes)
    assert len(set(found)) == len(found) and set(found) == plain(rebuilt(rows))


def test_copies_long_conversations_and_turnless_ones(spark):
    # 300 equal conversations, one of 200 turns, one that only has turns its opening replaces.
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1300) for t in range(2)]
    rows += [(5, t, "user", f"t{t}") for t in range(200)]
    turnless = next(c for c in range(401, 500) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows += [(turnless, 0, "user", "gone"), (None, 0, "user", "no conversation")]
    convs = rebuilt(rows)
    assert convs[turnless] == []
    assert set(built(spark, rows, shard=64, band=16)) == plain(convs)


def test_empty_table_and_other_columns(spark):
    assert built(spark, []) == []
    df = spark.createDataFrame([(100, 0, "user", "x", 9, "k")], SCHEMA + ", depth long, k1 string")
    assert prefix_trie.conversation_trie(df).count() == 2
