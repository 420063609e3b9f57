"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

A word becomes the vector of how often it has each letter of the alphabet. An inserted letter
raises one count by one, a deleted one lowers one, a replaced one raises one and lowers
another: one edit is an L1 distance of at most two, and which of the two follows from the two
lengths. So for each pair of lengths (equal, one more, one less) words near a given one lie in
a small box around its vector. Boxes that hold no such vector are pruned; the words that are left
are compared letter by letter.

**Two levels of one tree.** The upper level divides each length's words into parts. Its splits
are fitted to a hash sample of about ``SAMPLE`` words, so it has a bounded number of parts
(``SAMPLE`` / ``PART_SAMPLE``), and any word, in the sample or not, belongs to exactly one part. A
word looks in all parts whose box its edits can reach. A part of more than ``BLOCK`` words, or
``BLOCK_LETTERS`` letters, is dealt by hash to several blocks (anagrams have equal vectors, and
no split parts them), and the words that look in it look in all its blocks. In a task a
block's words make the lower level, a tree with tight boxes in numpy; the words that look in it
stream past in batches, dealt by hash to one task for every ``SHARE`` words of the block, each of
which has the block. Nothing is left out: the sample decides only where the work is done.

A block sends a word's number of near words and the best of them, not pairs. Forms are followed
to their roots by pointer jumping; as a form occurs at least twice as often as its word, chains
are as long as the logarithm of the largest count at most.

Defined results: a null text has no runs; a null doc_id hashes as the empty string; repeated
rows count again; empty and very long texts and words are treated like others; an empty table
gives an empty result; other columns are not read.

Skew: occurrences are counted before they are shuffled; hot parts are dealt to blocks; a hot root
in the joins of pointer jumping is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.plans.scratch import discard, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCENTED_FROM, ACCENTED_TO = 0xC0, 0xFF
N_LETTERS = 26 + ACCENTED_TO - ACCENTED_FROM + 1
SHORTEST = 5
FEWEST = 3
SLIP = 97

SAMPLE = 100_000
PART_SAMPLE = 50
PART = 32_768
BLOCK = 65_536
BLOCK_LETTERS = 1 << 22
SHARE = 8_192
LEAF = 32

# By how much longer the words looked for are: most raised and most lowered letter counts.
REACH = {0: (1, 1), 1: (1, 0), -1: (0, 1)}


# --- Words ---------------------------------------------------------------------------------


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``SHORTEST`` letters that occur ``FEWEST`` times or more.

    One run in ``SLIP``, chosen by a hash of document and run, has a letter taken out.
    """
    letters = f"[a-z\\u{ACCENTED_FROM:04X}-\\u{ACCENTED_TO:04X}]{{{SHORTEST},}}"
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(letters), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    return (
        hashed.select(word.alias("word"))
        .where(F.length("word") >= SHORTEST)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= FEWEST)
    )


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words in a row, as numbers from 0, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-16-le"), dtype="<u2").astype(np.int32)
    codes = np.where(points < ACCENTED_FROM, points - ord("a"), points - ACCENTED_FROM + 26)
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    codes, sizes = letter_codes(words)
    rows = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(rows * N_LETTERS + codes, minlength=len(words) * N_LETTERS)
    return counts.reshape(-1, N_LETTERS).astype(np.int16 if sizes.max(initial=0) < 30_000 else np.int32)


# --- The upper level -----------------------------------------------------------------------


def fit_parts(words: list[str], parts: int) -> list[tuple]:
    """Splits that divide words of one length into about ``parts``, as a list of nodes.

    A node is (letter, most, left, right), where left has words with at most ``most`` of the
    letter, or (part,). The first node is the root.
    """
    nodes: list[tuple] = []
    n_parts = 0

    def grow(counts: np.ndarray, wanted: int) -> int:
        nonlocal n_parts
        here = len(nodes)
        nodes.append(())
        best = None
        if wanted > 1 and len(counts) >= 2 * PART_SAMPLE:
            # The most even split: by letter, the share of words with at most so many of it.
            shares = np.array([(counts <= k).mean(axis=0) for k in range(counts.max())])
            most, letter = (int(x) for x in np.unravel_index(np.argmin(np.abs(shares - 0.5)), shares.shape))
            left = counts[:, letter] <= most
            if PART_SAMPLE <= left.sum() <= len(counts) - PART_SAMPLE:
                best = (letter, most, left)
        if best is None:
            nodes[here] = (n_parts,)
            n_parts += 1
        else:
            letter, most, left = best
            share = max(1, min(wanted - 1, round(wanted * left.mean())))
            nodes[here] = (letter, most, grow(counts[left], share), grow(counts[~left], wanted - share))
        return here

    grow(letter_counts(words), parts)
    return nodes


def part_of(nodes: list[tuple], counts: list[int]) -> int:
    """The part a word with these letter counts belongs to."""
    node = nodes[0]
    while len(node) == 4:
        node = nodes[node[2] if counts[node[0]] <= node[1] else node[3]]
    return node[0]


def parts_in_reach(nodes: list[tuple], counts: list[int], raised: int, lowered: int) -> list[int]:
    """Parts that can hold a word with so many counts raised and lowered by one."""
    found = []
    # Node, what is left of both, and the box so far: (least, most) by letter.
    stack: list[tuple[int, int, int, dict[int, tuple[float, float]]]] = [(0, raised, lowered, {})]
    while stack:
        here, up, down, box = stack.pop()
        node = nodes[here]
        if len(node) == 1:
            found.append(node[0])
            continue
        letter, most, left, right = node
        value = counts[letter]
        low, high = box.get(letter, (-np.inf, np.inf))
        less, more = min(high, most), max(low, most + 1)
        # What this letter has cost already counts once.
        lowers = max(0, value - less) - max(0, value - high)
        raises = max(0, more - value) - max(0, low - value)
        if lowers <= down:
            stack.append((left, up, down - lowers, box | {letter: (low, less)}))
        if raises <= up:
            stack.append((right, up - raises, down, box | {letter: (more, high)}))
    return found


# --- The lower level -----------------------------------------------------------------------


class Tree:
    """Words of one length in a k-d tree of their letter counts.

    A count is held as so many set bits, one after the other, so the L1 distance of two vectors
    is the number of bits that differ. A split is a bit: at least so many of a letter, or fewer;
    the most even one is taken. The box of a node is the bits that all its words have, and those
    that any has.
    """

    def __init__(self, words: list[str]) -> None:
        counts = letter_counts(words)
        self.length = len(words[0])
        self.most = counts.max(axis=0)
        bits = self._bits(counts)
        packed = _packed(bits)
        order = np.arange(len(words))
        # (all, any, first, after, [left, right]); a leaf has none.
        self.nodes: list[tuple] = []
        stack: list[tuple[int, int, list[int]]] = [(0, len(words), [])]
        while stack:
            first, after, above = stack.pop()
            mine = order[first:after]
            below: list[int] = []
            above.append(len(self.nodes))
            self.nodes.append(
                (np.bitwise_and.reduce(packed[:, mine], axis=1), np.bitwise_or.reduce(packed[:, mine], axis=1), first, after, below)
            )
            if after - first <= LEAF:
                continue
            shares = bits[mine].mean(axis=0)
            split = int(np.argmin(np.abs(shares - 0.5)))
            if 0 < shares[split] < 1:
                has = bits[mine, split]
                order[first:after] = np.concatenate([mine[~has], mine[has]])
                middle = after - int(has.sum())
                stack += [(first, middle, below), (middle, after, below)]
        self.order = order
        self.packed = packed[:, order]
        self.codes = _padded([words[i] for i in order])

    def _bits(self, counts: np.ndarray) -> np.ndarray:
        levels = [counts[:, [x]] > np.arange(self.most[x]) for x in np.flatnonzero(self.most)]
        return np.concatenate(levels, axis=1)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index in ``words``, index of a word of the tree) one edit apart; all ``words``
        are of one length."""
        raised, lowered = REACH[self.length - len(words[0])]
        counts = letter_counts(words)
        # Letters that no word of the tree has so often have to go.
        over = np.maximum(counts - self.most, 0).sum(axis=1)
        alive = np.flatnonzero(over <= lowered)
        queries = _packed(self._bits(counts))
        one, two = [], []
        stack = [(0, alive)]
        while stack:
            here, who = stack.pop()
            low, high, first, after, below = self.nodes[here]
            who = who[_count(low[:, None] & ~queries[:, who]) <= raised]
            who = who[_count(queries[:, who] & ~high[:, None]) + over[who] <= lowered]
            if len(who) and below:
                stack += [(k, who) for k in below]
                continue
            step = max(1, BLOCK_LETTERS // (len(low) * (after - first)))
            for k in range(0, len(who), step):
                some = who[k : k + step]
                of_tree, asked = self.packed[:, None, first:after], queries[:, some, None]
                # First by all differences, as few have so few.
                q, p = np.nonzero(_count(of_tree ^ asked) + over[some][:, None] == raised + lowered)
                q, p = some[q], p + first
                held = _count(self.packed[:, p] & ~queries[:, q]) == raised
                one.append(q[held])
                two.append(p[held])
        if not one:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, p = np.concatenate(one), np.concatenate(two)
        codes = _padded(words)
        step = max(1, BLOCK_LETTERS // self.length)
        right = [_one_edit(codes[q[k : k + step]], self.codes[p[k : k + step]]) for k in range(0, len(q), step)]
        held = np.concatenate(right) if right else np.empty(0, bool)
        return q[held], self.order[p[held]]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as columns of 64-bit numbers."""
    octets = np.packbits(bits, axis=1)
    room = -octets.shape[1] % 8
    return np.ascontiguousarray(np.pad(octets, ((0, 0), (0, room))).view("<u8").T)


def _count(columns: np.ndarray) -> np.ndarray:
    """Set bits of each column of 64-bit numbers."""
    total = np.bitwise_count(columns[0]).astype(np.int32)
    for more in columns[1:]:
        total += np.bitwise_count(more)
    return total


def _padded(words: list[str]) -> np.ndarray:
    return letter_codes(words)[0].astype(np.uint8).reshape(len(words), -1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two letter tables are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    size = b.shape[1]
    begins = np.cumprod(a[:, :size] == b, axis=1, dtype=np.int32).sum(axis=1)
    ends = np.cumprod((a[:, 1:] == b)[:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
    return begins + ends >= size


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words in each block; a block's own words come first, then those that look in it."""
    block, tree = None, None
    held: tuple[list[str], list[int]] = ([], [])
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        words, n = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        new = (np.diff(keys, axis=1) != 0).any(axis=0)
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(words)]
        out: list[tuple] = []
        for first, after in zip(bounds, bounds[1:], strict=False):
            if first == after:
                continue
            *this, looks = keys[:, first].tolist()
            if this != block:
                block, tree, held = this, None, ([], [])
            if not looks:
                held[0].extend(words[first:after])
                held[1].extend(n[first:after])
                continue
            if tree is None:
                if not held[0]:
                    continue
                tree = Tree(held[0])
            by_length: dict[int, list[str]] = {}
            for w in words[first:after]:
                by_length.setdefault(len(w), []).append(w)
            for some in by_length.values():
                out += _best(tree, *held, some)
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["word", "n_near", "best_n", "best"],
            )


def _best(tree: Tree, own: list[str], n: list[int], words: list[str]) -> list[tuple[str, int, int, str]]:
    found: dict[int, list] = {}
    for q, p in zip(*(x.tolist() for x in tree.near(words)), strict=True):
        key = (-n[p], own[p])
        if q not in found:
            found[q] = [1, key]
        else:
            found[q][0] += 1
            found[q][1] = min(found[q][1], key)
    return [(words[q], count, -key[0], key[1]) for q, (count, key) in found.items()]


# --- The operator --------------------------------------------------------------------------


def near_words(words: DataFrame, sample: int = SAMPLE, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) for each of ``words`` (word, n) that has a near word."""
    sized = words.select("word", "n", F.length("word").alias("length"))
    total = words.count()
    # About ``sample`` words whatever the total; by a hash, so that partitions do not matter.
    drawn = F.pmod(F.xxhash64("word"), F.lit(-(-total // sample) or 1)) == 0
    taken = sized.where(drawn).select("word", "length").toPandas()
    trees: dict[int, list[tuple]] = {}
    for length, some in taken.groupby("length"):
        wanted = round(len(some) / max(1, len(taken)) * total / part)
        if wanted > 1:
            trees[int(length)] = fit_parts(some["word"].tolist(), wanted)

    def part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            parts = [
                part_of(trees[len(w)], c) if len(w) in trees else 0
                for w, c in zip(texts, _rows_of_counts(texts), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(parts, pa.int32())],
                names=["word", "n", "length", "part"],
            )

    def look_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            looking, lengths, parts = [], [], []
            for w, c in zip(texts, _rows_of_counts(texts), strict=True):
                for longer, reach in REACH.items():
                    at = len(w) + longer
                    reached = parts_in_reach(trees[at], c, *reach) if at in trees else [0]
                    looking += [w] * len(reached)
                    lengths += [at] * len(reached)
                    parts += reached
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int32()), pa.array(parts, pa.int32()), pa.array(looking, pa.string())],
                names=["length", "part", "word"],
            )

    placed, path = staged(sized.mapInArrow(part_rows, "word string, n long, length int, part int"), "spelling-parts")
    at = ["length", "part"]
    letters = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    blocks = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).select(
        *at, "size", F.ceil(F.col("size") / letters).cast("int").alias("blocks")
    )
    blocks = blocks.select(*at, "blocks", F.ceil(F.col("size") / F.col("blocks") / SHARE).cast("int").alias("shares"))
    shares = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    own = placed.join(blocks, at).select(
        *at, F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("salt"), shares.alias("share"), F.lit(0).alias("looks"), "word", "n"
    )
    looking = (
        placed.select("word").mapInArrow(look_rows, "length int, part int, word string")
        .join(blocks, at)
        .select(*at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("looks"), "word", F.lit(0).cast("long").alias("n"))
    )
    block_at = ("length", "part", "salt", "share")
    found = (
        own.unionAll(looking)
        .repartition(*block_at)
        .sortWithinPartitions(*block_at, "looks")
        .mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    )
    best = F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    near, _ = staged(near.select("word", "n_near", (-F.col("b.minus_n")).alias("best_n"), F.col("b.word").alias("best")), "spelling-near")
    discard(words.sparkSession, path)
    return near


def _rows_of_counts(words: list[str]) -> Iterator[list[int]]:
    # Word by word: a batch may hold very long ones.
    for k in range(0, len(words), 1000):
        yield from letter_counts(words[k : k + 1000]).tolist()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for each of ``forms`` (word, form): the last word forms lead to."""
    spark = forms.sparkSession
    jumps, path = staged(forms.select("word", F.col("form").alias("to")), "spelling-jumps")
    while True:
        ahead = jumps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        longer, longer_path = staged(
            jumps.join(ahead, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")),
            "spelling-jumps",
        )
        discard(spark, path)
        path = longer_path
        jumps = longer.select("word", "to")
        if longer.where("moved").isEmpty():
            return jumps.select("word", F.col("to").alias("root"))


def variants(words: DataFrame, sample: int = SAMPLE, part: int = PART, block: int = BLOCK) -> DataFrame:
    """Per row of ``words`` (word, n, each word once): word, form, root, n, n_near, form_n."""
    words, words_path = staged(words.select("word", "n"), "spelling-words")
    judged = words.join(near_words(words, sample, part, block), "word", "left")
    is_form = F.col("best_n") >= 2 * F.col("n")
    judged, judged_path = staged(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = follow(judged.where("form IS NOT NULL").select("word", "form"))
    result, _ = staged(
        judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"),
        "spelling",
    )
    discard(words.sparkSession, words_path, judged_path)
    return result


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of a table's words."""
    return variants(word_counts(docs, doc_id, text))
