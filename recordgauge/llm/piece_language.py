"""Language identification with unigram piece models, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all ways to write it as pieces, found by the forward algorithm in
one pass over the word; a text's is the product over its words, since no piece spans a word's
beginning. The probabilities are fitted by expectation maximisation: every round sends the
present ones to the tasks, where a forward and a backward pass give each piece's expected count
in each distinct word, and sums these per language and piece in Spark.

Words are lower-case letter runs with the vocabulary's mark in front. A letter that is in no
piece counts as a piece of small fixed probability in every language.

Bounds, documented parameters: about ``max_documents`` training documents per language (chosen
by a hash of doc_id, whole texts). What reaches the driver is one number per piece of the
vocabulary and language. Scoring covers every whole text; a worker keeps the scores of at most
``MAX_WORDS`` distinct words.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every
text if no language could be learned; rows with a null doc_id are scored, and are in no fold
but that of the empty text; repeated rows get equal results; of equally probable languages the
first in alphabetical order is taken.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import bucket, per_text, with_columns
from recordgauge.plans.scratch import discard, staged

FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
VOCABULARY = "piece_bpe_32k.model"
MAX_WORDS = 400_000
UNKNOWN = 1e-8
_MARK = "▁"  # how the vocabulary writes a word's beginning
_WORD = re.compile(r"[^\W\d_]+")
_SMALL, _LARGE = 1e-200, 1e200
SHORT = 48  # letters of a word that is tried without scaling


@dataclass(frozen=True)
class Settings:
    max_documents: int = 1_500
    rounds: int = 4
    #: The part of each model that is the mean of all languages.
    background: float = 0.02


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces that words can be written in: lower-case letters, mark in front."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.vocab_size()) if not model.is_control(i))
    lower = (p for p in every if p == p.lower())
    return tuple(sorted({p for p in lower if (p.removeprefix(_MARK) or "a").isalpha()}))


def forward(word: str, table: dict[str, list[float]], longest: int, n: int) -> tuple[list[list[float]], list[int]]:
    """Per position, the summed probability of all segmentations up to it, for ``n`` models.

    Very long words would underflow; then the positions that are still needed are scaled up,
    and the second result says how often up to each position.
    """
    sums, scales = [[1.0] * n], [0]
    scale = 0
    for end in range(1, len(word) + 1):
        total = [0.0] * n
        for start in range(max(0, end - longest), end):
            p = table.get(word[start:end])
            if p is not None:
                total = [t + s * q for t, s, q in zip(total, sums[start], p, strict=True)]
        if word[end - 1] not in table:
            total = [t + s * UNKNOWN for t, s in zip(total, sums[end - 1], strict=True)]
        if max(total) < _SMALL:
            scale += 1
            total = [t * _LARGE for t in total]
            for start in range(max(0, end - longest + 1), end):
                sums[start] = [s * _LARGE for s in sums[start]]
        sums.append(total)
        scales.append(scale)
    return sums, scales


def stepped(table: dict[str, list[float]]) -> dict[str, list[float]]:
    """The table with an empty row for every beginning of a piece that is none itself, so that a
    search from a position can end where no piece goes on."""
    return {p[:k]: [] for p in table for k in range(1, len(p))} | table


def log_probability(word: str, steps: dict[str, list[float]], longest: int, n: int) -> list[float]:
    """Per model the logarithm of the word's probability; ``steps`` is a ``stepped`` table."""
    size, get = len(word), steps.get
    if size <= SHORT:
        links = []
        for start in range(size):
            for end in range(start + 1, min(size, start + longest) + 1):
                p = get(word[start:end])
                if p:
                    links.append((start, end, p))
                elif p is None:
                    break
            if not get(word[start]):
                links.append((start, start + 1, [UNKNOWN] * n))
        whole = []
        for k in range(n):
            ahead = [1.0] + [0.0] * size
            for start, end, p in links:
                ahead[end] += ahead[start] * p[k]
            whole.append(ahead[size])
        if min(whole) > _SMALL:
            return [math.log(x) for x in whole]
    sums, scales = forward(word, {p: row for p, row in _inside(word, steps, longest)}, longest, n)
    shift = scales[-1] * math.log(_LARGE)
    # In a scaled word a language may fall to zero next to the others; it keeps a floor.
    return [math.log(max(s, 5e-324)) - shift for s in sums[-1]]


def _inside(word: str, steps: dict[str, list[float]], longest: int) -> Iterator[tuple[str, list[float]]]:
    """The pieces that occur in a word."""
    for start in range(len(word)):
        for end in range(start + 1, min(len(word), start + longest) + 1):
            p = steps.get(word[start:end])
            if p:
                yield word[start:end], p
            elif p is None:
                break


def expected_counts(word: str, table: dict[str, float], longest: int) -> dict[str, float]:
    """Each piece's expected number in a word over all segmentations, by forward and backward sums."""
    size = len(word)
    if size > SHORT:
        return _expected_in_logs(word, table, longest)
    ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    found = []
    for end in range(1, size + 1):
        for start in range(max(0, end - longest), end):
            p = table.get(word[start:end])
            if p is not None:
                found.append((start, end, p))
                ahead[end] += ahead[start] * p
        if word[end - 1] not in table:
            found.append((end - 1, end, UNKNOWN))
            ahead[end] += ahead[end - 1] * UNKNOWN
    for start, end, p in reversed(found):
        behind[start] += p * behind[end]
    counts: dict[str, float] = defaultdict(float)
    if ahead[size] > 0:
        for start, end, p in found:
            counts[word[start:end]] += ahead[start] * p * behind[end] / ahead[size]
    return counts


def _links(word: str, end: int, table: dict[str, float], longest: int) -> Iterator[tuple[int, float]]:
    """Where pieces that end at ``end`` start, with their probabilities."""
    for start in range(max(0, end - longest), end):
        p = table.get(word[start:end])
        if p is not None:
            yield start, p
    if word[end - 1] not in table:
        yield end - 1, UNKNOWN


def _expected_in_logs(word: str, table: dict[str, float], longest: int) -> dict[str, float]:
    """``expected_counts`` of a word of any length: its sums are too small for numbers as such."""
    size = len(word)
    ahead, behind = [0.0] * (size + 1), [-math.inf] * size + [0.0]
    for end in range(1, size + 1):
        terms = [ahead[start] + math.log(p) for start, p in _links(word, end, table, longest)]
        most = max(terms)
        ahead[end] = most + math.log(sum(math.exp(t - most) for t in terms))
    counts: dict[str, float] = defaultdict(float)
    for end in range(size, 0, -1):
        for start, p in _links(word, end, table, longest):
            term = math.log(p) + behind[end]
            counts[word[start:end]] += math.exp(ahead[start] + term - ahead[size])
            high, low = max(behind[start], term), min(behind[start], term)
            behind[start] = high + math.log1p(math.exp(low - high))
    return counts


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    #: Per piece, the probability in each language.
    table: dict[str, list[float]]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.table), default=1)
        self.steps = stepped(self.table)
        self.places: dict[str, int] = {}
        self.scores = np.zeros((MAX_WORDS, len(self.languages)))

    def __reduce__(self):
        return Model, (self.languages, self.log_prior, self.table)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        total = self.log_prior.copy()
        # A long text is taken in parts, each of which fits into the kept words.
        for at in range(0, len(words), MAX_WORDS // 4):
            part = words[at : at + MAX_WORDS // 4]
            if len(self.places) + len(part) > MAX_WORDS:
                self.places.clear()
            total += self.scores[[self._place(w) for w in part]].sum(axis=0)
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def _place(self, word: str) -> int:
        place = self.places.get(word)
        if place is None:
            place = self.places[word] = len(self.places)
            self.scores[place] = log_probability(_MARK + word, self.steps, self.longest, len(self.languages))
        return place


def _expectation(tables: dict[str, dict[str, float]], longest: int):
    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for lang, word, n in zip(frame["lang"], frame["word"], frame["n"], strict=True):
                for piece, expected in expected_counts(_MARK + word, tables[lang], longest).items():
                    sums[lang, piece] += n * expected
            keys = list(sums)
            yield pd.DataFrame(
                {"lang": [k[0] for k in keys], "piece": [k[1] for k in keys], "expected": list(sums.values())}
            )

    return step


def train(docs: DataFrame, vocabulary: str | None = None, s: Settings = Settings()) -> Model:
    """Fit on rows outside the held-out fold that have a language."""
    pieces = pieces_of(vocabulary or public_tokenizers.path(VOCABULARY))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (bucket("doc_id", FOLDS) != HELD_OUT))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(0), {})
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(3), F.col("doc_id")), 11) / float(1 << 53)
    chance = F.lit(0.0)
    for lang, n in sizes.items():
        chance = F.when(F.col("lang") == lang, min(1.0, s.max_documents / n)).otherwise(chance)
    words = known.where(unit < chance).select("lang", F.explode(per_text(words_of, "array<string>")("text")).alias("word"))
    counted, path = staged(
        words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "language-words",
    )
    longest = max(map(len, pieces))
    tables = {lang: dict.fromkeys(pieces, 1.0 / len(pieces)) for lang in sizes}
    for _ in range(s.rounds):
        shares = counted.mapInPandas(_expectation(tables, longest), "lang string, piece string, expected double")
        sums = shares.groupBy("lang", "piece").agg(F.sum("expected").alias("expected")).collect()
        tables = _maximised(sums, list(sizes), pieces)
    discard(docs.sparkSession, path)
    languages = sorted(sizes)
    present = sorted({p for t in tables.values() for p in t})
    mean = {p: sum(tables[x].get(p, 0.0) for x in languages) / len(languages) for p in present}
    mixed = {p: [(1 - s.background) * tables[x].get(p, 0.0) + s.background * mean[p] for x in languages] for p in present}
    prior = np.array([sizes[x] for x in languages], dtype=float)
    return Model(languages, np.log(prior / prior.sum()), mixed)


def _maximised(sums: list, languages: list[str], pieces: tuple[str, ...]) -> dict[str, dict[str, float]]:
    """Probabilities in proportion to the expected counts; what has come to nothing is dropped."""
    vocabulary = set(pieces)
    tables: dict[str, dict[str, float]] = {x: {} for x in languages}
    for row in sums:
        if row.piece in vocabulary and row.expected > 1e-9:
            tables[row.lang][row.piece] = row.expected
    totals = {x: sum(t.values()) for x, t in tables.items()}
    return {x: {p: e / totals[x] for p, e in t.items()} for x, t in tables.items()}


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. The model is bounded by the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    predict = per_text(lambda t: shared.value.predict(t), "struct<lang:string,score:double>")
    found = with_columns(docs, _found=predict(F.col(text)))
    return with_columns(found, lang_pred=F.col("_found.lang"), score=F.col("_found.score")).drop("_found")


def judge(docs: DataFrame, vocabulary: str | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    held_out = bucket("doc_id", FOLDS) == HELD_OUT
    found = identify(docs.select("doc_id", "text"), train(docs, vocabulary, s))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
