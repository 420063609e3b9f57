"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other training text counts as unlabelled, not
as clean. With P the positives, U the unlabelled documents and p the share of toxic ones in U,
the risk of a classifier z is

    p * mean_P loss(z) + max(0, mean_U loss(-z) - p * mean_P loss(-z))

The second term estimates the risk on clean text; it cannot be below zero in truth, and where
the estimate falls below, the step goes against that term instead, which stops overfitting
(Kiryo, Niu, du Plessis and Sugiyama 2017). A few linear numpy classifiers over the
presence of words and word beginnings are trained, each on all positives and a share of the unlabelled sample; their mean decides.

Bounds, all documented parameters: ``max_positive`` and ``max_unlabelled`` documents are
expected in the sample (chosen by a hash of doc_id, whole texts); ``min_documents`` is the
least number of sampled documents a word has to be in, and ``min_deviations`` by how many
standard errors its shares in the two samples have to differ. The model's size follows from these.
Scoring covers every whole text.

Defined results: a null or empty text scores as a text without words; a document with null
doc_id is scored but never in the sample (its crc32 is that of the empty text); repeated rows
get equal scores; without a labelled positive every score is the class prior; documents and
labels may be empty. Columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import bucket, per_text, with_columns
from recordgauge.plans.scratch import discard, staged

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    max_positive: int = 4_000
    max_unlabelled: int = 12_000
    min_documents: int = 4
    min_deviations: float = 6.0
    classifiers: int = 3
    steps: int = 150
    rate: float = 0.05
    decay: float = 1e-6
    #: Below this part of the clean risk the step reverses (0: the estimate's own bound).
    slack: float = 0.0
    seed: int = 7


@dataclass
class Model:
    """Weights by the crc32 of a word, and a bias, already averaged over the classifiers."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(h, 0.0) for h in word_hashes(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def word_hashes(text: str | None) -> list[int]:
    """crc32 of each distinct lower-case word and of the beginnings that inflected forms share."""
    words = set(_WORD.findall((text or "").lower()))
    for size in BEGINNINGS:
        words |= {w[:size] + "-" for w in words if len(w) > size and w[-1] != "-"}
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def train_one(
    rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float, s: Settings
) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier with the sigmoid loss, by Adam.

    ``rows`` and ``columns`` list the words present, ``positive`` flags the rows.
    """
    n, n_positive = len(positive), max(1, int(positive.sum()))
    n_unlabelled = max(1, n - int(positive.sum()))
    params = np.zeros(width + 1)
    params[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, s.steps + 1):
        z = params[-1] + np.bincount(rows, weights=params[columns], minlength=n)
        toxic = _sigmoid(z)
        slope = toxic * (1 - toxic)
        # loss(z) = sigmoid(-z); its mean over clean text is estimated from U and P.
        clean_risk = toxic[~positive].sum() / n_unlabelled - prior * toxic[positive].sum() / n_positive
        towards_clean = np.where(positive, -prior * slope / n_positive, slope / n_unlabelled)
        if clean_risk < -s.slack:
            g = -towards_clean
        else:
            g = towards_clean + np.where(positive, -prior * slope / n_positive, 0.0)
        gradient = np.append(np.bincount(columns, weights=g[rows], minlength=width), g.sum())
        gradient[:-1] += s.decay * params[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        corrected = np.sqrt(square / (1 - 0.999**step)) + 1e-8
        params -= s.rate * (mean / (1 - 0.9**step)) / corrected
    return params[:-1], float(params[-1])


def telling(sample: DataFrame, s: Settings) -> DataFrame:
    """Words in significantly more, or fewer, of the sample's positives than of its unlabelled rows.

    ``sample`` has ``positive``, ``unlabelled`` and ``words``; the counts are taken where the
    rows are.
    """
    size = sample.agg(
        F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")
    ).first()
    if not size.p or not size.u:
        return sample.select(F.explode("words").alias("word")).limit(0)
    counts = (
        sample.select("positive", "unlabelled", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u"))
    )
    p, u = F.col("p"), F.col("u")
    pooled = (p + u + 1) / (size.p + size.u + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / size.p + 1 / size.u))
    deviation = F.abs(p / size.p - u / size.u) / error
    return counts.where((deviation >= s.min_deviations) & (p + u >= s.min_documents)).select("word")


def fit(
    words: list[list[int]], positive: np.ndarray, hashes: list[int], prior: float, s: Settings = Settings()
) -> Model:
    """The averaged classifiers over a sample.

    ``words`` has each row's words as places in ``hashes``, ``positive`` flags the rows.
    """
    prior = float(np.clip(prior, 1e-3, 0.9))
    if not hashes or not positive.any() or positive.all():
        return Model(float(np.log(prior / (1 - prior))))
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    columns = np.fromiter((c for w in words for c in w), np.int64, len(rows))
    share = np.random.default_rng(s.seed).integers(0, s.classifiers, len(words))
    total, bias = np.zeros(len(hashes)), 0.0
    for k in range(s.classifiers):
        member = positive | (share == k)
        number = np.cumsum(member) - 1
        inside = member[rows]
        w, b = train_one(number[rows[inside]], columns[inside], positive[member], len(hashes), prior, s)
        total += w / s.classifiers
        bias += b / s.classifiers
    return Model(bias, dict(zip(hashes, total.tolist(), strict=True)))


def _unit(column: str, salt: int) -> Column:
    """A uniform number in [0, 1) from a hash, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col(column)), 11) / float(1 << 53)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on rows outside the held-out fold. ``docs`` has doc_id and text, ``labels`` doc_id and toxic."""
    spark = docs.sparkSession
    known = labels.where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (bucket("doc_id", FOLDS) != HELD_OUT)
    )
    counts = known.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("n_toxic")
    ).first()
    n, n_toxic = counts.n, counts.n_toxic or 0
    if not n or not n_toxic:
        return fit([], np.zeros(0, bool), [], 1e-3, s)
    confirmed = (
        known.where((F.col("toxic") == 1) & (_unit("doc_id", 1) < s.max_positive / n_toxic))
        .select("doc_id", F.lit(True).alias("confirmed"))
        .distinct()
    )
    training = docs.select("doc_id", "text").where(
        F.col("doc_id").isNotNull() & (bucket("doc_id", FOLDS) != HELD_OUT)
    )
    drawn = _unit("doc_id", 2) < s.max_unlabelled / max(1, training.count())
    # At most about max_positive identifiers are broadcast, whatever the size of the labels.
    sample = (
        training.join(F.broadcast(confirmed), "doc_id", "left")
        .where(F.col("confirmed").isNotNull() | drawn)
        .select(
            F.coalesce("confirmed", F.lit(False)).alias("positive"),
            drawn.alias("unlabelled"),
            per_text(word_hashes, "array<long>")("text").alias("words"),
        )
    )
    sample, path = staged(sample, "toxicity-sample")
    hashes = sorted(r.word for r in telling(sample, s).collect())
    place = {h: i for i, h in enumerate(hashes)}
    shared = spark.sparkContext.broadcast(place)
    told = per_text(lambda ws: [shared.value[w] for w in ws if w in shared.value], "array<int>")("words")
    rows = sample.select("positive", "unlabelled", told.alias("words")).collect()
    discard(spark, path)
    # The unlabelled sample is drawn from all text, so a confirmed document may count in both.
    listed = sorted([(True, r.words) for r in rows if r.positive] + [(False, r.words) for r in rows if r.unlabelled])
    positive = np.array([p for p, _ in listed], dtype=bool)
    return fit([w for _, w in listed], positive, hashes, n_toxic / n, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``. The model's size is bounded by its settings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = with_columns(docs, score=per_text(lambda t: shared.value.score(t), "double")(F.col("text")))
    return with_columns(scored, predicted=(F.col("score") >= THRESHOLD).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    held_out = bucket("doc_id", FOLDS) == HELD_OUT
    scored = score(docs.select("doc_id", "text"), train(docs, labels, s))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are not judged toxic, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, s))
    clean = per_text(lambda t: shared.value.score(t) < THRESHOLD, "boolean")(F.col("text"))
    return docs.where(clean)
