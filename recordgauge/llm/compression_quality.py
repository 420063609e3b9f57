"""Text quality by compression: which of two zstandard dictionaries describes a text better.

One dictionary is built from good labelled texts, one from bad ones. A text is compressed
whole with either, and the difference of the sizes, normalised by the text's length, tells which
class it is closer to. A logistic calibration turns the difference, and how far the text can be
compressed at all, into a probability of label 1. It is fitted on labelled rows that went into
no dictionary.

Bounds, documented parameters: about ``max_documents`` rows per label for the dictionaries and
as many for the calibration, chosen by a hash of doc_id, whole texts. Scoring covers every
whole text.

Defined results: a null text counts as an empty one, and an empty one is scored by the same
formula with length one; repeated rows get equal scores; a null doc_id is scored but never
learned from; if a label has no training row, every score is the other label's, 1 or 0, and 0.5
if both have none; a document labelled both good and bad is no example of either; an empty table
gives an empty result. ``score`` and ``predicted`` of the input are replaced. Where a label has too
few texts for a dictionary, its texts stand for one, of them the last ``dictionary_bytes``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import bucket, per_text, with_columns

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    max_documents: int = 1_500
    dictionary_bytes: int = 112_640
    level: int = 3
    penalty: float = 1e-3


def dictionary(texts: list[bytes], s: Settings = Settings()) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    texts = [t for t in texts if t]
    size = min(s.dictionary_bytes, max(256, sum(map(len, texts)) // 4))
    if len(texts) >= 10:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            pass  # too much alike or too short
    return b"\n".join(texts)[-s.dictionary_bytes :]


class Sizes:
    """Compressed sizes of texts with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.args = (good, bad, level)
        self.compressors = None

    def __reduce__(self):
        return Sizes, self.args

    def _ready(self):
        if self.compressors is None:
            good, bad, level = self.args
            self.compressors = [
                zstandard.ZstdCompressor(
                    level=level,
                    dict_data=zstandard.ZstdCompressionDict(content) if content else None,
                    write_checksum=False,
                    write_content_size=False,
                    write_dict_id=False,
                )
                for content in (good, bad)
            ]
        return self.compressors

    def of(self, text: str | None) -> list[float]:
        """Length of the text in bytes, and its size under either dictionary."""
        raw = (text or "").encode("utf-8")
        return [float(len(raw)), *(float(len(c.compress(raw))) for c in self._ready())]


def features(sizes: np.ndarray) -> np.ndarray:
    """Per row of (length, good size, bad size): the normalised difference and what goes with it."""
    length, good, bad = np.atleast_2d(sizes).T
    length = np.maximum(length, 1.0)
    by_length = np.clip((bad - good) / length, -2.0, 2.0)
    by_size = (bad - good) / np.maximum(bad + good, 1.0)
    left = np.clip(np.minimum(good, bad) / length, 0.0, 2.0)
    return np.column_stack([by_length, by_size, left, by_length**2, left**2, by_length * left, np.sqrt(left)])


@dataclass
class Model:
    sizes: Sizes | None
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = self.weights[-1]
        if self.sizes is not None:
            x = (features(np.array(self.sizes.of(text)))[0] - self.mean) / self.spread
            z = z + float(np.clip(x, -8.0, 8.0) @ self.weights[:-1])
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def calibrated(
    sizes: Sizes, measured: np.ndarray, good: np.ndarray, odds: float, s: Settings = Settings()
) -> Model:
    """Logistic regression of the label on the features, by Newton's method.

    The sample may hold the labels in other shares than the table, whose good to bad ``odds``
    the intercept is corrected to.
    """
    x = features(measured)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.clip((x - mean) / spread, -8.0, 8.0), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), s.penalty * len(x))
    ridge[-1] = 1e-9
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30.0, 30.0)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge), x.T @ (good - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += np.log(odds * (1 - good.mean()) / good.mean())
    return Model(sizes, mean, spread, w)


def _constant(z: float) -> Model:
    return Model(None, np.zeros(0), np.ones(0), np.array([z]))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on rows outside the held-out fold. ``docs`` has doc_id and text, ``labels`` doc_id and quality."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (bucket("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
        .where("least = most")
        .select("doc_id", (F.col("least") == 1).alias("good"))
    )
    n = known.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if not n.good or not n.bad:
        return _constant(0.0 if not n.good and not n.bad else 30.0 if n.good else -30.0)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 11) / float(1 << 53)
    chance = F.when(F.col("good"), 2 * s.max_documents / n.good).otherwise(2 * s.max_documents / n.bad)
    builds = F.xxhash64(F.lit(6), F.col("doc_id")) % 2 == 0
    # About four times max_documents identifiers are broadcast, whatever the number of labels.
    drawn = F.broadcast(known.where(unit < chance).select("doc_id", "good", builds.alias("builds")))
    sample = docs.select("doc_id", "text").join(drawn, "doc_id")
    texts = sample.where("builds").select("good", "text").collect()
    sizes = Sizes(*(dictionary(sorted((r.text or "").encode() for r in texts if r.good == x), s) for x in (True, False)), s.level)
    shared = docs.sparkSession.sparkContext.broadcast(sizes)
    measure = per_text(lambda t: shared.value.of(t), "array<double>")
    rows = sample.where("NOT builds").select("good", measure("text").alias("sizes")).collect()
    good = np.array([r.good for r in rows], dtype=float)
    if not len(rows) or good.min() == good.max():
        share = n.good / (n.good + n.bad)
        return _constant(float(np.log(share / (1 - share))))
    return calibrated(sizes, np.array([r.sizes for r in rows]), good, n.good / n.bad, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``. The model is two dictionaries and a few numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = with_columns(docs, score=per_text(lambda t: shared.value.score(t), "double")(F.col("text")))
    return with_columns(scored, predicted=(F.col("score") >= THRESHOLD).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    held_out = bucket("doc_id", FOLDS) == HELD_OUT
    scored = score(docs.select("doc_id", "text"), train(docs, labels, s))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
