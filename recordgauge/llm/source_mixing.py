"""Mixing documents to target shares of tokens by iterative proportional fitting.

Documents are counted by (source, language, topic) cell. Starting from the cells' tokens, their
weights are scaled to meet the target share of every source, then of every language, then of
every topic, and again, until no factor differs from one by more than ``tolerance``. Weight over
tokens, times a common scale, is a cell's probability; the scale is chosen so that the expected
sample has ``keep`` of all tokens although no probability exceeds one. A document stays if the
hash of its doc_id, read as a number between 0 and 1, is below the probability.

Default targets are the present shares to the power ``smoothing``, which takes from the large
ones. Tokens are words here. A table without a ``topic`` column gets one from the text's form.

The cells are counted where the documents are and all later work is on them, as Spark tables:
their number follows the sources, not the documents, and a source with a third of the rows is
at most a cell per language and topic.

Defined results: a null source, language or topic is a value of its own; a null text has no
tokens and stays with its cell's probability (one in a cell without tokens); a null doc_id is
replaced by the text in the hash; repeated rows stay or go together; an empty table stays
empty. Targets that name no document's value are ignored, and the rest are scaled to one; a
value without a target has share zero if its dimension has targets. If no positive target is
left for some dimension, that is a ValueError. Columns of the input named like an added one
are replaced, but for ``topic``, which is then the topic.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import with_columns
from recordgauge.plans.scratch import discard, staged

DIMENSIONS = ("source", "lang", "topic")
_KEYS = tuple(f"_{d}" for d in DIMENSIONS)


@dataclass(frozen=True)
class Settings:
    keep: float = 0.8
    smoothing: float = 0.7
    tolerance: float = 1e-3
    max_sweeps: int = 1000
    seed: int = 11
    #: Shares by dimension and value, e.g. {"lang": {"en": 0.5, "de": 0.5}}.
    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(text: Column) -> Column:
    """Counts of a text as a struct: tokens, cell borders and marks."""
    return F.struct(
        tokens(text).alias("words"),
        (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))).alias("borders"),
        F.regexp_count(text, F.lit(r"[#*$%&!]")).alias("marks"),
    )


def topic_by_form(measures: Column) -> Column:
    """A stand-in where no topic is known: what kind of text it is."""
    words = measures["words"]
    return (
        F.when(words == 0, "blank")
        .when(measures["borders"] * 4 > words, "tabular")
        .when(measures["marks"] * 2 > words, "marked")
        .when(words < 50, "brief")
        .when(words < 1000, "prose")
        .otherwise("treatise")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its tokens and keys; a null has a key no text has."""
    # A generator, so that no measure of the text is computed again for each use.
    counted = docs.select("*", F.explode(F.array(_measures(F.col("text")))).alias("_measures"))
    if "topic" not in docs.columns:
        counted = counted.withColumn("topic", topic_by_form(F.col("_measures")))
    keys = {
        key: F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit(""))
        for key, d in zip(_KEYS, DIMENSIONS, strict=True)
    }
    return with_columns(counted, n_tokens=F.col("_measures.words"), **keys).drop("_measures")


def _targets(cells: DataFrame, key: str, given: Mapping[str, float] | None, s: Settings) -> DataFrame:
    """(key, target): the share of tokens that each present value is to have."""
    present = cells.groupBy(key).agg(F.sum("tokens").alias("t"))
    if given is None:
        shares = present.select(key, F.pow(F.col("t").cast("double"), s.smoothing).alias("share"))
    else:
        spark = cells.sparkSession
        rows = [("=" + str(value), float(share)) for value, share in given.items()]
        table = spark.createDataFrame(rows, f"{key} string, share double")
        shares = present.where("t > 0").join(table, key, "left").select(key, F.coalesce("share", F.lit(0.0)).alias("share"))
    total = shares.agg(F.sum("share")).first()[0] or 1.0
    return shares.select(key, (F.col("share") / total).alias("target"))


def rake(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, str]:
    """Cells with ``tokens``, ``weight`` and the last sweep's factors, as a staged table.

    A cell without tokens keeps weight zero. ``fit_error`` is how far the last sweep's factors
    were from one at most: above ``tolerance``, ``max_sweeps`` have ended the fit, as when the
    targets contradict each other.
    """
    spark = docs.sparkSession
    counted = _keyed(docs).groupBy(*_KEYS).agg(F.sum("n_tokens").alias("tokens"))
    cells, path = staged(counted.withColumn("weight", F.col("tokens").cast("double")), "mixing-cells")
    wanted, paths = {}, []
    for key, dimension in zip(_KEYS, DIMENSIONS, strict=True):
        wanted[key], kept = staged(_targets(cells, key, s.targets.get(dimension), s), "mixing-targets")
        paths.append(kept)
        if dimension in s.targets and not wanted[key].where("target > 0").take(1) and cells.where("tokens > 0").take(1):
            raise ValueError(f"no document has a {dimension} with a positive target")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    error = 0.0
    for _ in range(s.max_sweeps):
        swept = cells.select(*_KEYS, "tokens", "weight")
        for key in _KEYS:
            held = swept.groupBy(key).agg(F.sum("weight").alias("held")).join(wanted[key], key)
            factor = F.when(F.col("held") > 0, F.col("target") * float(total) / F.col("held")).otherwise(1.0)
            swept = swept.join(held.select(key, factor.alias(f"factor{key}")), key, "left").withColumn(
                "weight", F.col("weight") * F.coalesce(F.col(f"factor{key}"), F.lit(0.0))
            )
        before = path
        cells, path = staged(swept, "mixing-cells")
        discard(spark, before)
        off = cells.where("weight > 0").agg(
            *(F.max(F.abs(F.col(f"factor{key}") - 1)).alias(key) for key in _KEYS)
        ).first()
        error = max((x or 0.0) for x in off)
        if error <= s.tolerance:
            break
    discard(spark, *paths)
    return cells.withColumn("fit_error", F.lit(error)), path


def probabilities(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per cell: its keys, ``weight`` and ``probability``."""
    cells, _ = rake(docs, s)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted, scale = s.keep * total, s.keep
    while True:
        # Cells at probability one keep all they have; the scale serves the others.
        full = F.col("weight") * scale >= F.col("tokens")
        sums = cells.where("tokens > 0").agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not sums.open:
            break
        better = (wanted - sums.full) / sums.open
        if better <= scale * (1 + 1e-9):
            break
        scale = better
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens")))
    return cells.select(*_KEYS, "weight", chance.otherwise(1.0).alias("probability"), "fit_error")


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with topic, n_tokens, weight (of its cell), probability, whether it is ``kept``, and
    the ``fit_error`` of the weights."""
    free = docs.drop("weight", "probability", "kept", "fit_error")
    keyed = _keyed(free).join(probabilities(docs, s), list(_KEYS))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.col("text")), F.lit("="))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(s.seed), name), 11) / float(1 << 53)
    return keyed.withColumn("kept", uniform < F.col("probability")).drop(*_KEYS)


def sample(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    added = {"n_tokens", "weight", "probability", "kept", "fit_error", "_measures", *_KEYS}
    if not added & {c.lower() for c in docs.columns}:
        return mixed(docs, s).where("kept").select(*docs.columns)
    packed = docs.select("doc_id", "text", *(c for c in DIMENSIONS if c in docs.columns), F.struct("*").alias("_all"))
    return mixed(packed, s).where("kept").select("_all.*")
