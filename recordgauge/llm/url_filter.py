"""URL verdicts: listed rules first, else naive Bayes over the words of host and path.

**Words.** Runs of letters in a host or path are often several words written together. The
unigram model is the count of every word in the pages' own text, and of ``SEED_WORDS`` with a
small fixed share. A run's dictionary words are found by joining its parts of up to
``MAX_WORD`` letters, and the run itself, with the unigrams; a Viterbi pass over them, in order of
where they end, gives the most probable split. Letters of no word form unknown pieces of any
length, at a price for the piece and for each letter. Each distinct run is split once.

**Labels.** A URL whose host has a seed word is an example of what to block, every other one of
what to allow. The rules are not labels: they divide addresses by site and language, and a
classifier taught by them would block languages. Multinomial naive Bayes with both classes
smoothed towards the words' overall shares (``SMOOTHING`` tokens' worth) scores the words of
host and path; its log odds above zero block. The counts cover all URLs.

Tables that grow with the input (unigrams, runs, weights, scores) are only joined, never
broadcast by hint. URLs are first grouped by their runs, so that counts travel instead of rows.
Runs, words or groups that are a large part of all rows (``com``) meet tables with one row a
key; adaptive execution splits them.

Defined results: a null URL or one without ``://`` has an empty host and path; a URL without
letters gets the prior log odds, so the commoner class; null html counts no words; repeated rows
and a null page_id are rows of their own; an empty table gives an empty result; other columns of
the input are left out. Of rules of equal length the first listed wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.plans.scratch import discard, staged

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)

# Words of hosts that are examples of what to block.
SEED_WORDS = tuple(
    "ads adserver adult bet bets betting casino escort gambling hentai jackpot lottery malware "
    "nude phishing pills poker porn roulette sex slots spam spyware torrent viagra warez webcam "
    "xxx".split()
)
MAX_WORD = 24
SEED_SHARE = 1e-6
SMOOTHING = 10.0
# Price of an unknown piece, in log probability, for itself (with the corpus's size) and a letter.
UNKNOWN_LETTER = -math.log(10)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z in lower case, and the path of a URL; empty strings without ``://``."""
    start = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    fitting = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: -len(r.text))
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fitting, none)


def runs_of(text: Column) -> Column:
    """Maximal runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def unigrams(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): how often each word stands in the pages' text, tags left out."""
    text = F.regexp_replace(F.col(html), "<[^<>]*>", " ")
    return pages.select(F.explode(runs_of(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def log_probabilities(counted: DataFrame, seeds: tuple[str, ...] = SEED_WORDS) -> tuple[DataFrame, float]:
    """(word, logp) of counted words and seeds, and the log price of an unknown piece."""
    total = counted.agg(F.sum("n")).first()[0] or 1
    spark = counted.sparkSession
    shares = counted.select("word", (F.col("n") / F.lit(float(total))).alias("p")).unionAll(
        spark.createDataFrame([(w, SEED_SHARE) for w in seeds], "word string, p double")
    )
    table = shares.groupBy("word").agg(F.log(F.max("p")).alias("logp"))
    return table, math.log(10.0 / total)


def split_runs(runs: DataFrame, words: DataFrame, unknown: float, longest: int = MAX_WORD) -> DataFrame:
    """(run, words): the most probable split of each run.

    ``runs`` (run) has each run once, ``words`` (word, logp) each word once. Of equally probable
    splits the one with the longer last word wins.
    """
    numbered, path = staged(runs.select("run", F.monotonically_increasing_id().alias("id")), "url-runs")
    size = F.length("run")
    starts = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("start"), F.substring(F.col("run"), i, F.lit(longest)).alias("part")))
    parts = (
        numbered.select("id", F.explode(starts).alias("at"))
        .select("id", "at.start", "at.part", F.explode(F.sequence(F.lit(1), F.length("at.part"))).alias("size"))
        .select("id", (F.col("start") + F.col("size") - 1).alias("end"), "size", F.substring(F.col("part"), F.lit(1), F.col("size")).alias("word"))
        .unionAll(numbered.where(size > longest).select("id", size.alias("end"), size.alias("size"), F.col("run").alias("word")))
    )
    known = parts.join(words, "word").select("id", "end", "size", "logp", F.lit(None).cast("string").alias("run"))
    # Comes last in its run and carries the letters.
    last = numbered.select("id", (size + 1).alias("end"), F.lit(0).alias("size"), F.lit(0.0).alias("logp"), "run")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, unknown)

    found, _ = staged(
        known.unionAll(last)
        .repartition("id")
        .sortWithinPartitions("id", "end", "size")
        .mapInArrow(search, "run string, words array<string>"),
        "url-words",
    )
    discard(runs.sparkSession, path)
    return found


class Viterbi:
    """Best splits of one run's beginnings, as its words arrive in order of their ends."""

    def __init__(self, unknown: float) -> None:
        self.unknown = unknown
        self.best = [0.0]  # of the first i letters
        self.origin = [0]  # where the last piece of the best split begins
        self.open = -math.inf  # the best split of as many letters that ends in an unknown piece
        self.opened = 0
        self.words: list[tuple[int, float]] = []

    def advance(self, end: int) -> None:
        """Decide all beginnings shorter than ``end``."""
        while len(self.best) < end:
            i = len(self.best)
            fresh = self.best[i - 1] + self.unknown
            if fresh > self.open:
                self.open, self.opened = fresh, i - 1
            self.open += UNKNOWN_LETTER
            best, origin = self.open, self.opened
            for size, logp in self.words:
                if (p := self.best[i - size] + logp) >= best:
                    best, origin = p, i - size
            self.words = []
            self.best.append(best)
            self.origin.append(origin)

    def add(self, end: int, size: int, logp: float) -> None:
        self.advance(end)
        self.words.append((size, logp))

    def split(self, run: str) -> list[str]:
        self.advance(len(run) + 1)
        end, words = len(run), []
        while end:
            words.append(run[self.origin[end] : end])
            end = self.origin[end]
        return words[::-1]


def _searched(batches: Iterator[pa.RecordBatch], unknown: float) -> Iterator[pa.RecordBatch]:
    state = Viterbi(unknown)
    for batch in batches:
        runs, words = [], []
        for _, end, size, logp, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None:
                state.add(end, size, logp)
            else:
                runs.append(run)
                words.append(state.split(run))
                state = Viterbi(unknown)
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])


def _weights(counts: DataFrame, smoothing: float) -> DataFrame:
    """(word, weight) from (word, n_block, n_allow): log odds with both classes smoothed."""
    total = counts.agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a")).first()
    b, a = float(total.b or 0), float(total.a or 0)
    share = (F.col("n_block") + F.col("n_allow")) * smoothing / F.lit(max(a + b, 1.0))
    block = (F.col("n_block") + share) / F.lit(b + smoothing)
    allow = (F.col("n_allow") + share) / F.lit(a + smoothing)
    return counts.select("word", F.log(block / allow).alias("weight"))


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    seeds: tuple[str, ...] = SEED_WORDS,
    smoothing: float = SMOOTHING,
    longest: int = MAX_WORD,
) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, score.

    ``score`` is the log odds of blocking, whether a rule decides or not.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    runs = {"host_runs": runs_of(F.col("host")), "path_runs": runs_of(F.col("path"))}
    # A letter run holds neither a space nor a slash.
    shape = F.concat_ws("/", *(F.array_join(r, " ") for r in runs.values()))
    shapes, shapes_path = staged(
        urls.select(shape.alias("shape"), *(c.alias(n) for n, c in runs.items()))
        .groupBy("shape")
        .agg(F.count(F.lit(1)).alias("n"), *(F.first(n).alias(n) for n in runs))
        .withColumn("id", F.monotonically_increasing_id()),
        "url-shapes",
    )
    in_host = shapes.select("id", "n", F.explode("host_runs").alias("run"), F.lit(True).alias("in_host"))
    in_path = shapes.select("id", "n", F.explode("path_runs").alias("run"), F.lit(False).alias("in_host"))
    pairs = in_host.unionAll(in_path)

    counted, counted_path = staged(unigrams(pages), "url-unigrams")
    table, unknown = log_probabilities(counted, seeds)
    split = split_runs(pairs.select("run").distinct(), table, unknown, longest)
    seeded = F.arrays_overlap("words", F.array(*map(F.lit, seeds)).cast("array<string>"))
    marked = split.select("run", F.coalesce(seeded, F.lit(False)).alias("seeded"))

    bad = pairs.where("in_host").join(marked.where("seeded"), "run", "left_semi").select("id").distinct()
    labelled = shapes.select("id", "n").join(bad.withColumn("bad", F.lit(True)), "id", "left")
    labels, labels_path = staged(labelled.select("id", "n", F.coalesce("bad", F.lit(False)).alias("bad")), "url-labels")
    by_label = lambda label: F.sum(F.when(F.col("bad") == label, F.col("n")).otherwise(0))
    prior = labels.agg(by_label(True).alias("b"), by_label(False).alias("a")).first()
    prior_odds = math.log(((prior.b or 0) + 1) / ((prior.a or 0) + 1))

    by_run = pairs.drop("n").join(labels, "id").groupBy("run").agg(by_label(True).alias("n_block"), by_label(False).alias("n_allow"))
    counts = (
        by_run.join(split, "run")
        .select(F.explode("words").alias("word"), "n_block", "n_allow")
        .groupBy("word")
        .agg(F.sum("n_block").alias("n_block"), F.sum("n_allow").alias("n_allow"))
    )
    counts, counts_path = staged(counts, "url-counts")
    run_scores = (
        split.select("run", F.explode("words").alias("word"))
        .join(_weights(counts, smoothing), "word")
        .groupBy("run")
        .agg(F.sum("weight").alias("weight"))
    )
    scores = pairs.join(run_scores, "run").groupBy("id").agg(F.sum("weight").alias("weight"))
    scored, _ = staged(
        shapes.join(scores, "id", "left").select("shape", F.round(F.coalesce("weight", F.lit(0.0)) + prior_odds, 6).alias("score")),
        "url-scores",
    )
    discard(spark, shapes_path, counted_path, labels_path, counts_path)
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    by_score = F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)
    return (
        urls.select("*", shape.alias("shape"), rule.alias("_rule"))
        .join(scored, "shape")
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), by_score).alias("verdict"),
            "score",
        )
    )
