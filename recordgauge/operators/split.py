"""Part the accepted records from the quarantined ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLIT_BY = ("status", "valid")
STREAM_BATCH = "stream_batch"


@dataclass(frozen=True, order=True)
class Batches:
    """The batches that one directory of a stream's output holds."""

    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{STREAM_BATCH}={self.first}" + (f"-{self.last}" if self.last > self.first else "")


@dataclass(frozen=True)
class Listed:
    """Directories that count, in order, and those whose batches a larger one has taken over."""

    live: list[Batches]
    replaced: list[Batches]


def listed_batches(names: list[str]) -> Listed:
    """Which of the directories in a stream's output count."""
    found = (re.fullmatch(rf"{STREAM_BATCH}=(\d+)(?:-(\d+))?", n) for n in names)
    every = sorted((Batches(int(m[1]), int(m[2] or m[1])) for m in found if m), key=lambda b: (b.first, -b.last))
    live: list[Batches] = []
    replaced: list[Batches] = []
    for b in every:
        (replaced if live and b.last <= live[-1].last else live).append(b)
    return Listed(live, replaced)


def accepted(annotated: DataFrame) -> DataFrame:
    """Records without a problem."""
    return annotated.filter("valid")


def quarantined(annotated: DataFrame) -> DataFrame:
    """All others: with problems, not an object, malformed."""
    return annotated.filter(~F.coalesce(F.col("valid"), F.lit(False)))


def split(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as frames. Reading both parses every record twice; to keep both, write once
    with ``write_split`` and take the sides of ``read_split``."""
    return accepted(annotated), quarantined(annotated)


def write_split(
    annotated: DataFrame, path: str, mode: str = "errorifexists", even_files: bool = False
) -> None:
    """Write parquet under ``status=…/valid=…`` in one pass.

    There is no shuffle: each task writes the sides it met, so a rare side comes in many small
    files. ``even_files`` shuffles first and lets adaptive execution cut each side, the large
    ones too, into files of ``spark.sql.adaptive.advisoryPartitionSizeInBytes``; without
    adaptive execution each side would be one task, so that is refused.
    """
    if even_files:
        annotated = evened(annotated)
    annotated.write.mode(mode).partitionBy(*SPLIT_BY).parquet(path)


def evened(annotated: DataFrame) -> DataFrame:
    """The records shuffled into partitions of even size, each of one side."""
    if annotated.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        raise ValueError("even_files needs spark.sql.adaptive.enabled")
    return annotated.hint("rebalance", *SPLIT_BY)


def read_split(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    batches: list[str] | None = None,
) -> DataFrame:
    """Read what ``write_split`` or ``write_split_stream`` wrote.

    ``accepted`` and ``quarantined`` of it read only their own directories. Pass the annotated
    frame's schema where the written batch may be empty, which leaves no file to infer it from.
    Of a stream's output each batch is read once, from the largest directory that holds it, or
    from the directories named.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if batches is None:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        batches = [b.name for b in listed_batches(names).live]
    if batches:
        base = path.rstrip("/")
        df = reader.option("basePath", base).parquet(*(f"{base}/{name}" for name in batches))
    else:
        df = reader.parquet(path)
    if STREAM_BATCH in df.columns and (schema is None or STREAM_BATCH not in _names(schema)):
        df = df.drop(STREAM_BATCH)
    return df if schema is not None else df.withColumn("valid", F.col("valid").cast("boolean"))


def _names(schema: StructType | str) -> list[str]:
    return (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
