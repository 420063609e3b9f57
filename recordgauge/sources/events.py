"""Read JSON records as text, one record per row in column ``v``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Options of Spark's text source. A line ends at a line feed only, as a carriage return is
# white space to JSON.
LAYOUTS = {"lines": {"lineSep": "\n"}, "document": {"wholetext": True}}


def read_events(spark: SparkSession, path: str | list[str], layout: str = "lines") -> DataFrame:
    """``lines``: one record per line (JSON Lines). ``document``: one record per file.

    Partition directories come along as columns. Text stays text here: a JSON reader would not
    tell a missing name from a null one. A file of lines is divided among tasks, a document is
    read whole.
    """
    return spark.read.text(path, **_options(layout)).withColumnRenamed("value", "v")


def stream_events(
    spark: SparkSession,
    path: str,
    layout: str = "lines",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same for files as they arrive in a directory."""
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path, **_options(layout)).withColumnRenamed("value", "v")


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Deal rows out to ``tasks`` tasks.

    A full shuffle of the rows. It pays for an input that cannot be divided, such as one long
    compressed file; others are divided by ``spark.sql.files.maxPartitionBytes`` without.
    """
    return df.repartition(tasks)


def _options(layout: str) -> dict:
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {sorted(LAYOUTS)}, got {layout!r}")
    return LAYOUTS[layout]
