"""Merge the directories of a stream's closed batches, so that their number stays bounded.

A stream's output has a directory for each batch. ``compact`` merges ``fan_in`` neighbouring
directories of like size into one named by the batches it holds (``stream_batch=16-31``), and
``fan_in`` of these into a larger one: after ``n`` batches there are fewer than
``fan_in`` * (1 + log(n) / log(``fan_in``)) directories that count, and a record has been rewritten
log(n) / log(``fan_in``) times.

A directory whose batches another one holds as well does not count. A merged directory is written
under a name that readers pass over and gets its own by one rename; in that moment it takes the
place of its parts, for every reader that goes by ``listed_batches``, as
``read_split`` does. The parts stay until the next call, for readers that have listed before.
One process compacts at a time.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from recordgauge.operators.split import SPLIT_BY, Batches, listed_batches, read_split

_HIDDEN = "_compacting-"


def compact(
    spark: SparkSession,
    path: str,
    fan_in: int = 16,
    before: int | None = None,
    schema: StructType | str | None = None,
) -> list[str]:
    """Merge what is due among batches below ``before``; names of the new directories.

    Without ``before`` the newest batch is left alone, as a stream may run it again. ``schema`` is
    the annotated frame's, needed only where no batch holds a record.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    files, root = _file_system(spark, path)
    for name in _names(files, root):
        if name.startswith(_HIDDEN):  # of a call that was cut off
            files.delete(_child(spark, root, name), True)
    listed = listed_batches(_names(files, root))
    for old in listed.replaced:
        files.delete(_child(spark, root, old.name), True)
    live = listed.live
    if before is None:
        before = max((b.last for b in live), default=0)
    made = []
    while due := _due([b for b in live if b.last < before], fan_in):
        merged = Batches(due[0].first, due[-1].last)
        hidden = f"{path.rstrip('/')}/{_HIDDEN}{uuid.uuid4().hex}"
        rows = read_split(spark, path, schema, [b.name for b in due])
        rows.write.partitionBy(*SPLIT_BY).parquet(hidden)
        if not files.rename(_child(spark, root, hidden.rpartition("/")[2]), _child(spark, root, merged.name)):
            raise OSError(f"{merged.name} could not be put in place")
        made.append(merged.name)
        live = sorted([*(b for b in live if b not in due), merged])
    return made


def holds(spark: SparkSession, path: str, number: int) -> bool:
    """Whether a merged directory already has this batch."""
    files, root = _file_system(spark, path)
    return any(b.first <= number <= b.last and b.first < b.last for b in listed_batches(_names(files, root)).live)


def _due(closed: list[Batches], fan_in: int) -> list[Batches]:
    """The oldest ``fan_in`` neighbours of one level, or none. Levels fall from old to new."""

    def level(b: Batches) -> int:
        n, size = 0, b.last - b.first + 1
        while size >= fan_in:
            n, size = n + 1, size // fan_in
        return n

    for i in range(len(closed) - fan_in + 1):
        some = closed[i : i + fan_in]
        if len({level(b) for b in some}) == 1:
            return some
    return []


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _names(files: JavaObject, root: JavaObject) -> list[str]:
    return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []


def _child(spark: SparkSession, root: JavaObject, name: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(root, name)
