"""Keep an annotated stream, parted like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recordgauge.operators.split import SPLIT_BY, STREAM_BATCH, evened
from recordgauge.streaming.compaction import compact, holds


def write_split_stream(
    annotated: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    processing_time: str | None = None,
    even_files: bool = False,
    fan_in: int | None = None,
) -> StreamingQuery:
    """Start a query that writes each batch to ``stream_batch=<id>/status=…/valid=…``.

    ``annotate`` keeps no state, so there is no watermark and late records need no care. A batch
    that is run again after a failure has the same number and records and replaces its own
    directory, so nothing doubles, and there is no log that grows with the stream; old batches
    can be moved or removed. ``checkpoint`` must be in storage that outlives the driver.
    ``even_files`` is that of ``write_split``. Bound a batch at the source
    (``max_files_per_trigger``).

    With ``fan_in`` earlier batches, which are closed, are merged as ``compact`` does after each
    batch; where that would keep the stream waiting, leave it out and call ``compact`` from
    another process. Read the output with ``read_split``. A batch that merged directories
    already hold cannot be replaced: that takes a checkpoint set back by more than one batch,
    and is refused.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if holds(spark, path, number):
            raise ValueError(f"batch {number} has been merged and cannot be written again")
        rows = evened(batch) if even_files else batch
        rows.write.mode("overwrite").partitionBy(*SPLIT_BY).parquet(f"{path.rstrip('/')}/{STREAM_BATCH}={number}")
        if fan_in is not None:
            compact(spark, path, fan_in, number, batch.schema)

    writer = annotated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time is not None:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
