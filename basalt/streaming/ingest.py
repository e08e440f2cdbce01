"""Folders of Parquet files as streams that end when all files are read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType | str, files_a_batch: int = 8, name: str | None = None) -> DataFrame:
    """Files of a folder as a stream; ``name`` is a glob of file names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)


def write_chunks(frame: DataFrame, path: str, checkpoint: str, rows_a_file: int, key: str | None = None, start: int | None = None, end: int | None = None, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append micro-batches to a Parquet folder, at most ``rows_a_file`` rows a file; a stream has no global offset, so a slice is by ``key``."""

    def put(batch: DataFrame, epoch: int) -> None:
        part = batch
        if key and start is not None:
            part = part.filter(F.col(key) >= start)
        if key and end is not None:
            part = part.filter(F.col(key) < end)
        # a batch that is run again overwrites what it wrote before
        change(part).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/batch={epoch}")

    frame.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_totals(frame: DataFrame, keys: Sequence[str], totals: dict[str, Column], path: str, checkpoint: str) -> None:
    """Aggregates per key over all batches so far, in update mode: each batch writes the keys it changed, with their new totals, as a
    change of its own. A batch that is run again after a crash overwrites its change, so nothing is counted twice. ``totals``: names to
    aggregates. Works on while files come: started again with the same ``checkpoint`` it goes on where it was."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/change={epoch}")

    changed = frame.groupBy(*keys).agg(*(c.alias(name) for name, c in totals.items()))
    changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_totals(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The state that ``running_totals`` has reached: of each key what its last change says."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in (*keys, "change")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "change").alias("_v"))
    return last.select(*keys, "_v.*")
