"""Incremental runs: each new file is processed once and then remembered.

These take the place of polling the output table for rows that are missing. A
run works off everything that has arrived and ends; the checkpoint knows where
the next one goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.operators.groups import latest_per_key

BATCH = "batch_id"


def read_stream(
    spark: SparkSession, path: str, schema: StructType, max_files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they arrive. The schema is given, so none is opened to guess it."""
    reader = spark.readStream.schema(schema)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.parquet(path)


def run_incremental(
    stream: DataFrame, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> None:
    """Put what has arrived through a row-wise stage and append it to a table of files.

    The file sink logs which files each batch has written, so a batch that is
    repeated after a failure does not show twice.
    """
    writer = stage(stream).writeStream.format("parquet").option("path", sink)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()


def deduplicated_dropping_late(
    stream: DataFrame, key: Sequence[str], time: str, delay: str
) -> DataFrame:
    """Drop rows whose key was seen within ``delay``; only that much state is kept.

    Rows older than the newest time less ``delay`` are lost, whether seen before or
    not. Where every row counts, append all and use :func:`read_first`.
    """
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("_time")


def run_label_counts(
    stream: DataFrame, by: Sequence[str], sink: str, checkpoint: str
) -> None:
    """Keep rows per request and label current.

    A batch writes the counts it has changed to a folder of its own number. When
    it is repeated it overwrites that folder with the same rows.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch}")

    counts = stream.groupBy(*by).agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def read_label_counts(spark: SparkSession, by: Sequence[str], sink: str) -> DataFrame:
    """The latest count of every key."""
    return latest_per_key(spark.read.parquet(sink), list(by), [BATCH]).drop(BATCH)


def read_first(spark: SparkSession, sink: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """An appended table without repeats: the first row of every key, however late it came.

    Rows that agree on ``order`` as well should be equal, else any of them may stay.
    """
    rows = spark.read.parquet(sink)
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(kept).select(*key, "_row.*").select(*rows.columns)


def compact(spark: SparkSession, sink: str, into: str, key: Sequence[str], order: Sequence[str]) -> None:
    """Write the last row of every key of an appended table to a new folder, from which to go on."""
    read_latest(spark, sink, key, order).write.parquet(into)


def read_latest(spark: SparkSession, sink: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """An appended table seen as an upserted one: the last row of every key."""
    return latest_per_key(spark.read.parquet(sink), key, order)
