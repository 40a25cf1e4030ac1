"""Keyed state without a watermark: nothing that comes late is lost.

The state of the keys lives in RocksDB next to the executor and in the checkpoint, so it
may be larger than memory, and a run that is started again goes on from it. It is kept in
buckets of keys, whose number must stay the same for a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from voxtally.streaming.batches import BATCH, SNAPSHOT, numbered_folders

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A bucket should hold some hundreds of keys, a few thousand at most.
BUCKETS = 1 << 13


@contextmanager
def rocksdb(spark: SparkSession):
    """State of the streams that start inside is kept in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def work_off(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Append what a stateful stream gives for all that has arrived to a table of files."""
    with rocksdb(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("path", sink).outputMode(mode)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _in_buckets(stream: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """Gives every row its key as text, which is equal where the key columns are, and the bucket of that key."""

    floats = [f.name for f in stream.schema if f.dataType in (FloatType(), DoubleType())]
    # 0.0 and -0.0 are one key.
    plain = lambda c: F.when(F.col(c) == 0, F.abs(c)).otherwise(F.col(c)) if c in floats else F.col(c)
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    text = F.to_json(F.struct(*(plain(c).alias(f"k{i}") for i, c in enumerate(key))), {**times, "timeZone": "UTC"})
    return stream.withColumn("_key", text).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))


class _Buckets(StatefulProcessor):
    """The state of a bucket is one array per column: the keys, and what is remembered of each.

    Every call to the state goes to the JVM and back, and every group gives out a batch of its
    own, so there is one of these for a bucket and not for a key.
    """

    def __init__(self, kept: StructType):
        columns = [StructField("key", StringType()), *kept.fields]
        self.ddl = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("keys", self.ddl)

    def known(self) -> dict[str, tuple]:
        return {key: tuple(kept) for key, *kept in zip(*self.state.get())} if self.state.exists() else {}

    def keep(self, known: dict[str, tuple]) -> None:
        self.state.update(tuple(map(list, zip(*((key, *kept) for key, kept in known.items())))))

    def close(self) -> None:
        pass


class _First(_Buckets):
    """Remembers the order of the first row of a key, and lets a row pass that is before it."""

    def __init__(self, order: Sequence[str], kept: StructType, columns: Sequence[str]):
        super().__init__(kept)
        self.order, self.columns = list(order), list(columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        firsts = {}
        for row in rows:
            at, place = row["_key"], tuple((row[c] is not None, row[c]) for c in self.order)
            if at not in firsts or place < firsts[at][0]:
                firsts[at] = place, row
        known, changed = self.known(), []
        for at, (place, row) in firsts.items():
            before = known.get(at)
            if before is None or place < tuple((x is not None, x) for x in before):
                known[at] = tuple(row[c] for c in self.order)
                changed.append((row, before is not None))
        if changed:
            self.keep(known)
        for row, correction in changed:
            yield Row(**{c: row[c] for c in self.columns}, is_correction=correction)


def first_of_key(stream: DataFrame, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows whose key was not seen before, however late they come.

    A row that is before the one given out for its key by ``order`` is given out as well, with
    ``is_correction`` set; whoever keeps the rows then replaces the other one. Repeated
    deliveries and later rows give nothing. State is one small entry per key, for ever, in
    ``buckets`` that are read and written whole; their number stays with the checkpoint.
    NULLs are first in the order.
    """
    kept = StructType([StructField(f"o{i}", stream.schema[c].dataType) for i, c in enumerate(order)])
    out = StructType([*stream.schema.fields, StructField("is_correction", BooleanType())])
    return _in_buckets(stream, key, buckets).groupBy("_bucket").transformWithState(
        statefulProcessor=_First(order, kept, stream.columns), outputStructType=out, outputMode="Append", timeMode="None"
    )


class _Signed(_Buckets):
    """Remembers what a key counts for, and gives out what a change takes away and adds."""

    def __init__(self, by: Sequence[str], version: str, deleted: str, kept: StructType):
        super().__init__(kept)
        self.by, self.version, self.deleted = list(by), version, deleted

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lasts = {}
        for row in rows:
            at, place = row["_key"], (row[self.version], row[self.deleted])
            if place[0] is not None and (at not in lasts or place > lasts[at][0]):
                lasts[at] = place, tuple(row[c] for c in self.by)
        # The value is (version, counted or not, what it counts for).
        known, changed, signed = self.known(), False, []
        for at, ((version, deleted), values) in lasts.items():
            now = known.get(at)
            if now is not None and version <= now[0]:
                continue
            known[at], changed = (version, not deleted, *values), True
            before = now[2:] if now is not None and now[1] else None
            if not deleted and before == values:
                continue
            if before is not None:
                signed.append((before, -1))
            if not deleted:
                signed.append((values, 1))
        if changed:
            self.keep(known)
        for values, delta in signed:
            yield Row(**dict(zip(self.by, values)), delta=delta)


def signed_rows(
    changes: DataFrame,
    key: Sequence[str],
    by: Sequence[str],
    version: str = "version",
    deleted: str = "deleted",
    buckets: int = BUCKETS,
) -> DataFrame:
    """What a stream of changes does to counts by ``by``: rows of ``by`` with a ``delta`` of 1 or -1.

    A change carries the key, a version, the new values of ``by``, and whether the row is deleted.
    A key that is new counts once, one whose values change counts for the new and no longer
    for the old ones, and a deleted one no longer counts. Changes that are not newer than what
    is known of the key change nothing; in one batch, a deletion is newer than a change of the
    same version. Changes without a version are left out. The old values come from the
    state, not from the store: one small entry per key, in ``buckets`` that are read and written
    whole; their number stays with the checkpoint.
    """
    schema = changes.schema
    kept = [StructField("version", schema[version].dataType), StructField("counts", BooleanType())]
    kept = StructType(kept + [StructField(f"v{i}", schema[c].dataType) for i, c in enumerate(by)])
    out = StructType([*(StructField(c, schema[c].dataType) for c in by), StructField("delta", IntegerType())])
    needed = dict.fromkeys(["_bucket", "_key", version, deleted, *by])
    dealt = _in_buckets(changes, key, buckets).withColumn(deleted, F.coalesce(deleted, F.lit(False))).select(*needed)
    return dealt.groupBy("_bucket").transformWithState(
        statefulProcessor=_Signed(by, version, deleted, kept), outputStructType=out, outputMode="Append", timeMode="None"
    )


class RunningCounts:
    """Counts by some columns under insertions, changes and deletions.

    Every batch writes the sums of its signed rows to a folder of its own number; a batch
    that is repeated overwrites it. Folding sums the folders up into one, and the counts
    are the sums of the last folded one and of the newer batches. The store of the rows
    themselves is never read.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), list(by), buckets

    def run(self, changes: DataFrame, key: Sequence[str], version: str = "version", deleted: str = "deleted") -> None:
        """Count all changes that have arrived; the progress and the state are kept with the counts."""

        def write(rows: DataFrame, number: int) -> None:
            summed = rows.groupBy(*self.by).agg(F.sum("delta").alias("n")).filter("n <> 0")
            summed.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={number}")

        with rocksdb(self.spark):
            rows = signed_rows(changes, key, self.by, version, deleted, self.buckets)
            writer = rows.writeStream.foreachBatch(write).outputMode("append")
            writer = writer.option("checkpointLocation", f"{self.path}/progress")
            writer.trigger(availableNow=True).start().awaitTermination()

    def _parts(self) -> tuple[int, list[int], list[str]]:
        upto = max(numbered_folders(self.spark, self.path, SNAPSHOT), default=-1)
        newer = [n for n in numbered_folders(self.spark, self.path, BATCH) if n > upto]
        folders = [f"{self.path}/{SNAPSHOT}={upto}"] if upto >= 0 else []
        return upto, newer, folders + [f"{self.path}/{BATCH}={n}" for n in newer]

    def read(self) -> DataFrame:
        """Rows of ``by`` with their count ``n``; what no longer occurs is not there."""
        folders = self._parts()[2]
        if not folders:
            raise FileNotFoundError(f"no counts below {self.path}")
        parts = [self.spark.read.parquet(f) for f in folders]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy(*self.by).agg(F.sum("n").alias("n")).filter("n <> 0")

    def fold(self) -> None:
        """Sum up all there is into one folder, which from then on stands for the batches in it."""
        _, newer, _ = self._parts()
        if newer:
            self.read().write.mode("overwrite").parquet(f"{self.path}/{SNAPSHOT}={newer[-1]}")
