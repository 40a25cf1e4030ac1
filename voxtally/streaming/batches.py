"""An appended table as a bucketed snapshot and the batches that came after it.

Every micro-batch is a folder of its own number, so a batch that is repeated after a
failure overwrites itself. Folding merges the batches into a snapshot that is bucketed
by the key: rows of one key are in one file, whatever batch brought them. A reader joins
the snapshot with the newer batches, bucket with bucket. Only the batches are shuffled,
the snapshot stays where it is, and batches that were folded are not read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.operators.groups import latest_per_key

BATCH, SNAPSHOT = "batch", "snapshot"


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished folders ``name=N`` below ``path``, smallest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = []
    for status in files.listStatus(root):
        folder, _, number = status.getPath().getName().partition("=")
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if folder == name and files.exists(done):
            found.append(int(number))
    return sorted(found)


def removed(spark: SparkSession, folder: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def write_buckets(df: DataFrame, folder: str, key: Sequence[str], buckets: int) -> None:
    """Write files that hold one bucket of the key each."""
    name = f"buckets_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, *key).sortBy(*key).option("path", folder)
    writer.format("parquet").saveAsTable(name)
    # The table is external: its files stay, and the next reader names them anew.
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_buckets(spark: SparkSession, folder: str, schema: StructType, key: Sequence[str], buckets: int) -> DataFrame:
    """Files of :func:`write_buckets`, of which Spark knows the buckets."""
    name, columns = f"buckets_{uuid.uuid4().hex}", ", ".join(f"`{c}`" for c in key)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = folder.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns})"
        f" INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    df = spark.table(name)
    assert df.schema  # resolved while the name is known
    spark.sql(f"DROP TABLE {name}")
    return df


class BatchStore:
    """Rows of one schema in one folder: the last row of every key by ``order`` counts.

    Of rows that agree on ``order`` the one of the later batch stays. Rows without a key are
    left out when the store is read.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        key: Sequence[str],
        order: Sequence[str],
        buckets: int = 64,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.order, self.buckets = list(key), list(order), buckets

    def run(self, stream: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> None:
        """Put all that has arrived through a row-wise stage; the store keeps the stream's progress."""

        def append(rows: DataFrame, number: int) -> None:
            made = stage(rows).select(*self.schema.names)
            made.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={number}")

        writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{self.path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()

    def folded(self) -> int:
        """Number of the last batch that is in the snapshot, -1 if there is none."""
        return max(numbered_folders(self.spark, self.path, SNAPSHOT), default=-1)

    def newer(self) -> list[int]:
        """Numbers of the batches that are not folded yet."""
        upto = self.folded()
        return [n for n in numbered_folders(self.spark, self.path, BATCH) if n > upto]

    def _tail(self, batches: Sequence[int]) -> DataFrame:
        parts = [
            self.spark.read.schema(self.schema).parquet(f"{self.path}/{BATCH}={n}").withColumn("_batch", F.lit(n))
            for n in batches
        ]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.union(more)
        has_key = F.expr(" and ".join(f"`{c}` is not null" for c in self.key))
        # Dealt as the snapshot is, so the same shuffle serves the aggregation and the join.
        dealt = rows.filter(has_key).repartition(self.buckets, *self.key)
        return latest_per_key(dealt, self.key, [*self.order, "_batch"]).drop("_batch")

    def read(self) -> DataFrame:
        """The last row of every key."""
        upto, batches = self.folded(), self.newer()
        if upto < 0 and not batches:
            return self.spark.createDataFrame([], self.schema)
        if upto < 0:
            return self._tail(batches)
        snapshot = read_buckets(
            self.spark, f"{self.path}/{SNAPSHOT}={upto}", self.schema, self.key, self.buckets
        )
        if not batches:
            return snapshot
        old = snapshot.withColumn("_old", F.lit(True)).alias("s")
        new = self._tail(batches).withColumn("_new", F.lit(True)).alias("t")
        joined = old.join(new, self.key, "full_outer")
        later = F.struct(*(F.col(f"t.{c}") for c in self.order)) >= F.struct(*(F.col(f"s.{c}") for c in self.order))
        wins = F.col("t._new").isNotNull() & (F.col("s._old").isNull() | later)
        out = []
        for c in self.schema.names:
            kept = F.when(wins, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
            out.append(F.col(c) if c in self.key else kept.alias(c))
        return joined.select(*out)

    def fold(self) -> None:
        """Make a snapshot of all there is. Each task merges and writes one bucket."""
        batches = self.newer()
        if batches:
            folder = f"{self.path}/{SNAPSHOT}={batches[-1]}"
            # What a run that was cut off has left; unfinished snapshots are never read.
            removed(self.spark, folder)
            write_buckets(self.read(), folder, self.key, self.buckets)

    def forget(self) -> None:
        """Remove the batches that are folded, and all snapshots but the last."""
        upto = self.folded()
        for name in (BATCH, SNAPSHOT):
            for n in numbered_folders(self.spark, self.path, name):
                if n < upto or (n == upto and name == BATCH):
                    removed(self.spark, f"{self.path}/{name}={n}")
