"""Which rows a huge store already has, by filters kept next to it.

A store of keys is cut into buckets by a digest of the key. Next to the keys lies a Bloom
filter in words of 64 bits: a key sets a few bits of one word of its bucket. A batch of
keys adds its own words, and words of the same place are merged by OR. New rows look at
the filter first: most of those that are new are told to be so by a bit that is not
set. Only the others are compared with the keys themselves, and only the buckets they
fall into are read. The result is exact; the filter decides what is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.sides import bounded_broadcast, settled
from voxtally.streaming.batches import BATCH, SNAPSHOT, numbered_folders, removed

BUCKETS = 64
# Words per bucket: with 5 keys to a word, about one key in forty that is not there looks as if it were.
WORDS = 1 << 14
BITS = 4


class KeyStore:
    """Keys (one string column) of finished rows in one folder, with a filter over them.

    ``buckets`` and ``words`` (of 64 bits, per bucket) belong to the folder. A batch of
    keys has a number; adding it again replaces it. NULL keys are not kept.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str = "comment_id", buckets: int = BUCKETS, words: int = WORDS
    ):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.words = buckets, words

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), key), F.lit(self.buckets)).cast("int")

    def _word(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(2), key), F.lit(self.words)).cast("int")

    @staticmethod
    def _mask(key: Column) -> Column:
        digest = F.xxhash64(F.lit(3), key)
        shifted = [F.call_function("shiftleft", F.lit(1).cast("long"), _six(digest, k)) for k in range(BITS)]
        return reduce(Column.bitwiseOR, shifted)

    def add(self, keys: DataFrame, number: int) -> None:
        """Keep the keys of one batch and what they add to the filter."""
        key = F.col(self.key).cast("string")
        rows = keys.filter(F.col(self.key).isNotNull()).select(key.alias("key")).distinct()
        rows = rows.withColumn("bucket", self._bucket(F.col("key")))
        folder = f"{self.path}/keys/{BATCH}={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        self._add_filter(self.spark.read.schema("key string, bucket int").parquet(folder), f"{self.path}/filter/{BATCH}={number}")

    def _add_filter(self, rows: DataFrame, folder: str) -> None:
        words = rows.select("bucket", self._word(F.col("key")).alias("word"), self._mask(F.col("key")).alias("mask"))
        words = words.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        words.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def _folders(self, kind: str) -> list[str]:
        """The last snapshot and the batches after it. A batch counts once both its parts are there."""
        place = f"{self.path}/{kind}"
        both = [set(numbered_folders(self.spark, f"{self.path}/{k}", SNAPSHOT)) for k in ("keys", "filter")]
        upto = max(both[0] & both[1], default=-1)
        whole = [set(numbered_folders(self.spark, f"{self.path}/{k}", BATCH)) for k in ("keys", "filter")]
        newer = sorted(n for n in whole[0] & whole[1] if n > upto)
        return ([f"{place}/{SNAPSHOT}={upto}"] if upto >= 0 else []) + [f"{place}/{BATCH}={n}" for n in newer]

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f) for f in self._folders(kind)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.union, parts)

    def filter_words(self) -> DataFrame:
        """The filter: rows (bucket, word, bits)."""
        parts = self._read("filter", "word int, bits long, bucket int")
        return parts.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))

    def suspects(self, rows: DataFrame) -> DataFrame:
        """Distinct keys of the rows that the filter does not rule out, with their bucket."""
        key = F.col(self.key).cast("string")
        asked = rows.filter(F.col(self.key).isNotNull()).select(key.alias("key")).distinct()
        asked = asked.select(
            "key", self._bucket(F.col("key")).alias("bucket"), self._word(F.col("key")).alias("word"), self._mask(F.col("key")).alias("mask")
        )
        # Few rows that ask go to the filter; else the filter's words meet them in a shuffle.
        asked = settled(asked, "asked")
        hit = asked.join(self.filter_words(), ["bucket", "word"])
        return hit.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("key", "bucket")

    def known(self, rows: DataFrame) -> DataFrame:
        """Distinct keys of the rows that the store has."""
        found = settled(self.suspects(rows), "suspects")
        # At most as many numbers as there are buckets.
        buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]
        if not buckets:
            return self.spark.createDataFrame([], "key string")
        keys = self._read("keys", "key string, bucket int").filter(F.col("bucket").isin(buckets))
        return found.select("key").join(keys.select("key").distinct(), "key", "left_semi")

    def unprocessed(self, rows: DataFrame) -> DataFrame:
        """Rows whose key the store does not have; rows without a key are among them."""
        done = bounded_broadcast(self.known(rows).withColumnRenamed("key", "_key"))
        return rows.join(done, F.col(self.key).cast("string") == F.col("_key"), "left_anti")

    def fold(self) -> None:
        """Make one folder of all keys and one of all words; both are there before either counts."""
        last = self._folders("keys")
        if not last or last[-1].rpartition("/")[2].startswith(SNAPSHOT):
            return
        number = last[-1].rpartition("=")[2]
        keys = self._read("keys", "key string, bucket int").distinct()
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/{SNAPSHOT}={number}")
        words = self.filter_words()
        words.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/filter/{SNAPSHOT}={number}"
        )

    def resize(self, words: int) -> "KeyStore":
        """A store with wider filters over the same keys, to be used from then on.

        The folded keys are read once; the filter of the other width is removed.
        """
        self.fold()
        wider = KeyStore(self.spark, self.path, self.key, self.buckets, words)
        numbers = numbered_folders(self.spark, f"{self.path}/keys", SNAPSHOT)
        if numbers:
            folder = f"{self.path}/keys/{SNAPSHOT}={numbers[-1]}"
            removed(self.spark, f"{self.path}/filter")
            wider._add_filter(
                self.spark.read.schema("key string, bucket int").parquet(folder), f"{self.path}/filter/{SNAPSHOT}={numbers[-1]}"
            )
        return wider


def _six(digest: Column, k: int) -> Column:
    """The k-th group of six bits of a digest: a place in a word."""
    return F.shiftrightunsigned(digest, 6 * k).bitwiseAND(63).cast("int")
