"""The most frequent values of a column that has very many, without counting them all.

Every map task keeps a summary of at most ``capacity`` values (Misra and Gries): when there
are more, all counts are lowered until few are left, and the task remembers by how
much. The summaries are added up; no value can have more rows than the sum it has there
plus all that was taken off. Values that may be among the first are counted exactly in a second
pass. If a value that no summary holds could be among them too, all values are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxtally.operators.sides import bounded_broadcast, written

CAPACITY = 200_000


class _Summary:
    """Values with counts that are too low by ``error`` at the most."""

    def __init__(self, capacity: int, kind: pa.DataType):
        self.capacity, self.error = capacity, 0
        self.held = pa.table({"value": pa.array([], kind), "n": pa.array([], pa.int64())})

    def add(self, values: pa.Array) -> None:
        counted = values.drop_null().value_counts()
        fresh = pa.table({"value": counted.field("values"), "n": counted.field("counts")})
        both = pa.concat_tables([self.held, fresh]).group_by("value").aggregate([("n", "sum")])
        self.held = pa.table({"value": both.column("value"), "n": both.column("n_sum")})
        # Twice the capacity may wait, so that lowering is paid for by many rows.
        if len(self.held) > 2 * self.capacity:
            self.lower()

    def lower(self) -> None:
        n = np.asarray(self.held.column("n"))
        if len(n) <= self.capacity:
            return
        taken = int(np.partition(n, len(n) - self.capacity - 1)[len(n) - self.capacity - 1])
        keep = n > taken
        self.error += taken
        self.held = pa.table(
            {"value": self.held.column("value").filter(pa.array(keep)), "n": pa.array(n[keep] - taken)}
        )


def _summaries(capacity: int):
    def summarise(batches):
        summary = None
        for batch in batches:
            column = batch.column(0)
            summary = summary or _Summary(capacity, column.type)
            summary.add(column)
        if summary is None:
            return
        summary.lower()
        for rows in summary.held.to_batches():
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(len(rows), pa.int64())], ["value", "n", "error"])
        kind = summary.held.schema.field("value").type
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, kind), pa.array([0], pa.int64()), pa.array([summary.error], pa.int64())], ["value", "n", "error"]
        )

    return summarise


def most_frequent(df: DataFrame, column: str, n: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows (column, n) of the ``n`` most frequent values; equal counts go by the value.

    The same rows as from counting all values, NULL left out. What is shuffled is at most
    ``capacity`` rows per map task and the counts of the candidates.
    """
    values = df.select(F.col(column).alias("value"))
    schema = StructType([StructField("value", values.schema["value"].dataType), StructField("n", LongType()), StructField("error", LongType())])
    parts = written(values.mapInArrow(_summaries(capacity), schema), "summaries")
    error = parts.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    sums = parts.filter("value is not null").groupBy("value").agg(F.sum("n").alias("n"))
    first = lambda counts: counts.orderBy(F.col("n").desc(), "value").limit(n)
    if not error:
        return first(sums).withColumnRenamed("value", column)
    # The last of the first n has at least this many rows.
    sums = written(sums, "summary")
    least = first(sums).agg(F.count("*"), F.min("n")).first()
    if least[0] == n and least[1] > error:
        candidates = sums.filter(F.col("n") + F.lit(error) >= F.lit(least[1])).select("value")
        values = values.join(bounded_broadcast(candidates), "value", "left_semi")
    counts = values.filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return first(counts).withColumnRenamed("value", column)
