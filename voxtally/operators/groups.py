"""Per-group ranks, cuts and limits that hold up when one group is huge.

A window over a group sorts that group in a single task. The operators here give
the same rows without that: they aggregate first (combining on the map side), or
cut the group into ranges of a digest and only rank inside the range that needs
it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.keys import content_key, seeded_order
from voxtally.operators.sides import bounded_broadcast, fetched_rows, settled, written

# Hexadecimal digits of a digest that form a range: 65,536 ranges per group.
RANGE_DIGITS = 4


def top_n_per_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Column | None = None,
    spread_over: int = 32,
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark keeps at most ``n`` rows per group and map task before it shuffles
    them. With many tasks and a large ``n`` that is still a lot for one group;
    ``spread`` (a column that varies inside the groups) then adds a round in
    which every group is cut into ``spread_over`` parts.
    """
    if spread is not None:
        df = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(spread_over)))
        w = Window.partitionBy(*by, "_part").orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
        df = df.drop("_part", "_rank")
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return ranked.drop("_rank")


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one that is last by ``order``.

    An aggregation and not a window: rows of one key are already reduced to one
    per map task before the shuffle. Of rows that agree on ``order``, the one with the
    larger digest of its values stays, so every run keeps the same one.
    """
    rest = [c for c in df.columns if c not in key]
    tie = [content_key(c, schema=df.schema) for c in rest if c not in order]
    kept = F.max_by(F.struct(*rest), F.struct(*order, *tie)).alias("_row")
    return df.groupBy(*key).agg(kept).select(*key, "_row.*").select(*df.columns)


def first_of_group(df: DataFrame, subset: Sequence[str], key: str) -> DataFrame:
    """Smallest ``key`` among the rows that agree on ``subset``, one row per group."""
    return df.groupBy(content_key(*subset, schema=df.schema).alias("_content")).agg(F.min(key).alias(key)).select(key)


def _repeated(df: DataFrame, subset: Sequence[str], key: str) -> DataFrame | None:
    """Groups of more than one row with their smallest key, to broadcast; None if they are many."""
    content = content_key(*subset, schema=df.schema).alias("_content")
    groups = df.groupBy(content).agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
    found = fetched_rows(groups.filter("_n > 1").select("_content", "_first"))
    if found is None:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(found))


def flag_repeats(
    df: DataFrame, subset: Sequence[str], key: str, name: str = "is_duplicate"
) -> DataFrame:
    """Mark the rows that repeat an earlier one, in the order of a unique key.

    Groups of more than one row are found by aggregation. If they are few they go to the
    rows, which stay where they are. Else the first rows are joined on the unique
    key; either way, a text that a third of the rows share is never gathered anywhere.
    """
    repeated = _repeated(df, subset, key)
    if repeated is not None:
        keyed = df.withColumn("_content", content_key(*subset, schema=df.schema))
        joined = keyed.join(repeated, "_content", "left")
        later = F.coalesce(F.col(key) != F.col("_first"), F.lit(False))
        return joined.select(*df.columns, later.alias(name))
    first = first_of_group(df, subset, key).withColumn("_first", F.lit(True))
    return df.join(first, key, "left").withColumn(name, F.col("_first").isNull()).drop("_first")


def drop_repeats(df: DataFrame, subset: Sequence[str], key: str) -> DataFrame:
    """Only the first row of each group of repeats."""
    return flag_repeats(df, subset, key, "_repeats").filter(~F.col("_repeats")).drop("_repeats")


def _order_key(key: str, seed: int) -> Column:
    # The key itself ends the string so that the order is total.
    return F.concat(seeded_order(seed, key), F.lit(":"), F.col(key).cast("string"))


def _cuts(
    df: DataFrame, by: Sequence[str], key: str, seed: int, take: Callable[[Column], Column]
) -> DataFrame:
    """Per group, the order key of the last row among the first ``take(count)``."""
    keyed = df.select(*by, _order_key(key, seed).alias("_o"))
    keyed = keyed.withColumn("_range", F.substring("_o", 1, RANGE_DIGITS))
    # At most 16 ** RANGE_DIGITS rows per group from here on.
    counts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_range"))).withColumn(
        "_take", take(F.sum("_n").over(group)).cast("long")
    )
    hit = counts.filter(
        (F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take"))
    ).select(*by, "_range", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_nth"))
    inside = keyed.join(settled(hit, "cut-ranges"), [*by, "_range"])
    ranked = inside.withColumn("_rank", F.row_number().over(group.orderBy("_o")))
    return ranked.filter(F.col("_rank") == F.col("_nth")).select(*by, F.col("_o").alias("_cut"))


def split_by_share(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    share: float,
    seed: int = 42,
    name: str = "is_test",
) -> DataFrame:
    """Mark exactly ``round(share * n)`` rows of every group, in a seeded order.

    Rows are compared with their group's cut point. They are never shuffled or
    ranked as a whole: the cut comes from counts per digest range and from the
    rows of the one range it falls into. Rows without a group are not marked.
    """
    cuts = _cuts(df, by, key, seed, lambda n: F.round(n * F.lit(share)))
    marked = df.join(bounded_broadcast(cuts), list(by), "left")
    inside = F.coalesce(_order_key(key, seed) <= F.col("_cut"), F.lit(False))
    return marked.select(*df.columns, inside.alias(name))


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all of them if there are fewer), chosen by a seeded order.

    A filter against one cut point: a sample of any size stays distributed.
    """
    cuts = _cuts(df, [], key, seed, lambda total: F.least(total, F.lit(n))).take(1)
    if not cuts:
        return df.limit(0)
    return df.filter(_order_key(key, seed) <= F.lit(cuts[0]["_cut"]))


def assign_ids(
    df: DataFrame,
    key: str,
    name: str = "id",
    start: int | Column = 0,
    seed: int = 0,
) -> DataFrame:
    """Dense ids after ``start``, given out in a seeded order of a unique key.

    Rows are numbered inside digest ranges, which are equally large whatever the
    keys look like, and each range is moved up by the rows of those before it.
    The same input always gets the same ids, also when tasks are run again.
    """
    ordered = df.withColumn("_o", _order_key(key, seed))
    ordered = ordered.withColumn("_range", F.substring("_o", 1, RANGE_DIGITS))
    counts = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    # 16 ** RANGE_DIGITS rows at the most, so one task is enough for the sums.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy("_o"))
    numbered = ordered.withColumn("_local", local).join(offsets, "_range")
    start = start if isinstance(start, Column) else F.lit(start)
    ids = (start + F.col("_offset") + F.col("_local")).cast("long")
    return numbered.withColumn(name, ids).drop("_o", "_range", "_local", "_offset")


def assign_ids_in_order(
    df: DataFrame, order: Sequence[str], key: str, name: str = "id", start: int | Column = 0
) -> DataFrame:
    """Dense ids after ``start`` that follow ``order``, as a sequence would; ties go by the unique key.

    The rows are dealt into ranges of the order, whose limits come from a sample, sorted
    inside each and written once with their place. A range is then moved up by the
    counts of the ranges before it, which are as many rows as there were tasks. NULLs are
    first in the order.
    """
    by = [*order, key]
    # The place: number of the range in the upper half, position in the range in the lower one.
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_place", 33)
    counts = placed.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_range", part).join(bounded_broadcast(offsets), "_range")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    start = start if isinstance(start, Column) else F.lit(start)
    ids = (start + F.col("_offset") + inside + 1).cast("long")
    return numbered.select(*df.columns, ids.alias(name))


def next_id_start(df: DataFrame, id_column: str) -> int:
    """Largest id in use, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).first()[0]
