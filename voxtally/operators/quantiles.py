"""Exact quantiles of all groups at once, without sorting a group.

A quantile is the value at a rank. The values are read as numbers of a few digits, and the
digits are found from the most significant one: the rows of a group are counted by
digit, the counts tell which digit the rank falls into, and the next round counts only
rows that begin with the digits found so far. Counts are combined on the map side, so
a group with most of the rows costs as much as its counts, ``2 ** DIGIT_BITS`` per
round at the most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.sides import bounded_broadcast, settled, written

DIGIT_BITS = 12


def exact_quantiles(
    df: DataFrame, by: Sequence[str], values: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Rows (by, column, share, value): the quantiles of whole-number columns in each group.

    Between two ranks the value is interpolated on a straight line. NULL values are left
    out, a group that has no value in a column has no rows for it, and NULL is a group.
    The difference between the largest and the smallest value must be below ``2 ** 62``.
    """
    group = [f"_g{i}" for i in range(len(by))]
    columns = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("value")) for c in values)))
    rows = df.select(*(F.col(c).alias(g) for c, g in zip(by, group)), columns.alias("_v"))
    rows = rows.select(*group, "_v.column", "_v.value").filter("value is not null")
    # NULL groups meet in joins under a digest that no value has.
    name = F.sha2(F.concat_ws(":", *(F.coalesce(F.sha2(F.col(g).cast("string"), 256), F.lit("-")) for g in group)), 256)
    rows = written(rows.withColumn("_key", name), "values")
    counts = rows.groupBy("_key", "column").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), *(F.first(g).alias(g) for g in group)
    )
    counts = settled(counts, "groups")
    least, most = rows.agg(F.min("value"), F.max("value")).first()
    span = 0 if least is None else most - least
    if span >= 1 << 62:
        raise ValueError("values are too far apart")
    rounds = max(1, -(-span.bit_length() // DIGIT_BITS))

    # Two ranks for each share: the one below and the one above.
    wanted = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(u).alias("up")) for s in shares for u in (False, True))))
    at = F.col("w.share") * (F.col("n") - 1)
    rank = F.when(F.col("w.up"), F.ceil(at)).otherwise(F.floor(at)).cast("long")
    # Ranks that fall together are looked for once.
    ranks = counts.select("_key", "column", "n", wanted.alias("w")).select("_key", "column", rank.alias("rank")).distinct()
    open_ranks = settled(ranks.withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rank")}), "ranks")
    shifted = F.col("value") - F.lit(least or 0)
    for r in range(rounds):
        low = DIGIT_BITS * (rounds - 1 - r)
        digits = rows.select("_key", "column", F.shiftright(shifted, low + DIGIT_BITS).alias("prefix"), F.shiftright(shifted, low).alias("next"))
        if r:
            searched = open_ranks.select("_key", "column", "prefix").distinct()
            digits = digits.join(bounded_broadcast(searched), ["_key", "column", "prefix"], "left_semi")
        by_digit = digits.groupBy("_key", "column", "prefix", "next").agg(F.count("*").alias("n"))
        order = Window.partitionBy("_key", "column", "prefix").orderBy("next")
        by_digit = by_digit.withColumn("before", F.sum("n").over(order) - F.col("n"))
        hit = open_ranks.join(by_digit, ["_key", "column", "prefix"])
        hit = hit.filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        hit = hit.select("_key", "column", "rank", F.col("next").alias("prefix"), (F.col("left") - F.col("before")).alias("left"))
        open_ranks = settled(hit, "ranks")
    found = open_ranks.select("_key", "column", "rank", (F.col("prefix") + F.lit(least or 0)).alias("value"))

    each = counts.select("_key", "column", "n", *group, F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    place = F.col("share") * (F.col("n") - 1)
    each = each.withColumns({"_low": F.floor(place).cast("long"), "_high": F.ceil(place).cast("long"), "_part": place - F.floor(place)})
    low = found.select("_key", "column", F.col("rank").alias("_low"), F.col("value").cast("double").alias("_a"))
    high = found.select("_key", "column", F.col("rank").alias("_high"), F.col("value").cast("double").alias("_b"))
    both = each.join(low, ["_key", "column", "_low"]).join(high, ["_key", "column", "_high"])
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    return both.select(*(F.col(g).alias(c) for c, g in zip(by, group)), "column", "share", value.alias("value"))
