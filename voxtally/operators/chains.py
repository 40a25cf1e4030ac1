"""The order of response pages that only name their successor.

A page is fetched with a token and names the token of the next page; the first page has
none, and no page has a number. Every page points to the one before it. In each round
a page takes over the pointer of the page it points to, so that pointers reach twice
as far, and a chain of n pages is numbered in about log2 n rounds. A round joins the
keys of the pages that have not arrived yet with the keys of all pages; bodies take part
in a single join at the end. Rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators.sides import bounded_broadcast, written

LINKED, BROKEN, LOOP = "LINKED", "BROKEN", "LOOP"


def page_numbers(
    pages: DataFrame, video: str = "video_id", token: str = "page_token", next_token: str = "next_token"
) -> DataFrame:
    """Rows (video, token, page, page_state), one per distinct page.

    ``page`` counts from 0. ``page_state`` is LINKED if the chain leads back to the first page
    (whose token is NULL or empty), BROKEN if a page in between is missing (``page`` then counts
    from the gap), and LOOP if pages follow each other in a circle (``page`` is NULL). A page
    that landed several times is one page; if it names different successors, or several
    pages name it, the smallest token counts.
    """
    absent = lambda c: F.when(F.col(c) != "", F.col(c))
    nodes = pages.select(
        F.col(video).alias("_v"), F.coalesce(F.col(token), F.lit("")).alias("_t"), absent(next_token).alias("_n")
    )
    nodes = written(nodes.filter("_v is not null").groupBy("_v", "_t").agg(F.min("_n").alias("_n")), "pages")
    before = nodes.filter("_n is not null").groupBy("_v", F.col("_n").alias("_t")).agg(F.min("_t").alias("_p"))
    # The first page is where chains begin, whoever names it.
    found = nodes.join(before.filter("_t <> ''"), ["_v", "_t"], "left")
    start = F.col("_p").isNull()
    at = found.select(
        "_v",
        "_t",
        F.coalesce("_p", "_t").alias("_p"),
        F.when(start, 0).otherwise(1).cast("long").alias("_d"),
        start.alias("_done"),
    )
    at = written(at, "page-pointers")
    left = at.filter("not _done").count()
    while left:
        ahead = at.select("_v", F.col("_t").alias("_p"), F.col("_p").alias("_q"), F.col("_d").alias("_e"), F.col("_done").alias("_there"))
        moved = at.filter("not _done").join(ahead, ["_v", "_p"], "left")
        # A page that points to the start of a chain has its number.
        moved = moved.select("_v", "_t", F.col("_q").alias("_p"), (F.col("_d") + F.col("_e")).alias("_d"), F.col("_there").alias("_done"))
        at = written(at.filter("_done").union(moved), "page-pointers")
        still = at.filter("not _done").count()
        # In every round the pages in the middle of a chain arrive; if none does, the rest are circles.
        if still == left:
            break
        left = still
    state = F.when(~F.col("_done"), LOOP).when(F.col("_p") == "", LINKED).otherwise(BROKEN)
    return at.select(
        F.col("_v").alias(video),
        F.when(F.col("_t") != "", F.col("_t")).alias(token),
        F.when(F.col("_done"), F.col("_d")).cast("int").alias("page"),
        state.alias("page_state"),
    )


def linked_pages(
    pages: DataFrame, video: str = "video_id", token: str = "page_token", next_token: str = "next_token"
) -> DataFrame:
    """The pages with their number ``page`` and ``page_state``; see :func:`page_numbers`.

    Rows stay as they are, repeated ones too, and are not shuffled if the numbers are
    few. Rows without a video get neither.
    """
    numbers = page_numbers(pages, video, token, next_token)
    numbers = numbers.select(F.col(video).alias("_v"), F.coalesce(token, F.lit("")).alias("_t"), "page", "page_state")
    keyed = pages.withColumns({"_v": F.col(video), "_t": F.coalesce(F.col(token), F.lit(""))})
    return keyed.join(bounded_broadcast(numbers), ["_v", "_t"], "left").drop("_v", "_t")
