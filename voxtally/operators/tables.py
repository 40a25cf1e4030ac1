"""Changes to tables as pure functions ``(old, delta) -> new``.

Files are not updated in place: the caller writes the result to a new version of
the table and never over the path that is being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.operators.comments import fetched_for_export
from voxtally.operators.groups import assign_ids, latest_per_key
from voxtally.operators.requests import transition
from voxtally.operators.results import add_blank_label
from voxtally.operators.sides import bounded_broadcast, fetched_rows, settled
from voxtally.schemas import TABLES, Table


def upsert(
    old: DataFrame,
    delta: DataFrame,
    key: Sequence[str],
    update_cols: Sequence[str],
    latest_by: Sequence[str],
) -> DataFrame:
    """Insert new keys; for known keys overwrite only ``update_cols``.

    Of several rows for one key in the delta the last by ``latest_by`` counts.
    Both sides then have unique keys, so the join has no skew to suffer from. A delta
    that is counted small goes to the stored rows, which stay where they are; a large one
    meets them in a shuffle.
    """
    fresh = latest_per_key(delta, key, latest_by).withColumn("_new", F.lit(True))
    small = fetched_rows(fresh)
    if small is not None:
        small = F.broadcast(old.sparkSession.createDataFrame(small, fresh.schema))
        return _upsert_in_place(old, small, key, update_cols)
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(
        fresh.alias("n"), list(key), "full_outer"
    )
    known, matched = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    out = []
    for c in old.columns:
        if c in key:
            out.append(F.col(c))
        elif c not in fresh.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in update_cols:
            out.append(F.when(matched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*out)


def _upsert_in_place(
    old: DataFrame, fresh: DataFrame, key: Sequence[str], update_cols: Sequence[str]
) -> DataFrame:
    """Stored rows with what is new for them, and the new rows with a key that is not stored."""
    joined = old.alias("o").join(fresh.alias("n"), list(key), "left")
    out = []
    for c in old.columns:
        if c in update_cols and c in fresh.columns and c not in key:
            stored = F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
            out.append(stored.alias(c))
        else:
            out.append(F.col(c) if c in key else F.col(f"o.{c}").alias(c))
    # Of the stored keys only those of the delta are left, so no more than it has rows.
    known = old.select(*key).join(fresh.select(*key), list(key), "left_semi")
    added = fresh.join(F.broadcast(known), list(key), "left_anti").drop("_new")
    absent = [c for c in old.columns if c not in added.columns]
    added = added.withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in absent})
    return joined.select(*out).unionByName(added.select(*old.columns))


def as_rows_of(
    table: Table,
    df: DataFrame,
    key: Sequence[str],
    after: int | Column = 0,
    at: Column | None = None,
) -> DataFrame:
    """Rows that can be appended to a table: all its columns, in its order and types.

    A missing primary key is given out after ``after``, the largest in use, in a seeded
    order of the unique ``key``. A missing time is ``at`` (now, if that is not given) and
    every other missing column NULL. Columns that the table does not have are left out.
    """
    if table.primary_key not in df.columns:
        parts = [c for k in key for c in (F.lit(" "), F.col(k).cast("string"))][1:]
        df = assign_ids(df.withColumn("_key", F.concat(*parts)), "_key", table.primary_key, start=after)
    at = F.current_timestamp() if at is None else at
    out = []
    for field in table.schema.fields:
        given = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name not in df.columns and field.dataType.typeName() == "timestamp_ntz":
            given = at
        out.append(given.cast(field.dataType).alias(field.name))
    return df.select(*out)


def replace_group(old: DataFrame, delta: DataFrame, requests: DataFrame) -> DataFrame:
    """Swap the comments of re-fetched videos for the new ones.

    A stored comment goes if the delta brings its video for the same address,
    whichever request it was stored under. So what is replaced are (video, request)
    pairs: those of the delta, spread to all requests of the same address. They are
    settled once, from the few columns that tell them, and the stored rows are then
    read a single time.
    """
    touched = settled(delta.select("video_id", "req_id").distinct(), "touched")
    urls = settled(requests.select("req_id", "video_url"), "addresses")
    scope = touched.join(urls, "req_id").select("video_id", "video_url").distinct()
    pairs = scope.join(urls, "video_url").select("video_id", "req_id").distinct()
    kept = old.join(bounded_broadcast(pairs), ["video_id", "req_id"], "left_anti").select(*old.columns)
    return kept.unionByName(delta.select(*kept.columns))


def cascade_delete(
    children: DataFrame, deleted: DataFrame, column: str, parent_column: str, mode: str = "cascade"
) -> DataFrame:
    """Child rows after their parents are gone: removed, or with the key set to NULL."""
    gone = bounded_broadcast(deleted.select(F.col(parent_column).alias(column)).distinct())
    if mode == "cascade":
        return children.join(gone, column, "left_anti").select(*children.columns)
    if mode != "set_null":
        raise ValueError(f"unknown mode: {mode}")
    joined = children.join(gone.withColumn("_gone", F.lit(True)), column, "left")
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return joined.withColumn(column, kept).select(*children.columns)


def cascade(tables: Mapping[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The given tables after rows of table ``name`` are deleted, along all foreign keys.

    ``gone`` holds the primary keys of the deleted rows. Children go with their parents
    or lose the reference, as the schema says, and children of children likewise.
    """
    out = dict(tables)
    own = TABLES[name].primary_key
    out[name] = cascade_delete(tables[name], gone, own, own)
    todo = [(name, gone.select(own))]
    while todo:
        parent, keys = todo.pop()
        for table in TABLES.values():
            for fk in table.foreign_keys:
                if fk.parent != parent or table.name not in tables:
                    continue
                out[table.name] = cascade_delete(
                    out[table.name], keys, fk.column, fk.parent_column, fk.on_delete
                )
                referred = any(f.parent == table.name for t in TABLES.values() for f in t.foreign_keys)
                if fk.on_delete == "cascade" and referred:
                    lost = keys.select(F.col(fk.parent_column).alias(fk.column)).distinct()
                    rows = tables[table.name].select(table.primary_key, fk.column)
                    rows = rows.join(bounded_broadcast(lost), fk.column, "left_semi")
                    todo.append((table.name, rows.select(table.primary_key)))
    return out


def export_and_mark(
    raw: DataFrame, requests: DataFrame, to: str = "FAILED"
) -> tuple[DataFrame, DataFrame]:
    """The annotation file of the fetched requests, and the requests table after it.

    Requests that gave rows move on to ``to`` so that no later run exports them
    again.
    """
    rows = fetched_for_export(raw, requests)
    moved = transition(requests, raw.select("req_id"), to, only_from=["FETCHED"])
    file = rows.select(F.col("text_display").alias("text"))
    return add_blank_label(file, "label"), moved
