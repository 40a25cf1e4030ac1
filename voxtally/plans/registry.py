"""Where the queries are registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from voxtally.plans.bindings import Tables, with_tables


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, needs: Sequence[str] = ()):
    """Register a function of :class:`Tables`, with SQL that gives the same rows.

    ``needs`` lists the bound tables the SQL reads besides the given ones.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        full = None if sql is None else with_tables(sql, needs)
        REGISTRY[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), full)
        return fn

    return register
