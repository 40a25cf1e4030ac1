"""Creating the tables of the comment store and its views, counting and checking them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.results import pending_reviews, training_export
from voxtally.schemas import TABLES, Table

BUCKETS = 4096


def create_table_statement(table: Table, database: str, buckets: int = BUCKETS) -> str:
    """Tables that meet on the comment id share its buckets, so that joining them shuffles nothing."""
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL")
        for f in table.schema.fields
    )
    parts = f" PARTITIONED BY ({', '.join(table.partition_by)})" if table.partition_by else ""
    if table.bucket_by:
        parts += f" CLUSTERED BY ({table.bucket_by}) INTO {buckets} BUCKETS"
    return f"CREATE TABLE IF NOT EXISTS {database}.{table.name} ({columns}) USING parquet{parts}"


def create_tables(
    spark: SparkSession, database: str, force: bool = False, dry_run: bool = False, buckets: int = BUCKETS
) -> list[str]:
    """Create the database and the tables that are missing; ``force`` drops them first.

    ``buckets`` follows the data: a bucket of the widest table should fit a task.
    Returns the statements. With ``dry_run`` they are only returned.
    """
    statements = [f"CREATE DATABASE IF NOT EXISTS {database}"]
    if force:
        statements += [f"DROP TABLE IF EXISTS {database}.{t}" for t in reversed(TABLES)]
    statements += [create_table_statement(t, database, buckets) for t in TABLES.values()]
    if not dry_run:
        for statement in statements:
            spark.sql(statement)
    return statements


def register_views(spark: SparkSession, database: str) -> None:
    """Open reviews and labelled training rows as views of the session."""

    def table(name: str) -> DataFrame:
        return spark.table(f"{database}.{name}")

    reviews = pending_reviews(table("review_queue"), table("raw_comments"), table("requests"))
    reviews.createOrReplaceTempView("v_pending_reviews")
    training_export(table("training_dataset")).createOrReplaceTempView("v_training_data_export")


def missing_tables(spark: SparkSession, database: str) -> list[str]:
    """Tables of the comment store that the database does not have."""
    existing = {t.name for t in spark.catalog.listTables(database)}
    return [name for name in TABLES if name not in existing]


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every table and of the open part of the review queue."""
    counts = [
        df.agg(F.count("*").alias("value")).select(F.lit(f"total_{name}").alias("metric"), "value")
        for name, df in tables.items()
    ]
    if "review_queue" in tables:
        pending = tables["review_queue"].agg(F.count_if(F.col("status") == "PENDING").alias("value"))
        counts.append(pending.select(F.lit("pending_review").alias("metric"), "value"))
    return reduce(DataFrame.unionByName, counts)


def _row_rules(df: DataFrame, table: Table) -> DataFrame:
    """All rules that one pass over the table can check."""
    key = table.primary_key
    checks = {f"unique:{key}": F.count(key) - F.countDistinct(key)}
    for c in table.not_null:
        checks[f"not_null:{c}"] = F.count_if(F.col(c).isNull())
    for c, values in table.domains.items():
        checks[f"domain:{c}"] = F.count_if(~F.col(c).isin(*values))
    for c, n in table.max_lengths.items():
        checks[f"length:{c}"] = F.count_if(F.length(c) > n)
    checks = {rule: check for rule, check in checks.items() if rule.split(":")[1] in df.columns}
    counted = df.agg(*[check.alias(rule) for rule, check in checks.items()])
    long = counted.unpivot([], [F.col(f"`{rule}`") for rule in checks], "rule", "violations")
    return long.select(F.lit(table.name).alias("table_name"), "rule", "violations")


def audit_constraints(
    tables: Mapping[str, DataFrame], specs: Mapping[str, Table] = TABLES
) -> DataFrame:
    """Violations per table and rule: keys, missing values, domains, lengths, orphans.

    Orphans are looked for among the counted foreign keys, so a parent with a
    third of all children takes part in the join as one row.
    """
    results = []
    for name, df in tables.items():
        table = specs[name]
        results.append(_row_rules(df, table))
        for fk in table.foreign_keys:
            if fk.parent not in tables or fk.column not in df.columns:
                continue
            used = df.filter(F.col(fk.column).isNotNull()).groupBy(fk.column)
            parents = tables[fk.parent].select(F.col(fk.parent_column).alias(fk.column))
            orphans = used.agg(F.count("*").alias("n")).join(parents, fk.column, "left_anti")
            total = orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
            rule = f"foreign_key:{fk.column}->{fk.parent}"
            results.append(
                total.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "violations")
            )
    return reduce(DataFrame.unionByName, results)
