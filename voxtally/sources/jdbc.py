"""Tables of a relational database, read and written in parallel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
URL_FORMATS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
}
# ------------------------------------------------------------------------------

ROWS_PER_FETCH = 10_000
ROWS_PER_INSERT = 5_000


def jdbc_url(db_type: str, host: str, port: int, database: str) -> str:
    if db_type not in URL_FORMATS:
        raise ValueError(f"unsupported database: {db_type}")
    return URL_FORMATS[db_type].format(host=host, port=port, database=database)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    num_partitions: int = 32,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table, or a query in parentheses with an alias.

    With a numeric or time ``partition_column`` the database is asked for its
    range first (one pushed-down aggregate) and then read in that many slices.
    Filters and columns chosen later are pushed into the slices.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(ROWS_PER_FETCH), **(properties or {})}
    reader = spark.read.format("jdbc").options(**options)
    if partition_column is None:
        return reader.load()
    low, high = reader.load().agg(F.min(partition_column), F.max(partition_column)).first()
    if low is None:
        return reader.load()
    return reader.options(
        partitionColumn=partition_column,
        lowerBound=str(low),
        upperBound=str(high),
        numPartitions=str(num_partitions),
    ).load()


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "append",
    max_connections: int = 16,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Insert all rows in batches, over at most ``max_connections`` connections."""
    options = {
        "url": url,
        "dbtable": table,
        "batchsize": str(ROWS_PER_INSERT),
        "numPartitions": str(max_connections),
        **(properties or {}),
    }
    df.write.format("jdbc").options(**options).mode(mode).save()
