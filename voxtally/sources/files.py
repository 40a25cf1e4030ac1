"""Parquet tables, CSV files for annotators, and label maps."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.functions.labels import parse_id2label

# Annotation tools want files they can open; a partition gives several of these.
MAX_RECORDS_PER_FILE = 1_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_labeled_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV file or folder with a header, quotes doubled inside quoted cells.

    Without a schema every column is a string, so nothing is read twice to guess
    types. A file whose cells hold line breaks cannot be split: large data
    should come as a folder of files, or with ``multi_line`` off.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    reader = reader.option("escape", '"').option("encoding", "UTF-8")
    return (reader if schema is None else reader.schema(schema)).csv(path)


def read_annotations(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """As :func:`read_labeled_csv`, with ``position``: file name and place in the file.

    Files are not split here, so places follow the lines, and ``lookup_label`` can let the
    last entry of a key win. Entries of the file whose name is last count as later.
    """
    rows = read_labeled_csv(spark, path, schema, multi_line=True)
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("position", place)


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    max_records_per_file: int = MAX_RECORDS_PER_FILE,
) -> None:
    """A folder of CSV files, each with the header.

    Blanks, tabs and line ends around a value are written as they are. An empty text
    and NULL are the same empty cell, and are read back as NULL.
    """
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("maxRecordsPerFile", max_records_per_file).csv(path)


def stamped_path(folder: str, name: str, at: datetime) -> str:
    """Where an export of that time goes, such as ``folder/review_queue_20240131_235959``."""
    return f"{folder.rstrip('/')}/{name}_{at:%Y%m%d_%H%M%S}"


def read_comment_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed response pages, one JSON document per line, as text in ``body``."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def read_label_map(spark: SparkSession, path: str) -> Mapping[int, str] | None:
    """The ``id2label`` map of a model's metadata document, None if it has none."""
    document = spark.read.text(path, wholetext=True)
    row = document.select(parse_id2label("value").alias("id2label")).first()
    return row["id2label"] if row else None
