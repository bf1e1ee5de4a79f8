"""Scans of the input tables. Records that were delivered twice have the same id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id of each table whose records may be delivered more than once.
RECORD_ID = {"statements": "rec_id", "conjectures": "rec_id", "attempts": "attempt_id", "train_samples": "sample_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One row a record, with its id and the columns named; deliveries of one record are equal in them."""
    key = RECORD_ID[name]
    rows = table(spark, folder, name).where(F.col(key).isNotNull()).select(key, *[c for c in columns if c != key])
    return rows.dropDuplicates([key])


def split_name(c: Column) -> Column:
    """A split written in any case, with blanks around it."""
    return F.lower(F.trim(c))
