"""Positions of rows in files: numbers that don't depend on how Spark splits or schedules a scan.

The order is that of file paths, then that of rows in a file. The files are scanned
once, and the rows are stored with their places in the splits of that scan: a second
scan may split and bundle the files otherwise, as that depends on the cores then there.
The rows of each split are counted; their running sum gives each split its first number,
and a row's number is that plus its place in the split. No row is sorted or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mcqlab.operators.hot import stored
from mcqlab.sources.io import read_csv

#: Splits up to this number are broadcast, at some 100 bytes each.
BROADCAST_SPLITS = 100_000


def numbered(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """A file scan, before any filter, with each row's position from 0."""
    split = ["_file", "_block"]
    own = stored(scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")), compression="zstd")
    counts = stored(own.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    before = F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))  # one row a split
    starts = counts.select(*split, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    starts = F.broadcast(starts) if counts.count() <= BROADCAST_SPLITS else starts
    return own.join(starts, split).withColumn(name, F.col("_at") + F.col("_start")).drop(*split, "_at", "_start")


def numbered_csv(spark: SparkSession, path: str, schema: T.StructType | str, name: str = "row_id") -> DataFrame:
    return numbered(read_csv(spark, path, schema), name)


def head(rows: DataFrame, n: int, name: str = "row_id") -> DataFrame:
    """The n first rows of the files; a filter, so nothing is sorted."""
    return rows.where(F.col(name) < n)


def in_file_order(rows: DataFrame, name: str = "row_id") -> DataFrame:
    return rows.orderBy(name)


def put(rows: DataFrame, value: str, changes: dict[int, Column], name: str = "row_id") -> DataFrame:
    """The cells of a column at the given positions replaced; for a few changes, which become part of the plan."""
    new = F.col(value)
    for at, cell in changes.items():
        new = F.when(F.col(name) == at, cell.cast(rows.schema[value].dataType)).otherwise(new)
    return rows.withColumn(value, new)


def put_all(rows: DataFrame, value: str, changes: DataFrame, name: str = "row_id") -> DataFrame:
    """The same for a table (row_id, value) of any size, positions without repeats; a null value is put too."""
    new = changes.select(F.col(name).alias("_at"), F.col(value).cast(rows.schema[value].dataType).alias("_new"))
    met = rows.join(new, F.col(name) == F.col("_at"), "left")
    return met.withColumn(value, F.when(F.col("_at").isNotNull(), F.col("_new")).otherwise(F.col(value))).drop("_at", "_new")
