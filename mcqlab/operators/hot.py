"""Intermediate tables in the shared folder, and joins in which one key may hold a large part of all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mcqlab.session import shared_dir

HEAVY = 1000


def stored(df: DataFrame, *by: str, compression: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor costs nothing.

    by: columns that get folders of their own, the last ones of df. compression: null
    for the session's. The files stay until ``discard``, or until the folder of the session is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            where, files = located(df.sparkSession, path)
            files.delete(where, True)


def located(spark, path: str):
    """A path and the file system that holds it, of whatever kind."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def dealt_join(rows: DataFrame, small: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of rows with small, which has one row a key and in column ``n`` the number of rows of that key.

    Keys of more than 1 in HEAVY of all rows are fewer than HEAVY, so they are named in
    the plan and broadcast, and their rows stay where they are; a task of the join of
    the others never gets more than that share for one key. Both tables are read twice:
    store them.
    """
    named = frequent(small, keys, n, rows.count())
    there = rows.where(named).join(F.broadcast(small.where(named)), keys)
    return there.unionByName(rows.where(~named).join(small.where(~named), keys))


def frequent(small: DataFrame, keys: list[str], n: str, total: int) -> Column:
    """A predicate over keys: whether ``n`` is over 1 in HEAVY of the total; fewer than HEAVY keys are collected."""
    mark = F.xxhash64(*keys)
    found = [r[0] for r in small.where(F.col(n) * HEAVY > total).select(mark).collect()]
    return mark.isin(found) if found else F.lit(False)
