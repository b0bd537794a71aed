"""Joins between sheets and MCQs. Null keys match null keys, as in data frames of the usual kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi_join_sheets(sheets: DataFrame, mcqs: DataFrame, key: str = "id") -> DataFrame:
    """Sheets that have an MCQ."""
    return sheets.join(mcqs.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_semi")


def left_join_context(mcqs: DataFrame, sheets: DataFrame, key: str = "id", content: str = "content_gpt", strict_lengths: bool = False) -> DataFrame:
    """MCQs with their sheet's content; a sheet id counts once (the smallest content) so MCQs are never multiplied.

    strict_lengths: raise if there are not as many MCQs as sheets (two counts).
    """
    if content in mcqs.columns:
        raise ValueError(f"both sides have a column {content}")
    if strict_lengths and mcqs.count() != sheets.count():
        raise ValueError("sheets and MCQs differ in number")
    own = sheets.groupBy(F.col(key).alias("_k")).agg(F.min(content).alias(content))
    return mcqs.join(own, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def in_folders(rows: DataFrame, folders: DataFrame, folder: str = "folder", anti: bool = False) -> DataFrame:
    """Rows of (or outside) the listed folders."""
    return rows.join(folders.select(F.col(folder)).distinct(), folder, "left_anti" if anti else "left_semi")


def null_rows(rows: DataFrame, value: str, row_id: str = "id") -> DataFrame:
    return rows.where(F.col(value).isNull()).select(row_id)


def patched(rows: DataFrame, value: str, replacement: Column) -> DataFrame:
    """Nulls of a column replaced."""
    return rows.withColumn(value, F.coalesce(F.col(value), replacement.cast(rows.schema[value].dataType)))


def flattened(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    return rows.select(key, f"{value}.*")
