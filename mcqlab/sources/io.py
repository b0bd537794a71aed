"""Readers and writers. Schemas are stated, never inferred."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mcqlab.functions.text import extract_rubric, sheet_id

SHEETS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "folder", "content_gpt")])
MCQS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "question", "option_a", "option_b", "option_c", "option_d", "correct_option")])
SCORED = T.StructType([*MCQS.fields, T.StructField("distractor_quality", T.IntegerType())])
PAIRS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "chosen", "rejected", "chosen_source", "rejected_source")])
KTO = T.StructType([T.StructField("id", T.StringType()), T.StructField("completion", T.StringType()), T.StructField("label", T.BooleanType()), T.StructField("source", T.StringType())])

#: Quotes are doubled, values keep their spaces and line breaks; an empty value is read as null.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Begins an escaped value.
MARK = "~"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_sheets(spark: SparkSession, root: str, marker: str = "Rubrique") -> DataFrame:
    """One row per file of root/<folder>/<file>: folder, id, content, rubric."""
    path = F.split(F.col("_metadata.file_path"), "/")
    raw = spark.read.text(f"{root}/*/*", wholetext=True).select("value", F.url_decode(F.element_at(path, -2)).alias("folder"), F.url_decode(F.element_at(path, -1)).alias("name"))
    return raw.select("folder", sheet_id(F.col("name")).alias("id"), F.rtrim(F.col("value"), F.lit("\n")).alias("content"), extract_rubric(F.col("value"), marker).alias("rubric"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of part files."""
    rows.write.mode("overwrite").options(**CSV, lineSep="\n").csv(path)


def escaped(rows: DataFrame, *columns: str) -> DataFrame:
    """For ``write_csv``: values that CSV would change, which are empty ones and those with a NUL, are written behind a mark, as are those that begin with it."""
    mark, nul = F.lit(MARK), F.lit("\0")

    def one(v: Column) -> Column:
        odd = (v == "") | v.startswith(mark) | v.contains(nul)
        return F.when(odd, F.concat(mark, F.replace(F.replace(v, mark, F.lit(MARK + "1")), nul, F.lit(MARK + "0")))).otherwise(v)

    return rows.withColumns({c: one(F.col(c)) for c in columns})


def unescaped(rows: DataFrame, *columns: str) -> DataFrame:
    """The values that ``escaped`` was given, of the rows read again."""
    mark, nul = F.lit(MARK), F.lit("\0")

    def one(v: Column) -> Column:
        return F.when(v.startswith(mark), F.replace(F.replace(F.substr(v, F.lit(2)), F.lit(MARK + "0"), nul), F.lit(MARK + "1"), mark)).otherwise(v)

    return rows.withColumns({c: one(F.col(c)) for c in columns})


def write_single_csv(rows: DataFrame, path: str) -> None:
    """One part file; for small results only, since one task writes it."""
    write_csv(rows.coalesce(1), path)


def folder_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of folder names as rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("folder"))


def prompts_from(path: str) -> dict[str, str]:
    """A JSON object of prompts, on the driver."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def settings_from_env() -> dict[str, str | None]:
    """Paths of a run; a key for a service is read by the client that needs it, never put into a plan."""
    return {k: os.environ.get(k) for k in ("MCQLAB_SHEETS", "MCQLAB_MCQS", "MCQLAB_OUTPUT")}
