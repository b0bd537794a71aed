"""A bounded labelled sample for fitting, by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mcqlab.llm.common import discard, stored

MOST_CLASSES = 10_000


def sampled(rows: DataFrame, label: str, key: str, per_class: int, most_rows: int | None = None, seed: int = 7, text: str | None = None) -> DataFrame:
    """The ``per_class`` first rows of each class by hash of the key, then of the text; rows without a label are left out.

    most_rows: with many classes, each gets an equal share of so many rows, one at
    least. Rows are thinned by the key's hash before they are ranked, so a frequent class
    is no hot task; a class of which equal or missing keys leave too few is ranked whole,
    in each task first. There are never more rows of a class than its share, and never
    none of a class that has rows. More than MOST_CLASSES classes are refused: then the
    column is no label.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    narrow = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), h.alias("h"))
    counts = narrow.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} classes in {label}")
    if not counts:
        return rows.where("false")
    if most_rows is not None:
        per_class = max(1, min(per_class, most_rows // len(counts)))
    spark, kind = rows.sparkSession, narrow.schema["label"].dataType.simpleString()

    def tops(whole: set) -> DataFrame:
        share = lambda r: 1.0 if r["label"] in whole else min(1.0, 4.0 * per_class / r["n"])
        top = [(r["label"], min(2**63 - 1, int(-(2**63) + share(r) * 2**64))) for r in counts]
        return F.broadcast(spark.createDataFrame(top, f"_label {kind}, _top long"))

    thinned = narrow.join(tops(set()), F.col("label") == F.col("_label")).where("h <= _top").groupBy("label").agg(F.count("*").alias("n"))
    enough = {r["label"] for r in thinned.collect() if r["n"] >= per_class}
    whole = {r["label"] for r in counts if r["label"] not in enough}
    thin = rows.withColumn("_h", h).join(tops(whole), F.col(label) == F.col("_label")).where("_h <= _top")
    order = Window.partitionBy(label).orderBy("_h", *([F.xxhash64(text)] if text else []))
    ranked = thin.withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= per_class).select(*rows.columns)


def collected(bags: DataFrame, most_keys: int) -> list[tuple]:
    """(label, k, n) rows of features as arrays of bytes, no more than ``most_keys`` keys (4 bytes of k) in all.

    Each class gets an equal share and fills it in hash order, with one row at least, so
    what reaches the driver is bounded however long the sampled texts are.
    """
    kept = stored(bags)
    classes = max(1, kept.select("label").distinct().count())
    order = Window.partitionBy("label").orderBy(F.xxhash64("k", "n"), "k", "n")
    size = (F.octet_length("k") / 4).cast("long")
    ranked = kept.withColumns({"_sum": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.row_number().over(order)})
    got = ranked.where((F.col("_sum") <= most_keys // classes) | (F.col("_r") == 1)).select("label", "k", "n").collect()
    discard(kept)
    return sorted((r["label"], bytes(r["k"]), bytes(r["n"])) for r in got)
