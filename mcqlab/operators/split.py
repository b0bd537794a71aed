"""Exact-size splits by hash order.

The held-out rows are the n first by (md5 of seed and key, key). The cut is found
from counts per hash prefix (65,536 at most) and the order inside one prefix, so
no global sort or single-partition window is needed; the split itself is a filter.
Keys must be unique for exact sizes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mcqlab.config import SEED


def order_hash(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def held_out(rows: DataFrame, key: str, size: Callable[[int], int], seed: int = SEED) -> Column:
    """A predicate over ``rows`` that holds for exactly size(count) of them."""
    h = order_hash(key, seed)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(F.substring(h, 1, 4).alias("p")).agg(F.count("*").alias("n")).collect())
    want = size(sum(n for _, n in counts))
    if want <= 0:
        return F.lit(False)
    for prefix, n in counts:
        if want <= n:
            break
        want -= n
    else:
        return F.lit(True)
    cut = rows.where(F.substring(h, 1, 4) == prefix).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").offset(want - 1).first()
    return (h < cut["h"]) | ((h == cut["h"]) & (F.col(key) <= F.lit(cut["k"])))


def split(rows: DataFrame, key: str, size: Callable[[int], int], seed: int = SEED) -> DataFrame:
    """The rows with a boolean ``held_out``."""
    return rows.withColumn("held_out", held_out(rows, key, size, seed))


def group_held_out(rows: DataFrame, group: str, share: float, seed: int = SEED) -> Column:
    """A predicate over the group column: whole groups, in hash order, up to the row count nearest to the share.

    No group is on both sides, and the count differs from the share of all rows by half
    the largest group at most. Rows without a group are never held out. Only the groups
    of one hash prefix are put in order.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).withColumn("h", order_hash("g", seed))
    counts = sorted((r["p"], r["n"]) for r in sizes.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sum("n").alias("n")).collect())
    want, before = share * sum(n for _, n in counts), 0
    for prefix, n in counts:
        if before + n >= want:
            break
        before += n
    else:
        return F.lit(bool(counts)) & F.col(group).isNotNull()
    total = F.sum("n").over(Window.orderBy("h", "g")) + before
    ends = sizes.where(F.substring("h", 1, 4) == prefix).withColumn("total", total)
    best = ends.select("h", "g", "total").orderBy(F.abs(F.col("total") - want), "total").first()
    h = order_hash(group, seed)
    if abs(before - want) <= abs(best["total"] - want):
        return F.col(group).isNotNull() & (h < prefix)
    return F.col(group).isNotNull() & ((h < best["h"]) | ((h == best["h"]) & (F.col(group) <= F.lit(best["g"]))))


def group_split(rows: DataFrame, group: str, share: float, seed: int = SEED) -> DataFrame:
    """The rows with a boolean ``held_out`` that is the same for all of a group."""
    return rows.withColumn("held_out", F.coalesce(group_held_out(rows, group, share, seed), F.lit(False)))


#: Rows that a sample of the usual data frames can have; its permutation is made on the driver, 8 bytes a row.
MOST_POSITIONS = 100_000_000


def frame_sample(rows: DataFrame, size: Callable[[int], int], seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """The rows with a boolean ``held_out``: those that a data frame of the usual kind samples without replacement from this seed.

    row_id: positions from 0 without gaps, as ``sources.rows.numbered`` gives. The
    sample is the start of a Mersenne-Twister permutation of the positions, which is one
    long chain of draws; only positions are made on the driver, never rows. For new work
    ``split`` is the better one: it has no such limit.
    """
    n = rows.count()
    if n > MOST_POSITIONS:
        raise ValueError(f"over {MOST_POSITIONS} rows; use split")
    picked = np.random.RandomState(seed).permutation(n)[: max(0, min(n, size(n)))]
    table = rows.sparkSession.createDataFrame(pa.table({"_at": pa.array(np.sort(picked), pa.int64())}))
    table = F.broadcast(table) if len(picked) <= 100_000 else table
    return rows.join(table, F.col(row_id) == F.col("_at"), "left").withColumn("held_out", F.col("_at").isNotNull()).drop("_at")
