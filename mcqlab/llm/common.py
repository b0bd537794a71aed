"""What several operators share: text buffers, hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.operators.hot import HEAVY, dealt_join, discard, frequent, stored

__all__ = ["HEAVY", "MIX", "buffer_of", "components", "dealt_join", "discard", "frequent", "mixed", "row_sums", "slices", "stored", "table", "without"]
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(keep: tuple[str, ...] | list[str], names: tuple[str, ...] | list[str]) -> list[str]:
    """The columns to keep whose names no result has."""
    taken = {n.lower() for n in names}
    return [c for c in keep if c.lower() not in taken]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind each other, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 256_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of values per row number."""
    return np.bincount(owner, weights=values, minlength=n)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that links reach.

    Each round takes a node's smallest neighbour label and then jumps once over the
    label's own label, so the rounds grow with the logarithm of a chain's length.
    Each round is written to the shared folder. Nodes without a link are not returned.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = stored(labels)
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = step.select(F.col("node").alias("k"), F.col("component").alias("up"))
        new = stored(step.join(up, step["component"] == up["k"]).select("node", "was", F.least("component", "up").alias("component")))
        discard(labels)
        labels = new
        if new.where("was <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")
