"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine c differ by a squared distance of 2 - 2c. Vectors are rotated
and split into low-dimensional blocks; of the allowed squared distance each block gets
its share by dimensions, so a linked pair keeps to the share of one block at least.
Each block is range-joined on its own, along its first coordinate and then in all of
its coordinates. A pair is taken in the first block whose share it keeps, so the union
over blocks needs no list of pairs: tasks verify it with the cosine of the original
vectors in double precision, and return link counts and a spanning forest.

A label is one group, in which all blocks are joined, so a vector travels once. Equal
vectors are one class throughout. Labels of more than MOST classes are dealt out as
(part, part) products, so no task gets more than two parts; a vector then travels once
for each part of its label.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different lengths
never link; a row without an id gets no component; rows are told apart by label and
vector, so each row of a repeated id has the links of its own vector; other columns are
left out. Classes are named by two hashes of 64 bits of label and vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mcqlab.llm.common import components, dealt_join, discard, frequent, stored

LEAST, BLOCKS, MOST = 0.98, 4, 131_072
TILE = 1024, 8192  # vectors compared at once
SLACK = 1e-5  # for single-precision rotated coordinates


def usable(vector: Column) -> Column:
    """Finite components, none null, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimensions: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dimensions).normal(size=(dimensions, dimensions)))[0]


def bounds(dimensions: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dimensions, min(blocks, dimensions) + 1).astype(int)


def turned(x: np.ndarray) -> np.ndarray:
    """Rotated vectors of length 1, in single precision."""
    turn, z = rotation(x.shape[1]), np.empty(x.shape, np.float32)
    for k in range(0, len(x), 16_384):
        part = x[k : k + 16_384].astype(np.float64)
        part = (part / np.abs(part).max(1, keepdims=True)) @ turn
        z[k : k + 16_384] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return z


def near_pairs(block: np.ndarray, home: np.ndarray, visitors: np.ndarray, allowed: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a block within a squared distance, and a few beyond it; same: home and visitors are one list, of which each pair is taken once."""
    home, visitors = (x[np.argsort(block[x, 0], kind="stable")] for x in (home, visitors))
    first = block[visitors, 0]
    reach = np.float32(np.sqrt(allowed) + SLACK)
    half = -0.5 * np.einsum("ij,ij->i", block, block)[:, None]
    ones = np.ones_like(half)
    # the product of such rows is minus half their squared distance
    left, right = np.hstack([block, half, ones])[home], np.hstack([block, ones, half])[visitors]
    for k in range(0, len(home), TILE[0]):
        own = left[k : k + TILE[0]]
        low = k if same else int(np.searchsorted(first, own[0, 0] - reach))
        high = int(np.searchsorted(first, own[-1, 0] + reach, side="right"))
        for v in range(low, high, TILE[1]):
            others = right[v : min(v + TILE[1], high)]
            i, j = np.divmod(np.flatnonzero(own @ others.T >= np.float32(-0.5 * (allowed + SLACK))), len(others))
            if same:
                later = j + v > i + k
                i, j = i[later], j[later]
            if len(i):
                yield home[i + k], visitors[j + v]


def _linked(key: tuple, rows: pa.Table, least: float, blocks: int) -> pa.Table:
    """Links of one label (or one product of its parts): (rep, n, to), n the links of rep, to its root in the group."""
    d, same = key[1].as_py(), key[2].as_py() == key[3].as_py()
    cut = bounds(d, blocks)
    allowed = (2 - 2 * least) * np.diff(cut) / d + SLACK
    rep, mult = rows["rep"].combine_chunks(), rows["mult"].to_numpy()
    x = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
    z = turned(x)
    every = np.arange(len(x))
    mine = rows["mine"].to_numpy() == key[2].as_py()
    home, visitors = (every, every) if same else (every[mine], every[~mine])
    n, root = np.zeros(len(x), np.int64), every.copy()
    for b in range(len(cut) - 1):
        for i, j in near_pairs(z[:, cut[b] : cut[b + 1]], home, visitors, allowed[b], same):
            for s in range(0, len(i), 100_000):
                p, q = i[s : s + 100_000], j[s : s + 100_000]
                apart = z[p].astype(np.float64) - z[q]
                shares = np.stack([(apart[:, lo:hi] ** 2).sum(1) for lo, hi in zip(cut[:-1], cut[1:], strict=True)], 1) <= allowed
                first = shares[:, b] & ~shares[:, :b].any(1)
                p, q = p[first], q[first]
                if not len(p):
                    continue
                xp, xq = x[p].astype(np.float64), x[q].astype(np.float64)
                sure = (xp * xq).sum(1) / (np.sqrt((xp * xp).sum(1)) * np.sqrt((xq * xq).sum(1))) >= least
                p, q = p[sure], q[sure]
                n += np.bincount(p, weights=mult[q], minlength=len(n)).astype(np.int64) + np.bincount(q, weights=mult[p], minlength=len(n)).astype(np.int64)
                while len(p):
                    a, c = root[p], root[q]
                    differ = a != c
                    if not differ.any():
                        break
                    low, high = np.minimum(a, c)[differ], np.maximum(a, c)[differ]
                    np.minimum.at(root, high, low)
                    while (root[root] != root).any():
                        root = root[root]
    some = np.flatnonzero(n > 0)
    return pa.table({"rep": rep.take(pa.array(some)), "n": n[some], "to": rep.take(pa.array(root[some]))})


def linked(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", least: float = LEAST, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """rows -> vec_id, n_links, component_id, kept."""
    single = rows.schema[vector].dataType.elementType == T.FloatType()
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")), F.lit(False))
    named = [F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "v")), 16, "0") for i in range(2)]
    rep = F.unhex(F.concat(*named))
    ids = stored(own.select("vec_id", "label", F.size("v").alias("d"), F.when(ok, rep).alias("rep")))
    sizes = ids.where("rep IS NOT NULL").groupBy("label", "d").agg(F.approx_count_distinct("rep").alias("n"))
    # at most one of ``most`` rows is such a label, so these are broadcast
    large = stored(sizes.where(F.col("n") > most).select("label", "d", F.ceil(F.col("n") / most).cast("int").alias("m")))
    classes = own.where(ok).groupBy("label", "v").agg(F.count("*").alias("mult")).select("label", F.size("v").alias("d"), rep.alias("rep"), "mult", "v")
    dealt = classes.join(F.broadcast(large), ["label", "d"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    products = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    placed = dealt.withColumn("p", F.explode(products)).select("label", "d", "p.i", "p.j", "mine", "rep", "mult", "v")
    found = stored(placed.groupBy("label", "d", "i", "j").applyInArrow(lambda k, t: _linked(k, t, least, blocks), "rep binary, n long, `to` binary"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    reps = ids.where("rep IS NOT NULL").groupBy("rep").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("mult"))
    # a class of one row without a link is left as it is
    met = reps.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").where("mult > 1 OR n IS NOT NULL")
    met = stored(met.select("rep", "least_id", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    smallest = stored(met.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")))
    facts = stored(dealt_join(met, smallest, ["component"], "size").select("rep", "mult", "n_links", "component_id"))
    discard(large, found, joined, met, smallest)
    often = frequent(facts, ["rep"], "mult", ids.count())
    there, other = ids.where("rep IS NOT NULL"), facts.drop("mult")
    out = there.where(often).join(F.broadcast(other.where(often)), "rep", "left").unionByName(there.where(~often).join(other.where(~often), "rep", "left"))
    out = out.unionByName(ids.where("rep IS NULL"), allowMissingColumns=True)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
