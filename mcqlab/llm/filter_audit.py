"""Interaction of filters that are applied one after another, in every order.

A document's failures are a set of filters. Which documents a filter removes depends
only on the set of those applied before it, so all orders together are the paths
through the lattice of subsets: a state is the set applied so far, an edge applies one
more filter and removes the documents that fail it and none before it. ``paths`` counts
the orders that reach and that leave each state, forward and backward over the lattice;
an edge is thus taken by reaching x leaving orders, which is the weight of its removals
in the Shapley sums, and the steps of one order are read from the edges on its path.

Documents are counted by part and set of failures first (parts x 2**filters rows at
most), so the lattice never sees a document. Equal texts are told by SHA-256; copies are
counted together before they meet, so a large group of copies is no hot task.

Defined results: a null text is empty; a null part is the empty string; a document
without an id equals no smaller id's text and none equals it, and it has no label; of
repeated ids each row counts, and rows of one id do not make each other copies; a
document with several labels is good (toxic) if any of them says so; other columns are
left out; an empty table has no part and so no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
MOST_FILTERS = 8  # 40,320 orders
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails, by filter; E needs the other documents."""
    n = F.length(text)
    capitals = n - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": 100 * capitals > 3 * n, "D": text.rlike("[#$%&*|]")}


def bits(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def failure_sets(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents counted by the bits of the filters A to E that they fail."""
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    own = own.select("id", "part", "t", words.alias("w")).select("id", "part", "t", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))
    judged = own.select("id", "part", F.unhex(F.sha2("t", 256)).alias("h"), bits(list(failures(F.col("t")).values())).alias("failed"))
    rows = judged.groupBy("id", "part", "h", "failed").agg(F.count("*").alias("n"))
    rated = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    with_id = rows.where("id IS NOT NULL").join(rated, "id", "left").select("id", "part", "h", "failed", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # copies, by what else tells them apart; only those of the smallest id are no repeats
    kinds = with_id.groupBy("h", "part", "failed", "good", "toxic").agg(F.min("id").alias("low"), F.sum("n").alias("n"), F.min_by("n", "id").alias("n_low"))
    least = F.min("low").over(Window.partitionBy("h"))
    split = kinds.withColumn("first", F.when(F.col("low") == least, F.col("n_low")).otherwise(F.lit(0)))
    cases = F.explode(F.array(F.struct(F.col("failed"), F.col("first").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("first")).alias("n"))))
    counted = split.select("part", "good", "toxic", cases.alias("c")).select("part", "c.failed", "c.n", "good", "toxic").where("n > 0")
    loose = rows.where("id IS NULL").select("part", "failed", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    every = counted.unionByName(loose)
    return every.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def paths(k: int) -> tuple[list[int], list[int]]:
    """The numbers of orders that reach each subset of k filters from the empty one, and that lead on to the full one."""
    size, full = 1 << k, (1 << k) - 1
    reaching, leaving = [0] * size, [0] * size
    reaching[0] = leaving[full] = 1
    for s in range(1, size):
        reaching[s] = sum(reaching[s ^ 1 << i] for i in range(k) if s >> i & 1)
    for s in range(full - 1, -1, -1):
        leaving[s] = sum(leaving[s | 1 << i] for i in range(k) if not s >> i & 1)
    return reaching, leaving


def edge_removals(sets: DataFrame, k: int) -> DataFrame:
    """(part, state, filter, n, good, toxic, total): what a filter removes once those in ``state`` were applied; zeros included."""
    edges = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s, f in _edges(k))))
    met = sets.select("*", edges.alias("e")).select("part", "failed", *COUNTS, "e.*")
    removed = [F.sum(F.when(F.getbit("failed", "filter") == 1, F.col(c)).otherwise(0)).alias(c) for c in COUNTS]
    # a document is still there if it fails none of the filters of the state
    still = [F.when(F.col("failed").bitwiseAND(F.col("state")) == 0, F.col(c)).otherwise(0).alias(c) for c in COUNTS]
    return met.select("part", "failed", "state", "filter", F.col("n").alias("all"), *still).groupBy("part", "state", "filter").agg(*removed, F.sum("all").alias("total"))


def _edges(k: int) -> list[tuple[int, int]]:
    return [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def audited(sets: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, failed, n, good, toxic) -> one row per part, order of the filters, and step.

    filters: one letter each; bit i of ``failed`` belongs to the i-th.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS or len(set(filters)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} different letters")
    spark = sets.sparkSession
    reaching, leaving = paths(k)
    full = (1 << k) - 1
    taken = spark.createDataFrame([(s, f, reaching[s] * leaving[s | 1 << f], s | 1 << f == full) for s, f in _edges(k)], "state int, filter int, orders long, last boolean")
    plan = spark.createDataFrame([("".join(filters[f] for f in p), i + 1, sum(1 << f for f in p[:i]), p[i]) for p in permutations(range(k)) for i in range(k)], "filter_order string, step int, state int, filter int")
    of_filter = Window.partitionBy("part", "filter")
    # with no filter before it, it removes all that fail it; with all others before it, those that fail it alone
    edges = edge_removals(sets, k).join(F.broadcast(taken), ["state", "filter"]).withColumns({
        "shapley": F.sum(F.col("n") * F.col("orders")).over(of_filter),
        "failing": F.max(F.when(F.col("state") == 0, F.col("n"))).over(of_filter),
        "unique_fails": F.max(F.when(F.col("last"), F.col("n"))).over(of_filter),
    })
    done = F.sum("n").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return edges.join(F.broadcast(plan), ["state", "filter"]).select(
        "part", "filter_order", "step", (F.col("total") - done).alias("kept"), F.col("n").alias("removed"), (F.col("failing") - F.col("n")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
