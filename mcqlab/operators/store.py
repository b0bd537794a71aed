"""Results that are dear to make (model answers, embeddings), kept between runs by key and only ever extended.

A store is a parquet folder of (key, value). ``extend`` finds the keys that it lacks,
makes their values in parts, and appends each part as soon as it is whole, so a run
that dies is taken up after its last part, and a second run makes nothing. A store has
one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.operators.hot import dealt_join, discard, located, stored

PER_PART = 100_000
#: An extension has no more parts than this: each is a job of its own, and a folder that every task writes to.
MOST_PARTS = 16


def text_key(*texts: Column) -> Column:
    """A 256-bit key of one or several texts; null if the last one is."""
    *fixed, text = texts
    parts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in fixed]
    return F.unhex(F.sha2(F.concat(*parts, text), 256))


@dataclass
class Extension:
    """What a run added: the number of keys that were asked for anew, and (key, error) of those that failed."""

    asked: int
    failed: DataFrame
    _tables: list[DataFrame] = field(default_factory=list)


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, value: str):
        """value: the type of the values, in SQL's spelling."""
        self.spark, self.path, self.value = spark, path, value

    def read(self) -> DataFrame:
        schema = f"key binary, value {self.value}"
        where, files = located(self.spark, self.path)
        return self.spark.read.schema(schema).parquet(self.path) if files.exists(where) else self.spark.createDataFrame([], schema)

    def extend(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], per_part: int = PER_PART, among: DataFrame | None = None) -> Extension:
        """Adds the values of the keys that are missing.

        wanted: (key, ...) with any number of rows a key, all alike; null keys are left
        out. make: those rows, one a key, -> (key, value, error); a value whose error is
        not null is not kept, so it is asked for again next time. per_part: keys a part;
        more where there would be over MOST_PARTS parts. among: a table whose keys are
        those to be looked at, if wanted has others too.
        """
        wanted = wanted.where(F.col("key").isNotNull())
        # keys first: if there is nothing to do, the texts are not shuffled
        lacking = stored((wanted if among is None else among.where("key IS NOT NULL")).select("key").distinct().join(self.read().select("key"), "key", "left_anti"))
        n = lacking.count()
        none = self.spark.createDataFrame([], "key binary, error string")
        if not n:
            discard(lacking)
            return Extension(0, none)
        rest = [c for c in wanted.columns if c != "key"]
        once = wanted.groupBy("key").agg(*(F.first(c).alias(c) for c in rest))
        parts = min(-(-n // per_part), MOST_PARTS)
        todo = stored(once.join(lacking, "key", "left_semi").withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")), "_part")
        discard(lacking)
        made = []
        for part in range(parts):
            new = stored(make(todo.where(F.col("_part") == part).drop("_part")).select("key", F.col("value").cast(self.value).alias("value"), "error"))
            new.where("error IS NULL").select("key", "value").write.mode("append").parquet(self.path)
            made.append(new)
        discard(todo)
        failed = reduce(DataFrame.unionByName, [m.where("error IS NOT NULL").select("key", "error") for m in made], none)
        return Extension(n, failed, made)

    def attach(self, rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
        """rows with the value of each key under its name, null where there is none, in a stored table.

        The keys of a row are looked up in one join, whatever their number; keys that
        many rows share are dealt out.
        """
        keyed = stored(rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys.values())), F.monotonically_increasing_id().alias("_id")))
        slots = F.explode(F.array(*(F.struct(F.lit(i).alias("_slot"), F.col(f"_k{i}").alias("key")) for i in range(len(keys)))))
        looked = keyed.select("_id", slots.alias("s")).select("_id", "s.*").where("key IS NOT NULL")
        values = stored(looked.groupBy("key").agg(F.count("*").alias("_uses")).join(self.read(), "key").groupBy("key", "_uses").agg(F.first("value").alias("value")))
        met = dealt_join(looked, values, ["key"], "_uses")
        wide = met.groupBy("_id").agg(*(F.first(F.when(F.col("_slot") == i, F.col("value")), ignorenulls=True).alias(f"_v{i}") for i in range(len(keys))))
        out = keyed.select(*rows.columns, "_id").join(wide, "_id", "left")
        out = stored(out.select(*rows.columns, *(F.col(f"_v{i}").alias(k) for i, k in enumerate(keys))))
        discard(keyed, values)
        return out
