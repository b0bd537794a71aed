"""URL filters: rules by host and path, and a logistic regression for the rest.

Native: parsing, rules, features, training and scores are Spark SQL expressions and
Spark's own logistic regression; no Python runs on the executors.

Defined results: a null url, or one without ``://``, has an empty host and path and
is judged by the model. Of fitting rules of equal length, the one listed last wins.
Urls of any length count whole. Repeated rows are judged alike; other columns pass
through, but columns with the name of a result give way to it.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.llm.common import without
from mcqlab.llm.labelled_urls import UNWANTED, WANTED

#: (verdict, host/path); the longest rule that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BUCKETS, LENGTHS = 2048, (3, 4)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the small labelled table."""
    rows = [(u, 0.0) for u in WANTED] + [(u, 1.0) for u in UNWANTED]
    return spark.createDataFrame(rows, "url string, blocked double").coalesce(1)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(f"/{own_path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of host and path, each marked by its origin."""

    def of(text: Column, origin: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(origin), F.substring(padded, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*(of(text, origin, n) for text, origin in ((host, "host"), (F.lower(path), "path")) for n in LENGTHS))


def trained(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights per bucket and the intercept, from mean-count features. labelled must be small: its feature vectors are dense."""
    own = labelled.select("blocked", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("g"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter("g", lambda x: x == k)) / F.size("g"))
    model = LogisticRegression(labelCol="blocked", regParam=1e-4, standardization=False, maxIter=60).fit(own.select("blocked", array_to_vector(counts).alias("features")))
    return model.coefficients.toArray().tolist(), float(model.intercept)


def filtered(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url: str = "url", threshold: float = 0.75) -> DataFrame:
    """pages with host, path, rule, score (the model's chance of a block) and verdict (allow or block; the model blocks above the threshold)."""
    weights, intercept = trained(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one constant
    rest = without(pages.columns, ("host", "path", "rule", "score", "verdict", "_g"))
    out = pages.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    margin = F.aggregate("_g", F.lit(0.0), lambda s, k: s + F.element_at(table, k + 1)) / F.size("_g") + F.lit(intercept)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    out = out.withColumn("_g", grams(F.col("host"), F.col("path"))).withColumns({"rule": rule, "score": score})
    return out.withColumn("verdict", F.coalesce(said, F.when(F.col("score") > threshold, "block").otherwise("allow"))).drop("_g")
