"""Preference data: quality classes, good/bad pairs, labelled completions.

All inputs are in long form, one row per (dataset, id). Ties are always broken by
an explicit column, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mcqlab.config import QUALITY_THRESHOLD


def good(score: Column, threshold: int = QUALITY_THRESHOLD) -> Column:
    """Above the threshold; an unknown score is not good."""
    return F.coalesce(score > threshold, F.lit(False))


def last_wins(rows: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """The last row of each key. One aggregation with map-side combining, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def common_ids(rows: DataFrame, n_datasets: int) -> DataFrame:
    """Ids that every dataset has."""
    return rows.groupBy("id").agg(F.count_distinct("dataset").alias("_n")).where(F.col("_n") == n_datasets).select("id")


def quality_partition(rows: DataFrame, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    return rows.select("dataset", "id", F.when(good(F.col("distractor_quality"), threshold), "good").otherwise("bad").alias("quality_class"))


def quality_distribution(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("distractor_quality").isNotNull()).groupBy("dataset", "distractor_quality").agg(F.count("*").alias("n"))


def sources_by_quality(rows: DataFrame, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    """Per id the names of good and of bad datasets; there are as many as generators, a small number."""
    is_good = good(F.col("distractor_quality"), threshold)
    names = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("dataset"))))
    return rows.groupBy("id").agg(names(is_good).alias("good_sources"), names(~is_good).alias("bad_sources"))


def id_classes(rows: DataFrame, n_datasets: int, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    """Common ids with their numbers of good and bad MCQs, in one aggregation."""
    is_good = good(F.col("distractor_quality"), threshold)
    return (
        rows.groupBy("id")
        .agg(F.count_distinct("dataset").alias("_n"), F.count_if(is_good).alias("n_good"), F.count_if(~is_good).alias("n_bad"))
        .where(F.col("_n") == n_datasets)
        .drop("_n")
    )


def pair_stats(rows: DataFrame, n_datasets: int, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    kinds = id_classes(rows, n_datasets, threshold)
    n = F.col("n_ids")
    return (
        kinds.agg(
            F.count("*").alias("n_ids"),
            F.count_if(F.col("n_bad") == 0).alias("nb_good_only"),
            F.count_if(F.col("n_good") == 0).alias("nb_bad_only"),
            F.count_if((F.col("n_good") > 0) & (F.col("n_bad") > 0)).alias("nb_mixed"),
            F.coalesce(F.sum(F.col("n_good") * F.col("n_bad")), F.lit(0)).alias("n_pairs"),
        )
        .withColumns({f"pct_{k}": F.try_divide(F.col(f"nb_{k}") * F.lit(100.0), n) for k in ("good_only", "bad_only", "mixed")})
    )


def dpo_pairs(rows: DataFrame, n_datasets: int, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    """Every (good, bad) pair of datasets of each common id. Keys are ids, at most n_datasets rows each."""
    own = sources_by_quality(rows, threshold).where(F.size("good_sources") + F.size("bad_sources") == n_datasets)
    return own.select("id", F.explode("good_sources").alias("chosen_source"), "bad_sources").select(
        "id", "chosen_source", F.explode("bad_sources").alias("rejected_source")
    )


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with the text of either side; texts: dataset, id, completion."""
    side = lambda name: texts.select("id", F.col("dataset").alias(f"{name}_source"), F.col("completion").alias(name))
    return pairs.join(side("chosen"), ["id", "chosen_source"]).join(side("rejected"), ["id", "rejected_source"]).select("id", "chosen", "rejected", "chosen_source", "rejected_source")


def bad_only_seed(rows: DataFrame, n_datasets: int, value: str, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    """For ids without a good MCQ, the first dataset's value: the seed of a new generation."""
    is_good = good(F.col("distractor_quality"), threshold)
    return (
        rows.groupBy("id")
        .agg(F.count_distinct("dataset").alias("_n"), F.count_if(is_good).alias("_good"), F.min_by(value, "dataset").alias(value), F.min("dataset").alias("seed_source"))
        .where((F.col("_n") == n_datasets) & (F.col("_good") == 0))
        .select("id", "seed_source", value)
    )


def kto_unpivot(pairs: DataFrame) -> DataFrame:
    """Each pair as two labelled completions, in one scan."""
    side = lambda name, label: F.struct(F.col(name).alias("completion"), F.lit(label).alias("label"), F.col(f"{name}_source").alias("source"))
    return pairs.select("id", F.explode(F.array(side("chosen", True), side("rejected", False))).alias("_r")).select("id", "_r.*")


def kto_dedup(rows: DataFrame) -> DataFrame:
    """One row per completion: a positive label wins, then the smallest id and source."""
    first = F.min_by(F.struct("id", "label", "source"), F.struct((~F.col("label")).alias("n"), "id", "source"))
    return rows.groupBy("completion").agg(first.alias("_f")).select("_f.id", "completion", "_f.label", "_f.source")


def kto_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("completion").alias("n_completions"),
        F.count_if("label").alias("n_desirable"), F.count_if(~F.col("label")).alias("n_undesirable"),
    )


def accepted_attempt(scores: DataFrame, accept_min: int, max_attempts: int) -> DataFrame:
    """The first of the allowed attempts with an accepted score; ids without one are skipped."""
    return scores.where((F.col("attempt") <= max_attempts) & (F.col("score") >= accept_min)).groupBy("id").agg(F.min("attempt").alias("attempt"), F.min_by("score", "attempt").alias("score"))
