"""The runs that users start: evaluation, generation, preference data, training sets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.config import EVAL_FRACTION, QUALITY_THRESHOLD, SEED, McqColumns, MetricConfig
from mcqlab.functions import jsonmcq, prompts, text
from mcqlab.operators import judge, prefs, relational
from mcqlab.operators.budget import Tokenizer, budgeted
from mcqlab.operators.split import split
from mcqlab.plans.evaluate import ERRORS, Services, complete
from mcqlab.sources import io

TEMPERATURES = (0.1, 0.5, 0.7)
#: The longest prompt of a generator, in tokens.
CONTEXT_TOKENS = 8192
#: What a generator is asked to answer: a JSON object of six strings.
MCQ_SCHEMA = {"type": "object", "properties": {f: {"type": "string"} for f in jsonmcq.FIELDS}, "required": list(jsonmcq.FIELDS)}


def result_schema(config: MetricConfig, services: Services = Services()) -> str:
    """The columns of a run's CSV folder."""
    metrics = {"originality": "double", "readability": "double", "negation": "boolean", "is_question": "boolean", "relevance": "double", "ambiguity": "double", "answerability": "string", "disclosure": "string", "difficulty": "string", "distractors_quality": "string"}
    own = [f"`{config.out(k)}` {v}" for k, v in metrics.items() if getattr(config, k)] + [f"`{m.name}` {m.kind}" for m in services.custom]
    return ", ".join([f"{n} string" for n in io.MCQS.names] + own + [f"{ERRORS} string"] * may_fail(config, services))


def may_fail(config: MetricConfig, services: Services) -> bool:
    """Whether a metric of the run is made by something that can fail."""
    return any(getattr(config, m) for m in ("relevance", "ambiguity", "answerability", "disclosure", "difficulty", "distractors_quality")) or bool(services.custom)


def evaluation_run(
    spark: SparkSession, sheets: str, mcqs: str, out: str, config: MetricConfig = MetricConfig(), make_client: Callable[[], judge.LLMClient] | None = None,
    services: Services = Services(), earlier: bool = False,
) -> None:
    """CSV folders of sheets and MCQs -> a CSV folder of the MCQs with their metrics and, as JSON, ``errors``.

    Sheets without an MCQ are left out. earlier: mcqs is the result of an earlier run,
    of which only the cells that failed are made anew.
    """
    if make_client is not None:
        services = replace(services, make_client=make_client)
    own = io.read_csv(spark, mcqs, result_schema(config, services) if earlier else io.MCQS)
    if earlier:
        own = own.withColumn(ERRORS, F.coalesce(F.from_json(ERRORS, "map<string,string>"), F.create_map().cast("map<string,string>")))
    content = io.read_csv(spark, sheets, io.SHEETS)
    if config.originality or config.answerability:  # relevance leaves the others out by their keys
        content = relational.semi_join_sheets(content, own)
    rows = complete(own, content, config, services)
    if not may_fail(config, services):
        rows = rows.drop(ERRORS)
    columns = [F.col(c) if c != ERRORS else F.when(F.size(ERRORS) > 0, F.to_json(ERRORS)).alias(ERRORS) for c in rows.columns]
    io.write_csv(rows.select(*columns), out)


def run_from_env(spark: SparkSession, config: MetricConfig = MetricConfig(), make_client: Callable[[], judge.LLMClient] | None = None, services: Services = Services()) -> None:
    """``evaluation_run`` over the paths that the environment names."""
    paths = io.settings_from_env()
    if missing := [k for k, v in paths.items() if not v]:
        raise ValueError(f"set {', '.join(missing)}")
    evaluation_run(spark, paths["MCQLAB_SHEETS"], paths["MCQLAB_MCQS"], paths["MCQLAB_OUTPUT"], config, make_client, services)


def generated(
    sheets: DataFrame, make_generator: Callable[[], Callable[[str, float, dict], str | None]], temperatures: Iterable[float] = TEMPERATURES,
    make_tokenizer: Callable[[], Tokenizer] | None = None, budget: int = CONTEXT_TOKENS, tolerant: bool = False,
) -> DataFrame:
    """sheets (id, content_gpt) -> one MCQ for each sheet and temperature, as ``flattened_answers``.

    make_generator runs once a task; a generator takes a prompt, a temperature and the
    JSON schema of the answer. A failing call gives an empty MCQ. make_tokenizer: sheets
    are cut at a sentence so that no prompt has more than ``budget`` tokens. tolerant:
    answers may stand in fences or prose, or be cut off.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generator()

        def one(prompt: str | None, temperature: float) -> str | None:
            if prompt is None:  # even an empty sheet would be over the budget
                return None
            try:
                return generate(prompt, temperature, MCQ_SCHEMA)
            except Exception:  # the service's own failures cost one cell
                return None

        for b in batches:
            yield b[["id", "temperature"]].assign(raw=[one(p, t) for p, t in zip(b["_prompt"], b["temperature"], strict=True)])

    if make_tokenizer is None:
        own = sheets.select("id", prompts.generation_prompt(F.col("content_gpt")).alias("_prompt"))
    else:
        content = F.coalesce("content_gpt", F.lit("nan"))
        own = budgeted(sheets.select("id", content.alias("_c")), F.lit(prompts.GENERATION_PREFIX), F.col("_c"), F.lit(prompts.GENERATION_SUFFIX), make_tokenizer, budget, "_prompt")
    long = own.select("id", "_prompt", F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    return flattened_answers(long.mapInPandas(run, f"id {sheets.schema['id'].dataType.simpleString()}, temperature double, raw string"), tolerant)


def flattened_answers(answers: DataFrame, tolerant: bool = False) -> DataFrame:
    """(id, temperature, raw) -> (id, temperature, six strings): validated JSON, an empty MCQ for what is invalid."""
    parse = jsonmcq.tolerant_mcq if tolerant else jsonmcq.validated_mcq
    valid = answers.select("id", "temperature", parse(F.col("raw")).alias("mcq"))
    return relational.patched(valid, "mcq", jsonmcq.empty_mcq()).select("id", "temperature", "mcq.*")


def scored_generated(mcqs: DataFrame, make_client: Callable[[], judge.LLMClient], columns: McqColumns = McqColumns()) -> DataFrame:
    """MCQs with ``distractor_quality``: the judge's answer as a number, 0 for anything else."""
    asked = judge.answered(mcqs.withColumn("_user", prompts.judge_prompt(columns)), "_user", prompts.SYSTEM_PROMPTS["distractors_quality"], make_client, "_answer")
    return asked.withColumn("distractor_quality", text.parse_score(F.col("_answer"))).drop("_user", "_answer")


def preference_pairs(scored: DataFrame, texts: DataFrame, made: DataFrame, n_datasets: int, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    """Good against bad MCQs of each common id; for ids without a good one, ``made`` (id, completion) against each bad one.

    made: accepted regenerations, from ``judge.generated_with_retry`` over ``prefs.bad_only_seed``.
    """
    pairs = prefs.with_texts(prefs.dpo_pairs(scored, n_datasets, threshold), texts)
    bad = prefs.id_classes(scored, n_datasets, threshold).where("n_good = 0").select("id")
    rejected = scored.select("id", "dataset").join(bad, "id").join(texts, ["id", "dataset"]).select("id", F.col("completion").alias("rejected"), F.col("dataset").alias("rejected_source"))
    more = made.select("id", F.col("completion").alias("chosen")).join(rejected, "id")
    return pairs.unionByName(more.withColumn("chosen_source", F.lit("generated")).select(*pairs.columns))


def builder_stats(scored: DataFrame, made: DataFrame, n_datasets: int, threshold: int = QUALITY_THRESHOLD) -> DataFrame:
    """Counts of ids by class, of accepted regenerations, and of pairs, in one row."""
    kinds = prefs.id_classes(scored, n_datasets, threshold).join(made.select("id", F.lit(1).alias("_made")), "id", "left")
    bad_only = F.col("n_good") == 0
    used = bad_only & F.col("_made").isNotNull()
    return kinds.agg(
        F.count_if(F.col("n_bad") == 0).alias("nb_good_only"), F.count_if(bad_only).alias("nb_bad_only"), F.count_if(used).alias("nb_generated"),
        F.coalesce(F.sum(F.col("n_good") * F.col("n_bad") + F.when(used, F.col("n_bad")).otherwise(0)), F.lit(0)).alias("n_pairs"),
    )


def training_set(rows: DataFrame, key: str, path: str, eval_fraction: float = EVAL_FRACTION, seed: int = SEED) -> DataFrame:
    """rows with a prompt each and ``held_out``, written to a parquet folder and read again; keys must be unique."""
    with_prompt = rows.withColumn("prompt", prompts.assigned_prompt(F.col(key), seed))
    with_prompt.write.parquet(f"{path}-rows")
    kept = rows.sparkSession.read.parquet(f"{path}-rows")
    split(kept, key, lambda n: int(n * eval_fraction), seed).write.parquet(path)
    return rows.sparkSession.read.parquet(path)
