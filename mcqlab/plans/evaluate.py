"""All metrics of an MCQ table: rules in one projection, and what needs a model, cell by cell.

``evaluate`` appends the rule metrics. ``complete`` appends those that need an encoder,
a judge or a user's own function as well, each cell on its own: what fails leaves a
null and an entry in the map column ``errors``, and a table that has that column
already gets only the cells that failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mcqlab.config import MetricConfig
from mcqlab.functions import prompts, text, vector
from mcqlab.operators import judge, relational
from mcqlab.operators.encode import BATCH_TOKENS, MAX_TOKENS, Encoder, extend_vectors
from mcqlab.operators.hot import stored
from mcqlab.operators.lemmas import Lexicon, changes, replaced
from mcqlab.operators.store import KeyedStore, text_key

ERRORS = "errors"


def _grams(name: str, config: MetricConfig) -> Column:
    lemmas = F.create_map(*(F.lit(x) for pair in config.lemmas for x in pair)) if config.lemmas else None
    return text.trigrams(text.clean_tokens(F.col(name), list(config.stopwords), lemmas))


def originality(mcqs: DataFrame, sheets: DataFrame, config: MetricConfig, lexicon: Lexicon | None = None) -> DataFrame:
    """mcqs with the originality, null without a sheet; the trigrams of a sheet are made once for all its questions.

    lexicon: tokens give way to their lemmas.
    """
    c, out = config.columns, config.out("originality")
    if lexicon is None:
        own = sheets.groupBy(F.col(c.id).alias("_k")).agg(F.min(c.context).alias("_t"))
        grams = own.select("_k", _grams("_t", config).alias("_sheet"))
        joined = mcqs.join(grams, mcqs[c.id].eqNullSafe(grams["_k"]), "left")
        value = text.originality(_grams(c.question, config), F.col("_sheet"))
        return joined.withColumn(out, F.when(F.col("_sheet").isNotNull(), value)).drop("_k", "_sheet")
    # all is met by id, a null id being one of its own, so that a sheet is shuffled once and its trigrams never
    by_id = F.coalesce(text_key(F.col(c.id).cast("string")), F.lit(b"")).alias("_i")
    words = lambda name: text.clean_tokens(F.col(name), list(config.stopwords))
    texts = mcqs.select(by_id, words(c.question).alias("_w")).unionByName(sheets.select(by_id, words(c.context).alias("_w")))
    own = sheets.groupBy(by_id).agg(F.min(c.context).alias("_t")).where("_t IS NOT NULL").join(changes(texts, "_i", "_w", lexicon), "_i", "left")
    grams = lambda name: text.trigrams(replaced(words(name), F.col("_changed")))
    joined = mcqs.withColumn("_i", by_id).join(own.select("_i", "_changed", grams("_t").alias("_sheet")), "_i", "left")
    return joined.withColumn(out, F.when(F.col("_sheet").isNotNull(), text.originality(grams(c.question), F.col("_sheet")))).drop("_i", "_changed", "_sheet")


def evaluate(mcqs: DataFrame, config: MetricConfig = MetricConfig(), sheets: DataFrame | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """Rule and vector metrics that the configuration switches on, in the documented order.

    Relevance needs columns question_vec and sheet_vec; ambiguity option_a_vec to
    option_d_vec. With sheets (id, content), the trigrams of a sheet are made once for
    all its questions, by a join; without, in one projection from the content column.
    A lexicon, which needs the sheets, makes originality compare lemmas.
    """
    c, added = config.columns, {}
    if config.originality and sheets is not None:
        mcqs = originality(mcqs, sheets, config, lexicon)
    elif config.originality:
        added[config.out("originality")] = F.when(F.col(c.context).isNotNull(), text.originality(_grams(c.question, config), _grams(c.context, config)))
    if config.readability:
        added[config.out("readability")] = text.readability(F.col(c.question))
    if config.negation:
        added[config.out("negation")] = text.starts_with_negation(F.col(c.question))
    if config.is_question:
        added[config.out("is_question")] = text.is_question(F.col(c.question))
    if config.relevance:
        added[config.out("relevance")] = vector.cosine(F.col("question_vec"), F.col("sheet_vec"))
    if config.ambiguity:
        added[config.out("ambiguity")] = vector.ambiguity([F.col(f"{o}_vec") for o in c.options], F.col(c.correct))
    return mcqs.withColumns(added) if added else mcqs


def judge_prompts(config: MetricConfig) -> dict:
    """Output column -> (metric, user prompt)."""
    c = config.columns
    every = {
        "answerability": prompts.judge_prompt(c, correct=config.include_correct_option, context=c.context),
        "disclosure": prompts.judge_prompt(c, options=False),
        "difficulty": prompts.judge_prompt(c),
        "distractors_quality": prompts.judge_prompt(c),
    }
    return {config.out(k): (k, v) for k, v in every.items() if getattr(config, k)}


def judged(mcqs: DataFrame, config: MetricConfig, make_client) -> DataFrame:
    """evaluate() and the metrics that ask a model; write the result before it is read twice."""
    out = evaluate(mcqs, config)
    for column, (metric, prompt) in judge_prompts(config).items():
        out = judge.answered(out.withColumn("_user", prompt), "_user", prompts.SYSTEM_PROMPTS[metric], make_client, column).drop("_user")
    return out


@dataclass(frozen=True)
class CustomMetric:
    """A user's own function of some columns of a row; kind: its type, in SQL's spelling."""

    name: str
    inputs: tuple[str, ...]
    kind: str
    f: Callable

    def value(self) -> Column:
        """A struct of the value and of what went wrong."""

        @pandas_udf(f"value {self.kind}, error string")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            def one(*cells) -> tuple:
                try:
                    return self.f(*cells), None
                except Exception as e:  # the function's own failures cost one cell
                    return None, repr(e)

            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)
                yield pd.DataFrame([one(*cells) for cells in zip(*columns, strict=True)], columns=["value", "error"], dtype=object)

        return run(*self.inputs)


@dataclass(frozen=True)
class Services:
    """What a run may call: a judge with the store of its answers, an encoder with the store of its vectors, own functions."""

    make_client: Callable[[], judge.LLMClient] | None = None
    answers: KeyedStore | None = None
    calls: judge.Calls = judge.Calls()
    make_encoder: Callable[[], Encoder] | None = None
    vectors: KeyedStore | None = None
    max_tokens: int = MAX_TOKENS
    batch_tokens: int = BATCH_TOKENS
    custom: tuple[CustomMetric, ...] = ()
    lexicon: Lexicon | None = None


def _due(out: str, again: bool) -> Column:
    return F.map_contains_key(ERRORS, out) if again else F.lit(True)


def _filled(rows: DataFrame, out: str, value: Column, error: Column, again: bool) -> DataFrame:
    """The cells that are due, with their errors in the map instead of those that were there."""
    due = _due(out, again)
    others = F.map_filter(ERRORS, lambda k, v: k != out)
    new = F.when(error.isNotNull(), F.map_concat(others, F.create_map(F.lit(out), error))).otherwise(others)
    both = rows.withColumns({"_new": F.when(due, value).otherwise(F.col(out)) if again else value, "_errors": F.when(due, new).otherwise(F.col(ERRORS))})
    return both.drop(out, ERRORS).withColumnsRenamed({"_new": out, "_errors": ERRORS})


def sheet_keys(sheets: DataFrame, mcqs: DataFrame, key: str, content: str) -> DataFrame:
    """(_k, _sheet): the id of each sheet that has an MCQ, and the key of its text, the smallest of several; texts are shuffled only where an id has several."""
    keyed = sheets.where(F.col(content).isNotNull()).select(F.col(key).alias("_k"), text_key(F.col(content)).alias("_sheet"))
    one = stored(keyed.groupBy("_k").agg(F.min("_sheet").alias("_sheet"), F.max("_sheet").alias("_other")))
    own, several = one.where("_sheet = _other").select("_k", "_sheet"), one.where("_sheet <> _other").select(F.col("_k").alias("_i"))
    if not several.isEmpty():
        smallest = sheets.join(several, F.col(key).eqNullSafe(F.col("_i")), "left_semi").groupBy(F.col(key).alias("_k")).agg(F.min(content).alias("_t"))
        own = own.unionByName(smallest.select("_k", text_key(F.col("_t")).alias("_sheet")))
    return stored(own.join(mcqs.select(F.col(key).alias("_i")), F.col("_k").eqNullSafe(F.col("_i")), "left_semi"))


def _by_vectors(rows: DataFrame, sheets: DataFrame, config: MetricConfig, services: Services, again: bool) -> DataFrame:
    c = config.columns
    if services.make_encoder is None or services.vectors is None:
        raise ValueError("relevance and ambiguity need an encoder and a store of vectors")
    texts, keys, wanted = [], {}, []
    if config.relevance:
        due = _due(config.out("relevance"), again)
        own = sheet_keys(sheets, rows.where(due), c.id, c.context)
        wanted.append(own.select(F.col("_sheet").alias("key")))
        texts += [(rows.where(due), F.col(c.question)), (sheets, F.col(c.context))]
        rows = rows.join(own, F.col(c.id).eqNullSafe(F.col("_k")), "left").drop("_k")
        keys |= {"_q": F.when(due, text_key(F.col(c.question))), "_s": F.when(due, F.col("_sheet"))}
    if config.ambiguity:
        due = _due(config.out("ambiguity"), again)
        texts += [(rows.where(due), F.col(o)) for o in c.options]
        keys |= {f"_{mark}": F.when(due, text_key(F.col(o))) for mark, o in zip("abcd", c.options, strict=True)}
    wanted += [of.select(text_key(t).alias("key")) for of, t in texts if of is not sheets]
    extend_vectors(services.vectors, texts, services.make_encoder, services.max_tokens, services.batch_tokens, reduce(DataFrame.unionByName, wanted))
    rows = services.vectors.attach(rows, keys)
    if config.relevance:
        value = vector.cosine(F.col("_q"), F.col("_s"))
        error = F.when(F.col(c.question).isNull(), "no question").when(F.col("_sheet").isNull(), "no sheet").when(value.isNull(), "no vector")
        rows = _filled(rows, config.out("relevance"), value, error, again).drop("_q", "_s", "_sheet")
    if config.ambiguity:
        value = vector.ambiguity([F.col(f"_{mark}") for mark in "abcd"], F.col(c.correct))
        lacking = F.exists(F.array(*c.options), lambda o: o.isNull())
        error = F.when(value.isNull() & lacking, "an option is missing").when(value.isNull(), "no vector")
        rows = _filled(rows, config.out("ambiguity"), value, error, again).drop("_a", "_b", "_c", "_d")
    return rows


def complete(mcqs: DataFrame, sheets: DataFrame, config: MetricConfig, services: Services = Services()) -> DataFrame:
    """Every metric that the configuration and ``services.custom`` name, and ``errors``: name of a metric -> why its cell is null.

    mcqs that have ``errors`` keep their cells but those that failed, which are made anew.
    """
    c, again = config.columns, ERRORS in mcqs.columns
    rows = mcqs
    if not again:
        rows = evaluate(mcqs, replace(config, relevance=False, ambiguity=False), sheets, services.lexicon).withColumn(ERRORS, F.create_map().cast("map<string,string>"))
    if config.relevance or config.ambiguity:
        rows = _by_vectors(rows, sheets, config, services, again)
    asked = judge_prompts(config)
    if asked and services.make_client is None:
        raise ValueError("judged metrics need a client")
    if config.answerability:
        rows = relational.left_join_context(rows, sheets, c.id, c.context)
    for out, (metric, prompt) in asked.items():
        rows = rows.withColumn("_user", F.when(_due(out, again), prompt))
        if services.answers is not None:
            rows = stored(rows)  # read to find what is lacking, and again
        rows = judge.answered(rows, "_user", prompts.SYSTEM_PROMPTS[metric], services.make_client, "_answer", store=services.answers, calls=services.calls, error="_error")
        rows = _filled(rows, out, F.col("_answer"), F.col("_error"), again).drop("_user", "_answer", "_error")
    if config.answerability:
        rows = rows.drop(c.context)
    for m in services.custom:
        rows = rows.withColumn("_got", F.when(_due(m.name, again), m.value()))
        rows = _filled(rows, m.name, F.col("_got.value"), F.col("_got.error"), again).drop("_got")
    return rows
