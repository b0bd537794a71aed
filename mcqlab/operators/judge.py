"""Model-backed columns: prompts go to an injected client inside the tasks.

Equal prompts are sent once. A call that fails is tried again with growing pauses; one
that fails for good costs its own cell only, and its error is kept. With a store,
answers stay between runs and only prompts without an answer are sent.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mcqlab.operators.store import KeyedStore, text_key


class LLMClient(Protocol):
    def complete(self, system: str, user: str, *, temperature: float, max_tokens: int) -> str | None: ...


class StubClient:
    """Answers by a rule; for tests and dry runs."""

    def __init__(self, rule: Callable[[str, str], str | None]):
        self.rule = rule

    def complete(self, system: str, user: str, *, temperature: float = 0.5, max_tokens: int = 1) -> str | None:
        return self.rule(system, user)


class ReplayClient(StubClient):
    """Answers from a record of earlier calls; unknown prompts get no answer."""

    def __init__(self, record: dict[str, str]):
        super().__init__(lambda _, user: record.get(user))


@dataclass(frozen=True)
class Calls:
    """How a task calls its client: tries a prompt, seconds before the second try (doubled each time), calls at once, prompts a part."""

    attempts: int = 3
    pause: float = 0.5
    at_once: int = 1
    per_part: int = 10_000


def asked(prompts: DataFrame, system: str, make_client: Callable[[], LLMClient], temperature: float = 0.5, max_tokens: int = 1, calls: Calls = Calls()) -> DataFrame:
    """(key, prompt) -> (key, value, error). make_client runs once a task; its client must bear ``at_once`` calls at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()

        def one(user: str) -> tuple[str | None, str | None]:
            error = "no answer"
            for k in range(calls.attempts):
                if k:
                    time.sleep(calls.pause * 2 ** (k - 1))
                try:
                    answer = client.complete(system, user, temperature=temperature, max_tokens=max_tokens)
                except Exception as e:  # the service's own failures
                    error = repr(e)
                    continue
                if answer is not None:
                    return answer, None
                break  # the client has none; asking again would not help
            return None, error

        with ThreadPoolExecutor(calls.at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["key", "value", "error"])

    return prompts.select("key", "prompt").mapInArrow(run, "key binary, value string, error string")


def answer_key(prompt, system: str, temperature: float, max_tokens: int):
    """What an answer hangs on: the system prompt, the parameters, and the prompt."""
    return text_key(F.lit(system), F.lit(f"{temperature!r}/{max_tokens}"), prompt)


def answered(
    rows: DataFrame, prompt: str, system: str, make_client: Callable[[], LLMClient], out: str, temperature: float = 0.5, max_tokens: int = 1,
    store: KeyedStore | None = None, calls: Calls = Calls(), error: str | None = None,
) -> DataFrame:
    """Rows with the client's answer to each prompt, null for a null prompt or a failed call.

    store: answers are taken from there, missing ones asked for and added at once;
    without it, each time the result is read. error: a column that says why a call failed.
    """
    keyed = rows.withColumn("_key", answer_key(F.col(prompt), system, temperature, max_tokens))
    wanted = keyed.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), F.col(prompt).alias("prompt"))
    ask = lambda new: asked(new, system, make_client, temperature, max_tokens, calls)
    if store is None:
        found = ask(wanted.groupBy("key").agg(F.first("prompt").alias("prompt")))
    else:
        added = store.extend(wanted, ask, calls.per_part)
        found = store.read().withColumn("error", F.lit(None).cast("string")).unionByName(added.failed.withColumn("value", F.lit(None).cast("string")))
    found = found.select(F.col("key").alias("_found"), F.col("value").alias(out), *([F.col("error").alias(error)] if error else []))
    return keyed.join(found, F.col("_key") == F.col("_found"), "left").drop("_key", "_found")


def generated_with_retry(seeds: DataFrame, generate: Callable[[str, int], str | None], score: Callable[[str], int], accept_min: int, max_attempts: int) -> DataFrame:
    """seeds (id, seed) -> (id, attempt, completion, score) of the first accepted attempt; the rest are skipped."""

    def loop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for i, seed in zip(b["id"], b["seed"], strict=True):
                for attempt in range(1, max_attempts + 1):
                    try:
                        text = generate(seed, attempt)
                        s = 0 if text is None else int(score(text))
                    except Exception:
                        continue
                    if text is not None and s >= accept_min:
                        found.append((i, attempt, text, s))
                        break
            yield pd.DataFrame(found, columns=["id", "attempt", "completion", "score"])

    kind = dict(seeds.dtypes)["id"]
    return seeds.select("id", "seed").mapInPandas(loop, f"id {kind}, attempt int, completion string, score int")
