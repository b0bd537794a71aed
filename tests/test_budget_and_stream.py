"""Prompts within a budget of tokens, and completions over a stream."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from mcqlab.functions import jsonmcq, prompts
from mcqlab.operators import prefs
from mcqlab.operators.budget import budgeted, cut_at_sentence, fitted
from mcqlab.plans import flows
from mcqlab.streaming.completions import first_completions, latest


class Words:
    """A token is up to four characters of a word, or a mark; white space belongs to none."""

    def ends(self, text):
        return [m.end() for m in re.finditer(r"\w{1,4}|[^\w\s]", text)]


def test_cuts():
    text = 'One two. "Three four!" Five v1.2 six\nseven eight nine'
    assert [cut_at_sentence(text, n) for n in (100, 45, 36, 30, 21, 8, 7, 3, 0)] == [text, text[:36], text[:22], text[:22], "One two.", "One two.", "One", "One", ""]


def test_budgets_hold():
    rng, words = random.Random(2), Words()
    for _ in range(400):
        text = "".join(rng.choice(["word ", "longerword ", "x", ". ", "! ", "\n", "v1.2 ", "é "]) for _ in range(rng.randrange(60)))
        before, after = "ab"[: rng.randrange(3)], rng.choice(["", "tail", " tail."])
        budget = rng.randrange(0, 50)
        prompt, n = fitted(before, text, after, words, budget)
        fixed = len(words.ends(before + after))
        if prompt is None:
            assert fixed > budget and n == fixed
            continue
        assert n == len(words.ends(prompt)) <= budget and prompt.startswith(before) and prompt.endswith(after)
        kept = prompt[len(before) : len(prompt) - len(after)]
        assert text.startswith(kept)
        if kept != text and kept and re.search(r"[.!?](\s|$)|\n", text[: len(kept)]):
            assert re.search(r"[.!?]$|\w$", kept)


def test_budgeted_rows(spark):
    rows = spark.createDataFrame([(1, "Short."), (2, "First one here. " * 50), (3, None)], "id int, content string")
    got = {r["id"]: r for r in budgeted(rows, F.lit(prompts.GENERATION_PREFIX), F.col("content"), F.lit(prompts.GENERATION_SUFFIX), Words, 100).collect()}
    assert got[1]["prompt"].endswith("Short.\n") and got[3]["prompt"] is None
    assert got[2]["prompt_tokens"] <= 100 < got[2]["prompt_tokens"] + 6 and got[2]["prompt"].endswith("here.\n")
    assert budgeted(rows, F.lit("x " * 9), F.col("content"), F.lit(""), Words, 5).where("prompt IS NOT NULL").count() == 0


def test_generation_within_a_budget(spark):
    good = json.dumps({f: "x" for f in jsonmcq.FIELDS})

    def make():
        def generate(prompt, temperature, schema):
            assert len(Words().ends(prompt)) <= 120
            return f"Here:\n```json\n{good}\n```" if prompt.endswith("here.\n") else "none"

        return generate

    sheets = spark.createDataFrame([("a", "First one here. " * 99), ("b", None)], "id string, content_gpt string")
    rows = flows.generated(sheets, make, (0.1,), Words, 120, tolerant=True).collect()
    assert {r["id"]: r["question"] for r in rows} == {"a": "x", "b": ""}
    assert {r["question"] for r in flows.generated(sheets, make, (0.1,), Words, 5).collect()} == {""}


@pytest.mark.parametrize("files", [1, 4])
def test_stream_of_completions_equals_batch(spark, tmp_path, files):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(f"c{rng.randrange(30)}", rng.randrange(100), rng.random() < 0.3, f"m{rng.randrange(3)}", start + dt.timedelta(seconds=i)) for i in range(300)]
    schema = "completion string, id long, label boolean, source string, at timestamp"
    table = spark.createDataFrame(rows, schema)
    for k in range(files):
        table.where(F.col("id") % files == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    winners = first_completions(stream, "at", "1 hour")
    winners.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    got = latest(spark.read.parquet(str(tmp_path / "out")))
    want = prefs.kto_dedup(table.drop("at").withColumn("id", F.col("id").cast("string"))).select("id", "completion", "label", "source")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
