"""Runs that call an encoder, a judge and own functions: what is kept, what fails, what is made anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mcqlab.config import MetricConfig
from mcqlab.operators import hot, judge
from mcqlab.operators.encode import VECTOR, encoded, extend_vectors, token_batches
from mcqlab.operators.store import KeyedStore, text_key
from mcqlab.plans import evaluate as ev
from mcqlab.plans import flows
from mcqlab.sources import io

QUIET = judge.Calls(attempts=2, pause=0.0, at_once=3, per_part=4)


class Counting:
    """An encoder that counts what it encodes and refuses some texts."""

    special = 2

    def __init__(self, calls, widths=None):
        self.calls, self.widths = calls, widths

    def tokens(self, texts):
        return [[len(w) for w in t.split()] for t in texts]

    def encode(self, tokens):
        self.calls.add(len(tokens))
        if any(t[:1] == [7] for t in tokens):
            raise ValueError("no sevens")
        return np.array([[1.0, len(t), sum(t)] for t in tokens])


def test_token_batches():
    lengths = [5, 1, 9, 3, 3, 40, 0]
    got = list(token_batches(lengths, 10))
    assert sorted(i for b in got for i in b) == list(range(7))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 10 for b in got) and len(got) == 4
    assert list(token_batches([], 10)) == []


def test_vectors_are_kept(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(1, "a bb", "x"), (2, "a bb", None), (3, "", "w " * 100), (4, None, "w " * 30)], "id int, s string, t string")
    store = KeyedStore(spark, str(tmp_path / "v"), VECTOR)
    texts = [(rows, F.col("s")), (rows, F.col("t"))]
    got = extend_vectors(store, texts, lambda: Counting(calls), max_tokens=12)
    assert (got.asked, calls.value, store.read().count(), got.failed.count()) == (5, 5, 5, 0)
    assert extend_vectors(store, texts, lambda: Counting(calls)).asked == 0 and calls.value == 5
    wide = {r["id"]: r for r in store.attach(rows, {"a": text_key(F.col("s")), "b": text_key(F.col("t"))}).collect()}
    assert wide[1]["a"] == wide[2]["a"] and wide[2]["b"] is None and wide[4]["a"] is None and len(wide) == 4
    assert wide[3]["b"] == pytest.approx(np.array([1, 10, 10]) / 201**0.5)  # cut to 12 tokens, two of them special
    more = rows.union(spark.createDataFrame([(5, "new", "seventy seven"), (6, "sevenly off", "a bb")], rows.schema))
    got = extend_vectors(store, [(more, F.col("s")), (more, F.col("t"))], lambda: Counting(calls), batch_tokens=1)
    assert got.asked == 3 and [r["error"] for r in got.failed.collect()] == ["ValueError('no sevens')"] * 2
    assert store.read().count() == 6 and store.read().groupBy("key").count().where("count > 1").count() == 0


def test_encoder_whose_tokens_fail(spark):
    class Broken(Counting):
        def tokens(self, texts):
            raise KeyError("vocabulary")

    texts = spark.createDataFrame([(b"k", "t")], "key binary, text string")
    assert [(r["value"], r["error"]) for r in encoded(texts, lambda: Broken(None)).collect()] == [(None, "KeyError('vocabulary')")]


def test_rows_that_share_everything(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "string")
    assert store.read().count() == 0
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 900)).alias("t"))
    added = store.extend(rows.select(text_key(F.col("t")).alias("key"), "t"), lambda new: new.select("key", F.upper("t").alias("value"), F.lit(None).cast("string").alias("error")), per_part=100)
    assert added.asked == rows.select("t").distinct().count() == store.read().count()
    assert store.attach(rows, {"up": text_key(F.col("t")), "none": F.lit(None).cast("binary")}).where("up = upper(t) AND none IS NULL").count() == 5000
    assert store.attach(rows.where("false"), {"up": text_key(F.col("t"))}).count() == 0


def test_parts_stay_few(spark, tmp_path):
    made, store = [], KeyedStore(spark, str(tmp_path / "s"), "string")
    rows = spark.range(300).select(text_key(F.col("id").cast("string")).alias("key"), F.col("id").cast("string").alias("t"))

    def make(new):
        made.append(new)
        return new.select("key", F.col("t").alias("value"), F.lit(None).cast("string").alias("error"))

    assert store.extend(rows, make, per_part=5).asked == 300 and len(made) <= 16
    assert store.read().count() == store.read().distinct().count() == 300 and store.extend(rows, make).asked == 0


def test_keys_tell_parts_apart(spark):
    keys = spark.range(1).select(text_key(F.lit("ab"), F.lit("c")), text_key(F.lit("a"), F.lit("bc")), text_key(F.lit("x"), F.lit(None).cast("string")), text_key(F.lit("abc"))).first()
    assert keys[2] is None and len({bytes(keys[i]) for i in (0, 1, 3)}) == 3


def test_only_unanswered_prompts_are_sent(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i % 10}") for i in range(30)] + [(99, None)], "id int, user string")
    sent, broken = spark.sparkContext.accumulator(0), {"p3", "p8"}

    def rule(system, user, down=broken):
        sent.add(1)
        if user in down:
            raise OSError("busy")
        return None if user == "p5" else user.upper()

    def run(down, **more):
        return judge.answered(rows, "user", "s", lambda: judge.StubClient(lambda s, u: rule(s, u, down)), "out", store=store, calls=QUIET, error="why", **more)

    store = KeyedStore(spark, str(tmp_path / "answers"), "string")
    first = run(broken).collect()
    assert sent.value == 8 + 2 * 2 and len(first) == 31  # a failing prompt is tried twice
    assert {(r["user"], r["out"], r["why"]) for r in first if r["out"] is None} == {("p3", None, "OSError('busy')"), ("p8", None, "OSError('busy')"), ("p5", None, "no answer"), (None, None, None)}
    second = run(set()).collect()
    assert sent.value == 12 + 3 and {r["user"] for r in second if r["out"] is None} == {"p5", None}
    run(set(), temperature=0.1).collect()
    assert sent.value == 15 + 10  # other parameters, other answers


def test_a_run_that_dies_is_taken_up(spark, tmp_path):
    store, sent = KeyedStore(spark, str(tmp_path / "a"), "string"), spark.sparkContext.accumulator(0)
    rows = spark.range(40).select("id", F.concat(F.lit("p"), "id").alias("user"))

    def make(die):
        def rule(system, user):
            sent.add(1)
            if die and sent_here.append(user) is None and len(sent_here) > 2:
                raise SystemExit(1)
            return user

        sent_here = []
        return judge.StubClient(rule)

    with pytest.raises(Exception):  # noqa: B017
        judge.answered(rows, "user", "s", lambda: make(True), "out", store=store, calls=judge.Calls(per_part=1_000_000))
    assert store.read().count() == 0  # nothing half written
    judge.answered(rows.where("id < 10"), "user", "s", lambda: make(False), "out", store=store, calls=QUIET)
    before = sent.value
    out = judge.answered(rows, "user", "s", lambda: make(False), "out", store=store, calls=QUIET)
    assert sent.value - before == 30 and out.where("out = user").count() == 40


def table(spark):
    rows = [("s1", "Why a?", "a", "b", "c", "d", "a"), ("s1", "Why b?", "a", "", "c", "d", "B"), ("s2", None, "a", None, "c", "d", "c"), ("s9", "Lost?", "a", "b", "c", "d", "x")]
    return spark.createDataFrame(rows, io.MCQS), spark.createDataFrame([("s1", "f", "one two three"), ("s2", "f", "four")], io.SHEETS)


def services(spark, path, fail, count, ratio=lambda a, b: len(a) / len(b)):
    def rule(system, user):
        count.add(1)
        if fail:
            raise TimeoutError
        return "4"

    return ev.Services(
        make_client=lambda: judge.StubClient(rule), answers=KeyedStore(spark, f"{path}/a", "string"), calls=QUIET, make_encoder=lambda: Counting(count), vectors=KeyedStore(spark, f"{path}/v", VECTOR),
        custom=(ev.CustomMetric("ratio", ("option_a", "option_b"), "double", ratio),),
    )


def test_errors_cost_cells_and_are_made_anew(spark, tmp_path):
    mcqs, sheets = table(spark)
    count = spark.sparkContext.accumulator(0)
    config = MetricConfig(relevance=True, ambiguity=True, distractors_quality=True, answerability=True, names={"distractors_quality": "distractor_quality"})
    first = hot.stored(ev.complete(mcqs, sheets, config, services(spark, tmp_path, True, count)))
    got = {(r["id"], r["question"]): r for r in first.collect()}
    assert first.columns[7:] == ["readability", "starts_with_negation", "is_question", "originality", "relevance", "ambiguity", "gpt_answer", "distractor_quality", "ratio", "errors"] or set(first.columns[7:]) == {"originality", "readability", "starts_with_negation", "is_question", "relevance", "ambiguity", "gpt_answer", "distractor_quality", "ratio", "errors"}
    errors = {k: r["errors"] for k, r in got.items()}
    both = {"gpt_answer": "TimeoutError()", "distractor_quality": "TimeoutError()"}
    assert errors["s1", "Why a?"] == both
    assert errors["s1", "Why b?"] == both | {"ratio": "ZeroDivisionError('division by zero')"}
    assert set(errors["s2", None]) == {"gpt_answer", "distractor_quality", "ratio", "relevance", "ambiguity"} and errors["s2", None]["relevance"] == "no question"
    assert errors["s9", "Lost?"] == both | {"relevance": "no sheet"} and got["s9", "Lost?"]["ambiguity"] == 0.0
    assert got["s9", "Lost?"]["originality"] is None and got["s1", "Why a?"]["relevance"] > 0.5
    count.value = 0
    second = hot.stored(ev.complete(first, sheets, config, services(spark, tmp_path, False, count, lambda a, b: -1.0)))
    again = {(r["id"], r["question"]): r for r in second.collect()}
    assert count.value == 8  # two prompts for each of four rows, and no text for the encoder
    assert again["s1", "Why a?"]["distractor_quality"] == "4" and again["s1", "Why a?"]["errors"] == {}
    assert again["s1", "Why a?"]["ratio"] == 1.0 and again["s1", "Why b?"]["ratio"] == -1.0
    assert set(again["s2", None]["errors"]) == {"relevance", "ambiguity"} and set(second.columns) == set(first.columns)
    with pytest.raises(ValueError):
        ev.complete(mcqs, sheets, config)


def test_a_run_over_files_and_its_repair(spark, tmp_path):
    mcqs, sheets = table(spark)
    io.write_csv(mcqs, str(tmp_path / "mcqs"))
    io.write_csv(sheets, str(tmp_path / "sheets"))
    count = spark.sparkContext.accumulator(0)
    config = MetricConfig(relevance=True, distractors_quality=True, names={"distractors_quality": "distractor_quality"})
    at = lambda name: str(tmp_path / name)
    flows.evaluation_run(spark, at("sheets"), at("mcqs"), at("one"), config, services=services(spark, tmp_path, True, count))
    flows.evaluation_run(spark, at("sheets"), at("one"), at("two"), config, services=services(spark, tmp_path, False, count), earlier=True)
    rows = io.read_csv(spark, at("two"), flows.result_schema(config, services(spark, tmp_path, False, count)).replace("`distractor_quality` string", "distractor_quality int"))
    got = {(r["id"], r["question"]): r for r in rows.collect()}
    assert [r["distractor_quality"] for r in got.values()] == [4] * 4  # as preference data reads it, without a rename
    assert got["s1", "Why a?"]["errors"] is None and "relevance" in got["s9", "Lost?"]["errors"]


def test_both_ways_of_originality_agree_without_a_sheet(spark):
    mcqs, sheets = table(spark)
    config = MetricConfig(readability=False, negation=False, is_question=False)
    joined = mcqs.join(sheets.select("id", "content_gpt"), "id", "left")
    one = ev.evaluate(joined, config).select("id", "question", "originality")
    two = ev.evaluate(mcqs, config, sheets).select("id", "question", "originality")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_sheets_are_met_by_keys(spark, tmp_path):
    """Sheets without an MCQ are not encoded, of several texts of an id the smallest one is, and texts are not written but where they are to be encoded."""
    calls = spark.sparkContext.accumulator(0)
    mcqs = spark.createDataFrame([("1", "one two", *"abcd", "a"), (None, "one", *"abcd", "a"), ("4", "one", *"abcd", "a")], io.MCQS)
    sheets = spark.createDataFrame([("1", "f", "zz zz"), ("1", "f", "one two"), ("1", "f", None), (None, "f", "one"), ("9", "f", "unused text"), ("4", "f", None)], io.SHEETS)
    config = MetricConfig(originality=False, readability=False, negation=False, is_question=False, relevance=True)
    services = ev.Services(make_encoder=lambda: Counting(calls), vectors=KeyedStore(spark, str(tmp_path / "v"), VECTOR))
    got = {r["id"]: (r["relevance"], r[ev.ERRORS]) for r in ev.complete(mcqs, sheets, config, services).collect()}
    assert got["1"][0] == pytest.approx(1) and got[None][0] == pytest.approx(1) and got["4"] == (None, {"relevance": "no sheet"}) and calls.value == 2
