"""Hand-derived values, properties and plans."""

import time

import pytest
from pyspark.sql import functions as F

from mcqlab import fixtures as fx
from mcqlab.config import McqColumns, MetricConfig
from mcqlab.functions import jsonmcq, prompts, text, vector
from mcqlab.operators import judge, prefs, relational
from mcqlab.operators.split import split
from mcqlab.plans import evaluate as ev
from mcqlab.plans import flows
from mcqlab.plans.catalog import QUERIES
from mcqlab.sources import io
from mcqlab.streaming.evaluate import evaluated_stream, write_stream


def values(spark, f, inputs):
    frame = spark.createDataFrame(list(enumerate(inputs)), "i int, t string")
    return [r["v"] for r in frame.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_negation(spark):
    given = ["No, x", "don't do", "Nothing", "noé", "don’t", "  NOT a", None]
    assert values(spark, text.starts_with_negation, given) == [True, True, False, False, False, True, None]


def test_question(spark):
    given = ["Which one?", "Which one", "why not", "Whatever", "Is it", "ok? ", None]
    assert values(spark, text.is_question, given) == [True, False, True, False, False, True, None]


def test_readability(spark):
    got = values(spark, text.readability, ["What is the cat?", "No stop", "", "...", None])
    assert got[0] == pytest.approx(-2.23) and got[3] == pytest.approx(0.39 / 3 + 11.8 - 15.59)
    assert got[1] is got[2] is got[4] is None


def test_syllables(spark):
    assert values(spark, text.syllable_count, ["beautiful", "rhythm", "tsk", "Été"]) == [3, 1, 1, 1]


def test_originality(spark):
    rows = [("alpha beta gamma delta", "alpha beta gamma omega"), ("a b c d", "a b c d"), ("alpha beta", "x"), ("", "")]
    frame = spark.createDataFrame(rows, "q string, s string")
    grams = [text.trigrams(text.clean_tokens(F.col(c))) for c in "qs"]
    assert [r[0] for r in frame.select(text.originality(*grams)).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_long_texts_take_linear_time(spark):
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    frame = spark.createDataFrame([(words, words + " tail end")], "q string, s string")
    grams = [text.trigrams(text.clean_tokens(F.col(c))) for c in "qs"]
    began = time.perf_counter()
    assert frame.select(text.originality(*grams)).first()[0] == 0.0
    long = spark.range(1).select(vector.l2_normalize(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("double"))).alias("v"))
    assert long.select(F.size("v")).first()[0] == 20_000
    assert time.perf_counter() - began < 20


def test_lemmas_and_stopwords(spark):
    lemmas = F.create_map(F.lit("mice"), F.lit("mouse"))
    assert values(spark, lambda t: text.clean_tokens(t, ["the"], lemmas), ["The mice_x, mice!"]) == [["mice_x", "mouse"]]


def test_scores(spark):
    assert values(spark, text.parse_score, ["4", " 3 ", "True", None, "99999999999", "+2"]) == [4, 3, 0, 0, 0, 2]
    assert values(spark, lambda t: text.length_score(t, 2, 4), ["a b", "a", "a b c d e f g h", None]) == [1.0, 0.25, 0.25, None]


def test_rubric_and_id(spark):
    assert values(spark, lambda t: text.extract_rubric(t), ["x\nRubrique: one  two\nmore Rubrique \n", "none"]) == ["one two more Rubrique", ""]
    assert values(spark, text.sheet_id, ["abcdefghijklmnop"]) == ["abcdefghijkl"]


def test_prompts(spark):
    c = McqColumns()
    row = spark.createDataFrame([("i", "q", "A", None, "C", "D", "b", "ctx")], "id string, question string, option_a string, option_b string, option_c string, option_d string, correct_option string, content_gpt string")
    whole = row.select(prompts.judge_prompt(c, context=c.context)).first()[0]
    assert whole == "Context:\n-----\nctx\n-----\n-----\nQuestion:\nq\nOptions:\na) A\nb) nan\nc) C\nd) D\nCorrect option: b\n-----\n"
    assert row.select(prompts.judge_prompt(c, options=False, correct=False)).first()[0] == "-----\nQuestion:\nq\n-----\n"
    assert row.select(prompts.mcq_text(c)).first()[0] == "Question: q\na) A\nb) nan\nc) C\nd) D"


def test_ambiguity_key(spark):
    frame = spark.createDataFrame([("B",), ("e",), ("a)",), (" a",)], "k string").withColumns({f"v{m}": F.array(F.lit(1.0), F.lit(float(i))) for i, m in enumerate("abcd")})
    got = [r[0] for r in frame.select(vector.ambiguity([F.col(f"v{m}") for m in "abcd"], F.col("k"))).collect()]
    assert got[0] > 0.7 and got[1:] == [0.0, 0.0, 0.0]


def test_json(spark):
    good = "{" + ", ".join(f'"{f}": "x"' for f in jsonmcq.FIELDS) + ', "extra": 1}'
    bad = [good.replace('"x"', "1", 1), good.replace('"x"', "null", 1), "{}", "bad", good + " x", f"[{good}]", good + "," + good, None]
    assert [v is not None for v in values(spark, jsonmcq.validated_mcq, [good, *bad])] == [True] + [False] * len(bad)


def test_pairs_and_completions(spark):
    rows = spark.createDataFrame([(f"m{k}", i, q, 3 * i + k) for i, qs in enumerate([(3, 2, 1), (3, 3, 3), (1, None, 2)]) for k, q in enumerate(qs)], "dataset string, id long, distractor_quality int, row_id long")
    assert sorted(map(tuple, prefs.dpo_pairs(rows, 3).collect())) == [(0, "m0", "m1"), (0, "m0", "m2")]
    stats = prefs.pair_stats(rows, 3).first()
    assert (stats["n_ids"], stats["nb_good_only"], stats["nb_bad_only"], stats["nb_mixed"], stats["n_pairs"]) == (3, 1, 1, 1, 2)
    assert prefs.pair_stats(rows.where("false"), 3).first()["pct_mixed"] is None
    assert prefs.last_wins(rows.union(rows.selectExpr("dataset", "id", "9", "row_id + 100")), ["dataset", "id"]).where("distractor_quality <> 9").count() == 0
    pairs = spark.createDataFrame([("1", "same", "same", "a", "b")], io.PAIRS)
    assert [tuple(r) for r in prefs.kto_dedup(prefs.kto_unpivot(pairs)).collect()] == [("1", "same", True, "a")]
    classes = {r["id"]: r["quality_class"] for r in prefs.quality_partition(rows.where("dataset = 'm1'")).collect()}
    assert classes == {0: "bad", 1: "good", 2: "bad"}


@pytest.mark.parametrize(("n", "rule", "want"), [(25, lambda n: min(n // 10, 200), 2), (5000, lambda n: min(n // 10, 200), 200), (9, lambda n: int(n * 0.2), 1), (10, lambda n: -(-3 * n // 10), 3), (0, lambda n: 3, 0), (4, lambda n: 9, 4)])
def test_split_sizes(spark, n, rule, want):
    out = split(spark.range(n).repartition(3), "id", rule)
    assert (out.where("held_out").count(), out.count()) == (want, n)


def test_joins(spark):
    sheets = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "n")], "id string, content_gpt string")
    mcqs = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    got = {r["id"]: r["content_gpt"] for r in relational.left_join_context(mcqs, sheets).collect()}
    assert got == {"a": "1", "b": None, None: "n"} and relational.left_join_context(mcqs, sheets).count() == 3
    assert relational.semi_join_sheets(sheets, mcqs).count() == 3
    with pytest.raises(ValueError):
        relational.left_join_context(mcqs.limit(1), sheets, strict_lengths=True)
    with pytest.raises(ValueError):
        relational.left_join_context(sheets, sheets)


def test_judges_and_retries(spark):
    frame = spark.createDataFrame([(1, "p"), (2, "p"), (3, "fail"), (4, None)], "id int, user string")
    calls = spark.sparkContext.accumulator(0)

    def rule(system, user):
        calls.add(1)
        if user == "fail":
            raise OSError
        return f"{system}:{user}"

    got = {r["id"]: r["out"] for r in judge.answered(frame, "user", "s", lambda: judge.StubClient(rule), "out").collect()}
    assert got == {1: "s:p", 2: "s:p", 3: None, 4: None}
    assert judge.ReplayClient({"a": "b"}).complete("", "a") == "b"
    seeds = spark.createDataFrame([(1, "a"), (2, "b")], "id int, seed string")
    out = judge.generated_with_retry(seeds, lambda s, k: f"{s}{k}", lambda t: 3 if t == "a2" else 0, 2, 3).collect()
    assert [tuple(r) for r in out] == [(1, 2, "a2", 3)]


def test_generation(spark):
    import json

    good = json.dumps({f: "x" for f in jsonmcq.FIELDS})

    def make():
        def generate(prompt, temperature, schema):
            if temperature == 0.7:
                raise OSError
            return good if temperature == 0.1 and schema["required"] == list(jsonmcq.FIELDS) and "sheet" in prompt else "no JSON"

        return generate

    rows = flows.generated(spark.createDataFrame([("a", "sheet one"), ("b", None)], "id string, content_gpt string"), make).collect()
    assert sorted((r["id"], r["temperature"], r["question"]) for r in rows) == [("a", 0.1, "x"), ("a", 0.5, ""), ("a", 0.7, ""), ("b", 0.1, ""), ("b", 0.5, ""), ("b", 0.7, "")]


def test_run_from_env(spark, tmp_path, monkeypatch):
    io.write_csv(spark.createDataFrame([("s1", "f", "alpha beta gamma omega"), ("s2", "f", "unused")], io.SHEETS), str(tmp_path / "sheets"))
    mcq = ("s1", "Alpha beta gamma deltas?", "o1", "o2", "o3", "o4", "a")
    io.write_csv(spark.createDataFrame([mcq, ("s1", "No alpha beta", *mcq[2:])], io.MCQS), str(tmp_path / "mcqs"))
    for k in ("SHEETS", "MCQS", "OUTPUT"):
        monkeypatch.delenv(f"MCQLAB_{k}", raising=False)
    with pytest.raises(ValueError):
        flows.run_from_env(spark)
    for k, name in (("SHEETS", "sheets"), ("MCQS", "mcqs"), ("OUTPUT", "out")):
        monkeypatch.setenv(f"MCQLAB_{k}", str(tmp_path / name))
    config = MetricConfig(difficulty=True, lemmas=(("deltas", "omega"),))
    with pytest.raises(ValueError):
        flows.run_from_env(spark, config)
    flows.run_from_env(spark, config, lambda: judge.StubClient(lambda system, user: "4"))
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted((r["originality"], r["is_question"], r["starts_with_negation"], r["difficulty"]) for r in got) == [("0.0", "false", "true", "4"), ("0.0", "true", "false", "4")]


def test_prompts_from_a_file(tmp_path):
    (tmp_path / "p.json").write_text('{"difficulty": "é"}', encoding="utf-8")
    assert io.prompts_from(str(tmp_path / "p.json")) == {"difficulty": "é"}


def test_sources(spark, tmp_path):
    for folder, name, body in (("IC 1", "IC-001-sheets.txt", "Rubrique: abc\nline\n\n"), ("B", "short", "x")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / name).write_text(body)
    got = {r["id"]: tuple(r) for r in io.scan_sheets(spark, str(tmp_path / "in")).collect()}
    assert got == {"IC-001-sheet": ("IC 1", "IC-001-sheet", "Rubrique: abc\nline", "abc"), "short": ("B", "short", "x", "")}
    rows = [("1", 'a "q", b\n c ', ""), ("2", None, " x")]
    io.write_single_csv(spark.createDataFrame(rows, io.SHEETS), str(tmp_path / "csv"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "csv"), io.SHEETS).collect())) == [(*rows[0][:2], None), rows[1]]
    (tmp_path / "f.json").write_text('["a", "b"]')
    assert [r[0] for r in io.folder_list(spark, str(tmp_path / "f.json")).collect()] == ["a", "b"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    mcqs = fx.mcq(spark, sf_dir)
    mcqs.write.parquet(str(tmp_path / "in"))
    config = MetricConfig(originality=False)
    write_stream(evaluated_stream(spark, str(tmp_path / "in"), mcqs.schema, config), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(ev.evaluate(mcqs, config)).count() == 0


def test_plans(spark, sf_dir):
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for name in ("mcq_rule_metrics", "readability", "dpo_pairs_text", "kto_dataset", "relevance", "validate_mcq_json"):
        assert not any(x in plan(name) for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name
    assert "Exchange" not in plan("mcq_rule_metrics")
    assert "ReadSchema: struct<doc_id:bigint>" in plan("dpo_pairs")


def test_rows_do_not_depend_on_partitions(spark, sf_dir):
    rows = fx.scored_log(spark, sf_dir)
    a, b = (prefs.last_wins(rows.repartition(k), ["dataset", "id"]) for k in (1, 7))
    assert a.exceptAll(b).count() == 0
