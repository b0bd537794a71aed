"""Lemmas, positions in files, whole groups held out, tolerant JSON: against plain Python."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mcqlab.config import MetricConfig
from mcqlab.functions import jsonmcq
from mcqlab.operators.lemmas import NOUN_ENDINGS, Lexicon, lemmatized
from mcqlab.operators.split import frame_sample, group_split
from mcqlab.plans import evaluate as ev
from mcqlab.plans import flows
from mcqlab.sources import io, rows
from tests.test_golden import values

WORDS = ["mouse", "dog", "bus", "buses", "wolf", "box", "quiz", "church", "dish", "man", "baby", "glass", "s", "axis", "ax", "axe"]
EXCEPTIONS = [("mice", "mouse"), ("axes", "axis"), ("axes", "ax"), ("axes", "axe"), ("oxen", "ox")]


def brute_lemma(form):
    named = sorted({m for f, m in EXCEPTIONS if f == form})
    tried = [form, *(named or [form[: -len(e)] + r for e, r in NOUN_ENDINGS if form.endswith(e) and len(form) > len(e)])]
    found = [c for c in tried if c in WORDS]
    return min(found, key=len) if found else form


@pytest.mark.parametrize("limit", [100_000, 0])
def test_lemmas(spark, limit):
    forms = ["mice", "dogs", "bus", "buses", "wolves", "boxes", "quizes", "churches", "dishes", "men", "babies", "glass", "glasses", "s", "axes", "oxen", "unknowns", "Dogs", "men"]
    rng = random.Random(3)
    texts = [[rng.choice(forms) for _ in range(rng.randrange(40))] for _ in range(30)] + [["dogs"] * 3000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "k int, w array<string>")
    lexicon = Lexicon(spark.createDataFrame([(w,) for w in WORDS * 2], "word string"), spark.createDataFrame(EXCEPTIONS + EXCEPTIONS[:1], "form string, lemma string"))
    got = {r["k"]: r["w"] for r in lemmatized(frame, "k", "w", lexicon, limit).collect()}
    assert got == {i: [brute_lemma(f) for f in t] for i, t in enumerate(texts)} | {99: None}


def test_originality_over_lemmas(spark):
    mcqs = spark.createDataFrame([("a", "Mice chase dogs daily"), ("a", "dogs"), ("b", "mouse chase dog"), (None, "mouse chase dog"), ("a", None)], "id string, question string")
    sheets = spark.createDataFrame([("a", "f", "mouse chase dog weekly"), (None, "f", "men mice oxen"), ("c", "f", None)], io.SHEETS)
    lexicon = Lexicon(spark.createDataFrame([(w,) for w in WORDS], "word string"), spark.createDataFrame(EXCEPTIONS, "form string, lemma string"))
    config = MetricConfig(readability=False, negation=False, is_question=False)
    got = {(r["id"], r["question"]): r["originality"] for r in ev.evaluate(mcqs, config, sheets, lexicon).collect()}
    assert got == {("a", "Mice chase dogs daily"): 0.5, ("a", "dogs"): 0.0, ("b", "mouse chase dog"): None, (None, "mouse chase dog"): 1.0, ("a", None): None}


def test_positions_at_any_parallelism(spark, tmp_path):
    want, out = [], []
    for name in ("b", "a", "c"):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [f"{name}{i}" for i in range({"a": 700, "b": 3, "c": 400}[name])]
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(["v", *lines, ""]))
    for name in "abc":
        want += [x for x in (tmp_path / "in" / f"{name}.csv").read_text().split()[1:]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", "1m", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            scan = spark.read.schema("v string").option("header", True).csv(str(tmp_path / "in"))
            parts = scan.rdd.getNumPartitions()
            out.append(parts)
            got = {r["row_id"]: r["v"] for r in rows.numbered(scan).collect()}
            assert got == dict(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert out[0] > 10
    numbers = rows.numbered(spark.read.schema("v string").option("header", True).csv(str(tmp_path / "in")))
    changed = rows.put(numbers, "v", {0: F.lit("first"), 1102: F.lit(None)})
    assert [r["v"] for r in rows.in_file_order(rows.head(changed, 3)).collect()] == ["first", "a1", "a2"]
    table = spark.createDataFrame([(1, "one"), (2, None), (9999, "nowhere")], "row_id long, v string")
    assert [r["v"] for r in rows.in_file_order(rows.head(rows.put_all(changed, "v", table), 4)).collect()] == ["first", "one", None, "a3"]
    assert changed.where("v IS NULL").select("row_id").collect()[0][0] == 1102 and numbers.count() == 1103


def test_positions_of_records_with_line_breaks(spark, tmp_path):
    table = spark.createDataFrame([(f"i{k}", "f", f"line\n{k}\n\"q\"") for k in range(25)], io.SHEETS).repartition(4)
    io.write_csv(table, str(tmp_path / "csv"))
    got = rows.numbered_csv(spark, str(tmp_path / "csv"), io.SHEETS).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(25)) and len({r["id"] for r in got}) == 25 and got[0]["content_gpt"].startswith("line\n")
    io.write_csv(table.where("false"), str(tmp_path / "none"))
    assert rows.numbered_csv(spark, str(tmp_path / "none"), io.SHEETS).count() == 0


@pytest.mark.parametrize(("key", "later"), [("spark.sql.leafNodeDefaultParallelism", "1"), ("spark.sql.files.maxPartitionBytes", "100b")])
def test_positions_stay_when_a_later_scan_would_be_split_otherwise(spark, tmp_path, key, later):
    for name, n in (("b", 700), ("a", 3), ("c", 400)):
        (tmp_path / f"{name}.csv").write_text("\n".join(["v", *(f"{name}{i}" for i in range(n)), ""]))
    scan = spark.read.schema("v string").option("header", True).csv(str(tmp_path))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        numbers = rows.numbered(scan)
        spark.conf.set(key, later)
        assert [r["v"] for r in numbers.orderBy("row_id").collect()] == [f"{name}{i}" for name, n in (("a", 3), ("b", 700), ("c", 400)) for i in range(n)]
        assert sorted(r["row_id"] for r in numbers.collect()) == list(range(1103))
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", ["file_row_numbers", "put_by_position", "csv_roundtrip"])
def test_values_that_csv_would_change(spark, tmp_path, name):
    import pyarrow as pa
    from pyarrow import parquet

    from mcqlab.plans import catalog
    from tests.oracle import check

    odd = ["", None, "~", "~0", "~~1", "a~0", "\0", "a\0\"", "\0\"\n", "~\0~1", '"', '""', "\n", "\r", " ", ",", "a\r\n"]
    table = {"doc_id": [*range(len(odd)), None], "text": [*odd, "last"], "source": [*odd[::-1], ""]}
    parquet.write_table(pa.table(table), tmp_path / "documents.parquet")
    assert check(spark, str(tmp_path), catalog.QUERIES[name], catalog.SQL[name]) == len(odd) + 1


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.77, 1.0])
def test_whole_groups(spark, share):
    rng = random.Random(11)
    sizes = {f"g{i}": rng.randrange(1, 60) for i in range(40)} | {"big": 500}
    table = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)] + [(None,)] * 9, "g string")
    got = group_split(table, "g", share).groupBy("g", "held_out").count().collect()
    assert len(got) == len(sizes) + 1 and not [r for r in got if r["g"] is None and r["held_out"]]
    held, total = sum(r["count"] for r in got if r["held_out"]), sum(sizes.values())
    assert abs(held - share * total) <= 250
    assert group_split(table.where("false"), "g", share).count() == 0


GOOD = {f: "x" for f in jsonmcq.FIELDS}


def test_objects_in_answers(spark):
    hard = json.dumps(GOOD | {"question": 'a "quoted" {brace} \\ and \\" more'})
    given = [hard, f"```json\n{hard}\n```", f"So {hard} and {{more}}", hard[:-1], hard[:-2], hard[:-1] + " ,", '{"a": {"b": "}"}} tail', "no object", "}{", "", None, '{"a": "x\\', '"quoted { first" then {"b": 1}']
    got = values(spark, jsonmcq.found_object, given)
    assert [json.loads(x) for x in got[:6]] == [json.loads(hard)] * 6
    assert got[6:] == ['{"a": {"b": "}"}}', None, "{}", None, None, '{"a": "x"}', '{ first" then {"b": 1}"}']
    mcqs = values(spark, jsonmcq.tolerant_mcq, [*given[:6], json.dumps([GOOD]), '{"question": 1}'])
    assert all(m["question"] == json.loads(hard)["question"] for m in mcqs[:6]) and mcqs[6]["option_a"] == "x" and mcqs[7] is None


def test_long_answers_take_linear_steps(spark):
    text = json.dumps(GOOD | {"question": 'word "x" ' * 3000})
    assert json.loads(values(spark, jsonmcq.found_object, ["see " + text])[0])["question"].startswith("word")


def test_format_instructions():
    told = jsonmcq.format_instructions(flows.MCQ_SCHEMA)
    assert told.count("required") == 6 and all(f'"{f}"' in told for f in jsonmcq.FIELDS)


#: Golden positions of samples of 5 with seed 42.
GOLDEN = {5: [0, 1, 2, 3, 4], 10: [0, 1, 5, 7, 8]}


@pytest.mark.parametrize(("n", "size"), [(5, 5), (10, 5), (1000, 100), (3210, 200), (1, 1), (0, 3), (7, 99)])
def test_samples_of_usual_data_frames(spark, n, size):
    import pandas as pd

    got = frame_sample(spark.range(n).withColumnRenamed("id", "row_id").repartition(3), lambda k: size)
    held = sorted(r["row_id"] for r in got.where("held_out").collect())
    assert held == sorted(pd.DataFrame({"x": range(n)}).sample(min(n, size), random_state=42).index) and got.count() == n
    if GOLDEN.get(n):
        assert held == GOLDEN[n]


def test_too_many_positions(spark, monkeypatch):
    from mcqlab.operators import split

    monkeypatch.setattr(split, "MOST_POSITIONS", 10)
    with pytest.raises(ValueError):
        frame_sample(spark.range(11).withColumnRenamed("id", "row_id"), lambda k: 1)


def test_files_grow_in_number_not_in_size(spark, sf_dir, monkeypatch):
    from urllib.parse import urlparse

    from mcqlab.plans import catalog

    monkeypatch.setattr(catalog, "FILE_BYTES", 10_000, raising=False)
    at = Path(urlparse(catalog._sorted_csv(spark, sf_dir)).path)
    assert max(f.stat().st_size for f in at.glob("*.csv")) < 60_000
    got = catalog.file_row_numbers(spark, sf_dir)
    assert [r["id"] for r in got.orderBy("row_id").collect()] == [str(r["doc_id"]) for r in io.table(spark, sf_dir, "documents").orderBy("doc_id").collect()]


def test_lemmas_leave_tokens_in_their_rows(spark, monkeypatch):
    """What is stored on the way are the forms that change, not the tokens."""
    from urllib.parse import urlparse

    from mcqlab.operators import lemmas

    sizes, stored = [], lemmas.stored

    def watched(df, *by):
        out = stored(df, *by)
        sizes.append(sum(f.stat().st_size for f in Path(urlparse(out._stored_at).path).rglob("*.parquet")))
        return out

    monkeypatch.setattr(lemmas, "stored", watched)
    rng = random.Random(8)
    texts = [[f"{rng.randrange(10**9)}x" for _ in range(5000)] + ["dogs"] for _ in range(4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, w array<string>")
    lexicon = Lexicon(spark.createDataFrame([("dog",)], "word string"), spark.createDataFrame([], "form string, lemma string"))
    got = {r["k"]: r["w"] for r in lemmatized(frame, "k", "w", lexicon).collect()}
    assert got == {i: [*t[:-1], "dog"] for i, t in enumerate(texts)} and sum(sizes) < 20_000
