"""Every query by name, and its SQL for DuckDB."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab import fixtures as fx
from mcqlab.config import ACCEPT_MIN, EVAL_FRACTION, MAX_ATTEMPTS, PAIR_EVAL_MAX, PAIR_EVAL_SHARE, QUALITY_THRESHOLD, STOPWORDS, TEST_FRACTION, McqColumns, MetricConfig
from mcqlab.functions import jsonmcq, prompts, text, vector
from mcqlab.operators import judge, prefs, relational
from mcqlab.operators.encode import VECTOR
from mcqlab.operators.hot import stored
from mcqlab.operators.lemmas import NOUN_ENDINGS, Lexicon, lemmatized
from mcqlab.operators.split import group_split, order_hash, split
from mcqlab.operators.store import KeyedStore
from mcqlab.plans import evaluate as ev
from mcqlab.plans import flows
from mcqlab.session import shared_dir
from mcqlab.sources import io
from mcqlab.sources import rows as file_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = McqColumns()
TEXTS = ("folder", "content_gpt")  # of sheets
HELD_FOLDERS = ("src1", "src4", "src7", "src11", "src16")
STOP = STOPWORDS
LENGTH_BOUNDS = (8, 20)


def query(sql: str, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# DuckDB's spelling of the functions of mcqlab.functions.text
def _of(template: str, value: str) -> str:
    return template.replace("{0}", value)


SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
STRIP = "regexp_replace({0}, '^" + SP + "+|" + SP + "+$', '', 'g')"
WORDS = "list_filter(regexp_split_to_array({0}, '" + SP + "+'), lambda w: w <> '')"


def _opens(x: str, ws) -> str:
    return f"regexp_matches({_of(STRIP, x)}, '(?i)^({'|'.join(w.replace(chr(39), chr(39) * 2) for w in ws)})($|[^\\p{{L}}\\p{{N}}_])')"


NEGATION = _opens("question", text.NEGATIONS)
QUESTION = f"({_of(STRIP, 'question')} LIKE '%?' OR {_opens('question', text.QUESTION_WORDS)})"
SYLLABLES = "greatest(1, len(regexp_extract_all(lower({0}), '[aeiouy]+')))"


def _readability(x: str) -> str:
    w, s = f"len({_of(WORDS, x)})", f"(length({x}) - length(translate({x}, '.!?', '')))"
    y = f"list_sum(list_transform({_of(WORDS, x)}, lambda w: {_of(SYLLABLES, 'w')}))"
    return f"CASE WHEN {w} > 0 AND {s} > 0 THEN 0.39e0 * ({w}::double / {s}) + 11.8e0 * ({y}::double / {w}) - 15.59e0 END"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(trim(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), ' +'), lambda w: w <> '' AND w NOT IN ({_list(STOP)}))"


def _grams(t: str) -> str:
    return f"CASE WHEN len({t}) >= 3 THEN list_distinct(list_transform(range(1, len({t}) - 1), lambda i: concat({t}[i], ' ', {t}[i+1], ' ', {t}[i+2]))) ELSE [] END"


M = f"WITH {fx.MCQ_SQL}"
GRAMS = f"{M}, t AS (SELECT *, {_tokens('question')} qt, {_tokens('content_gpt')} st FROM mcq), g AS (SELECT *, {_grams('qt')} qg, {_grams('st')} sg FROM t)"
ORIGINALITY = "CASE WHEN len(qg) = 0 THEN 0e0 ELSE len(list_filter(qg, lambda x: NOT list_contains(sg, x)))::double / len(qg) END"


@query(f"{M} SELECT id, {NEGATION} starts_with_negation FROM mcq")
def starts_with_negation(spark, sf_dir):
    return fx.mcq(spark, sf_dir).select("id", text.starts_with_negation(F.col("question")).alias("starts_with_negation"))


@query(f"{M} SELECT id, {QUESTION} is_question FROM mcq")
def is_question(spark, sf_dir):
    return fx.mcq(spark, sf_dir).select("id", text.is_question(F.col("question")).alias("is_question"))


@query(f"SELECT doc_id AS id, {_readability('text')} AS readability FROM documents")
def readability(spark, sf_dir):
    return fx.sheets(spark, sf_dir).select("id", text.readability(F.col("content_gpt")).alias("readability"))


@query(f"SELECT w AS word, count(*) AS n, max({_of(SYLLABLES, 'w')})::bigint AS syllables FROM (SELECT unnest({_of(WORDS, 'text')}) w FROM documents) GROUP BY w")
def syllable_count(spark, sf_dir):
    w = fx.sheets(spark, sf_dir).select(F.explode(text.words(F.col("content_gpt"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", text.syllable_count(F.col("word")).cast("bigint").alias("syllables"))


@query(f"{M} SELECT id, array_to_string({_tokens('question')}, ' ') AS tokens, array_to_string({_tokens('content_gpt')}, ' ') AS sheet_tokens FROM mcq")
def clean_tokens(spark, sf_dir):
    joined = lambda c: F.array_join(text.clean_tokens(F.col(c), STOP), " ")
    return fx.mcq(spark, sf_dir).select("id", joined("question").alias("tokens"), joined("content_gpt").alias("sheet_tokens"))


@query(f"{GRAMS} SELECT id, len(qg)::bigint AS n_trigrams, len(sg)::bigint AS n_sheet_trigrams, array_to_string(list_sort(qg), '|') AS trigrams FROM g")
def trigrams(spark, sf_dir):
    g, sheet = (text.trigrams(text.clean_tokens(F.col(c), STOP)) for c in ("question", "content_gpt"))
    return fx.mcq(spark, sf_dir).select("id", F.size(sheet).cast("bigint").alias("n_sheet_trigrams"), F.size(g).cast("bigint").alias("n_trigrams"), F.array_join(F.array_sort(g), "|").alias("trigrams"))


@query(f"{GRAMS} SELECT id, {ORIGINALITY} AS originality FROM g")
def originality(spark, sf_dir):
    own = fx.mcq(spark, sf_dir).select("id", "question")
    return ev.originality(own, fx.sheets(spark, sf_dir), MetricConfig(stopwords=STOP)).select("id", "originality")


@query(f"{M}, w AS (SELECT id, len({_of(WORDS, 'question')})::double n FROM mcq) SELECT id, CASE WHEN n > 20 THEN power(20/n, 2) WHEN n < 8 THEN power(n/8, 2) ELSE 1e0 END AS length_score FROM w")
def length_score(spark, sf_dir):
    return fx.mcq(spark, sf_dir).select("id", text.length_score(F.col("question"), *LENGTH_BOUNDS).alias("length_score"))


@query(f"{GRAMS} SELECT id, {ORIGINALITY} AS originality, {_readability('question')} AS readability, {NEGATION} AS starts_with_negation, {QUESTION} AS is_question FROM g")
def mcq_rule_metrics(spark, sf_dir):
    return ev.evaluate(fx.mcq(spark, sf_dir), MetricConfig(stopwords=STOP)).select("id", "originality", "readability", "starts_with_negation", "is_question")


@query(f"{M} SELECT id, {fx.MCQ_TEXT} AS mcq_text FROM mcq")
def mcq_text(spark, sf_dir):
    return fx.mcq(spark, sf_dir).select("id", prompts.mcq_text(C).alias("mcq_text"))


def _judge_query(metric: str, column: str) -> None:
    options = "" if metric == "disclosure" else "'Options:', chr(10), 'a) ', option_a, chr(10), 'b) ', option_b, chr(10), 'c) ', option_c, chr(10), 'd) ', option_d, chr(10),"
    correct = "" if metric == "answerability" else "'Correct option: ', correct_option, chr(10),"
    context = "'Context:', chr(10), '-----', chr(10), content_gpt, chr(10), '-----', chr(10)," if metric == "answerability" else ""
    sql = f"{M} SELECT id, concat({context} '-----', chr(10), 'Question:', chr(10), question, chr(10), {options} {correct} '-----', chr(10)) AS prompt FROM mcq"

    def run(spark, sf_dir):
        config = MetricConfig(answerability=True, disclosure=True, difficulty=True, distractors_quality=True)
        return fx.mcq(spark, sf_dir).select("id", ev.judge_prompts(config)[column][1].alias("prompt"))

    query(sql, f"render_prompt_{'distractors' if metric == 'distractors_quality' else metric}")(run)


for _metric, _column in (("answerability", "gpt_answer"), ("disclosure", "disclosure"), ("difficulty", "difficulty"), ("distractors_quality", "distractors_quality")):
    _judge_query(_metric, _column)


@query(f"SELECT doc_id AS id, concat('{prompts.GENERATION_PREFIX}', text, '{prompts.GENERATION_SUFFIX}') AS prompt FROM documents")
def render_generation_prompt(spark, sf_dir):
    return fx.sheets(spark, sf_dir).select("id", prompts.generation_prompt(F.col("content_gpt")).alias("prompt"))


@query("SELECT doc_id AS id, CASE doc_id % 6 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 3 THEN 0 ELSE (doc_id % 5)::int END AS score FROM documents")
def parse_score(spark, sf_dir):
    s = (F.col("id") % 5).cast("string")
    answer = F.when(F.col("id") % 6 == 4, F.lit(None)).when(F.col("id") % 6 == 5, F.lit("True")).when(F.col("id") % 6 == 3, F.concat(s, F.lit(".5")))
    answer = answer.when(F.col("id") % 6 == 2, F.concat(F.lit(" \t"), s, F.lit("\n"))).otherwise(s)
    return fx.sheets(spark, sf_dir).select("id", text.parse_score(answer).alias("score"))


_INDEX = "(('0x' || substr(md5(concat('42:', {0})), 1, 8))::bigint % 5)"


@query(f"SELECT doc_id AS id, [{_list(prompts.USER_PROMPTS)}][1 + {_INDEX.format('doc_id')}] AS prompt FROM documents")
def assign_prompt(spark, sf_dir):
    return fx.sheets(spark, sf_dir).select("id", prompts.assigned_prompt(F.col("id")).alias("prompt"))


@query("SELECT doc_id AS id, substr(concat(source, '_', lang, '_', doc_id, '.txt'), 1, 12) AS sheet_id FROM documents")
def sheet_id_prefix(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("_"), F.col("doc_id"), F.lit(".txt"))
    return io.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.sheet_id(name).alias("sheet_id"))


_RUBRIC = _of(STRIP, "regexp_replace(substr(array_to_string(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'License')), chr(10)), 11), '[ \\t\\n]+', ' ', 'g')")


@query(f"SELECT doc_id AS id, {_RUBRIC} AS rubric FROM documents")
def extract_rubric(spark, sf_dir):
    return fx.sheets(spark, sf_dir).select("id", text.extract_rubric(F.col("content_gpt"), "License").alias("rubric"))


@query("SELECT doc_id::varchar AS id, source AS folder, text AS content_gpt FROM documents")
def csv_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    io.write_csv(io.escaped(fx.sheets(spark, sf_dir).select(F.col("id").cast("string"), "folder", "content_gpt"), *TEXTS), path)
    return io.unescaped(io.read_csv(spark, path, io.SHEETS), *TEXTS)


@query(f"WITH {fx.SCORED_SQL} SELECT doc_id AS id, source AS folder FROM documents WHERE doc_id IN (SELECT id FROM scored WHERE dataset = 'm0' AND distractor_quality > 2)")
def semi_join_sheets(spark, sf_dir):
    own = fx.scored(spark, sf_dir).where("dataset = 'm0' AND distractor_quality > 2")
    return relational.semi_join_sheets(fx.sheets(spark, sf_dir), own).select("id", "folder")


@query(f"WITH {fx.SCORED_SQL} SELECT dataset, id, distractor_quality, text AS content_gpt FROM scored LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') ON doc_id = id")
def left_join_context(spark, sf_dir):
    own = io.table(spark, sf_dir, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.col("text").alias("content_gpt"))
    return relational.left_join_context(fx.scored(spark, sf_dir), own)


@query(f"SELECT doc_id AS id, source AS folder FROM documents WHERE source IN ({_list(HELD_FOLDERS)})")
def filter_test_folders(spark, sf_dir):
    folders = spark.createDataFrame([(f,) for f in HELD_FOLDERS], "folder string")
    return relational.in_folders(fx.sheets(spark, sf_dir), folders).select("id", "folder")


S = f"WITH {fx.SCORED_SQL}"
L = f"{S}, {fx.LOG_SQL}, last AS (SELECT dataset, id, distractor_quality, row_id FROM log QUALIFY row_number() OVER (PARTITION BY dataset, id ORDER BY row_id DESC) = 1)"
N, T = fx.N_DATASETS, QUALITY_THRESHOLD


def _last(spark, sf_dir):
    return prefs.last_wins(fx.scored_log(spark, sf_dir), ["dataset", "id"])


@query(f"{L} SELECT dataset, id, distractor_quality, row_id FROM last")
def dedup_last_wins(spark, sf_dir):
    return _last(spark, sf_dir)


@query(f"{S} SELECT id FROM scored GROUP BY id HAVING count(DISTINCT dataset) = {N}")
def common_ids(spark, sf_dir):
    return prefs.common_ids(fx.scored(spark, sf_dir), N)


@query(f"{L} SELECT dataset, id, CASE WHEN coalesce(distractor_quality > {T}, false) THEN 'good' ELSE 'bad' END AS quality_class FROM last")
def quality_partition(spark, sf_dir):
    return prefs.quality_partition(_last(spark, sf_dir))


@query(f"{L} SELECT dataset, distractor_quality, count(*) AS n FROM last WHERE distractor_quality IS NOT NULL GROUP BY ALL")
def quality_distribution(spark, sf_dir):
    return prefs.quality_distribution(_last(spark, sf_dir))


_G = f"coalesce(distractor_quality > {T}, false)"


@query(f"{L} SELECT id, coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER ({_G}), '') AS good_sources, coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER (NOT {_G}), '') AS bad_sources FROM last GROUP BY id")
def sources_by_quality(spark, sf_dir):
    own = prefs.sources_by_quality(_last(spark, sf_dir))
    return own.select("id", F.array_join("good_sources", ",").alias("good_sources"), F.array_join("bad_sources", ",").alias("bad_sources"))


_CLASSES = f"k AS (SELECT id, count(*) FILTER ({_G}) g, count(*) FILTER (NOT {_G}) b FROM scored GROUP BY id HAVING count(DISTINCT dataset) = {N})"


@query(
    f"{S}, {_CLASSES} SELECT count(*) AS n_ids, count(*) FILTER (b = 0) AS nb_good_only, count(*) FILTER (g = 0) AS nb_bad_only, count(*) FILTER (g > 0 AND b > 0) AS nb_mixed, coalesce(sum(g * b), 0)::bigint AS n_pairs, "
    "count(*) FILTER (b = 0) * 100e0 / count(*) AS pct_good_only, count(*) FILTER (g = 0) * 100e0 / count(*) AS pct_bad_only, count(*) FILTER (g > 0 AND b > 0) * 100e0 / count(*) AS pct_mixed FROM k"
)
def pair_stats(spark, sf_dir):
    return prefs.pair_stats(fx.scored(spark, sf_dir), N)


@query(f"{M}, {fx.SCORED_SQL}, {fx.TEXTS_SQL}, {_CLASSES} SELECT id, 'm0' AS seed_source, completion FROM k JOIN texts USING (id) WHERE g = 0 AND dataset = 'm0'")
def seed_question_for_bad_only(spark, sf_dir):
    return prefs.bad_only_seed(fx.scored(spark, sf_dir).join(fx.texts(spark, sf_dir), ["dataset", "id"]), N, "completion")


_PAIRS = f"pairs AS (SELECT a.id, a.dataset chosen_source, b.dataset rejected_source FROM scored a JOIN scored b USING (id) JOIN k USING (id) WHERE a.distractor_quality > {T} AND NOT b.distractor_quality > {T})"
_TEXT_PAIRS = "tp AS (SELECT id, c.completion chosen, r.completion rejected, chosen_source, rejected_source FROM pairs JOIN texts c ON c.id = pairs.id AND c.dataset = chosen_source JOIN texts r ON r.id = pairs.id AND r.dataset = rejected_source)".replace("SELECT id,", "SELECT pairs.id,")
P = f"{S}, {_CLASSES}, {_PAIRS}"
TP = f"{M}, {fx.SCORED_SQL}, {_CLASSES}, {_PAIRS}, {fx.TEXTS_SQL}, {_TEXT_PAIRS}"
KTO = f"{TP}, kto AS (SELECT id, chosen completion, true label, chosen_source source FROM tp UNION ALL SELECT id, rejected, false, rejected_source FROM tp)"
DEDUP = f"{KTO}, dd AS (SELECT * FROM kto QUALIFY row_number() OVER (PARTITION BY completion ORDER BY label DESC, id, source) = 1)"


def _pairs(spark, sf_dir):
    return prefs.dpo_pairs(fx.scored(spark, sf_dir), N)


def _text_pairs(spark, sf_dir):
    return prefs.with_texts(_pairs(spark, sf_dir), fx.texts(spark, sf_dir))


@query(f"{P} SELECT id, chosen_source, rejected_source FROM pairs")
def dpo_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"{TP} SELECT * FROM tp")
def dpo_pairs_text(spark, sf_dir):
    return _text_pairs(spark, sf_dir)


@query(f"{KTO} SELECT * FROM kto")
def kto_unpivot(spark, sf_dir):
    return prefs.kto_unpivot(_text_pairs(spark, sf_dir))


@query(f"{DEDUP} SELECT * FROM dd")
def kto_dedup(spark, sf_dir):
    return prefs.kto_dedup(prefs.kto_unpivot(_text_pairs(spark, sf_dir)))


@query(f"{KTO} SELECT count(*) AS n_rows, count(DISTINCT completion) AS n_completions, count(*) FILTER (label) AS n_desirable, count(*) FILTER (NOT label) AS n_undesirable FROM kto")
def kto_counts(spark, sf_dir):
    return prefs.kto_counts(prefs.kto_unpivot(_text_pairs(spark, sf_dir)))


@query("SELECT doc_id AS id, md5(concat('42:', doc_id)) AS shuffle_key FROM documents ORDER BY 2, 1")
def kto_shuffle(spark, sf_dir):
    return fx.sheets(spark, sf_dir).select("id", order_hash("id").alias("shuffle_key")).orderBy("shuffle_key", "id")


@query(f"{DEDUP} SELECT completion, label, source, md5(concat('42:', completion)) AS shuffle_key FROM dd")
def kto_dataset(spark, sf_dir):
    rows = prefs.kto_dedup(prefs.kto_unpivot(_text_pairs(spark, sf_dir)))
    return rows.select("completion", "label", "source", order_hash("completion").alias("shuffle_key")).orderBy("shuffle_key", "completion")


def _held(rows: str, key: str, n: str) -> str:
    return f"SELECT {key} AS key, row_number() OVER (ORDER BY md5(concat('42:', {key})), {key}) <= (SELECT {n} FROM {rows}) AS held_out FROM {rows}"


@query(f"{P}, keyed AS (SELECT concat(id, ':', chosen_source, ':', rejected_source) k FROM pairs) " + _held("keyed", "k", f"least(count(*) // {PAIR_EVAL_SHARE}, {PAIR_EVAL_MAX})"))
def split_pairs(spark, sf_dir):
    keyed = _pairs(spark, sf_dir).select(F.concat_ws(":", F.col("id").cast("string"), "chosen_source", "rejected_source").alias("key"))
    return split(keyed, "key", lambda n: min(n // PAIR_EVAL_SHARE, PAIR_EVAL_MAX))


@query(_held("documents", "doc_id", f"floor(count(*) * {EVAL_FRACTION}::double)"))
def train_eval_split(spark, sf_dir):
    return split(fx.sheets(spark, sf_dir).select(F.col("id").alias("key")), "key", lambda n: int(n * EVAL_FRACTION))


@query(_held("documents", "doc_id", f"ceil(count(*) * {TEST_FRACTION}::double)"))
def train_test_split(spark, sf_dir):
    return split(fx.sheets(spark, sf_dir).select(F.col("id").alias("key")), "key", lambda n: math.ceil(n * TEST_FRACTION))


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double), lambda m, n: m + n)"


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})) END"


V = f"{M}, {fx.VECTORS_SQL}"


@query(f"SELECT vec_id, i - 1 AS pos, embedding[i]::double / sqrt({_dot('embedding', 'embedding')}) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) i FROM embeddings)")
def l2_normalize(spark, sf_dir):
    e = io.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.l2_normalize(F.col("embedding"))).alias("pos", "value"))
    return e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "value")


@query(f"{V} SELECT id, {_cos('question_vec', 'sheet_vec')} AS relevance FROM vectors")
def relevance(spark, sf_dir):
    return fx.vectors(spark, sf_dir, ("question", "sheet")).select("id", vector.cosine(F.col("question_vec"), F.col("sheet_vec")).alias("relevance"))


def _mean(key: str) -> str:
    return _mean_of({o: f"option_{o}_vec" for o in "abcd"}, key)


def _mean_of(vectors: dict, key: str) -> str:
    return "(" + " + ".join(f"({_cos(vectors[key], v)})" for o, v in vectors.items() if o != key) + ") / 3e0"


@query(f"{V} SELECT id, CASE lower(correct_option) {' '.join(f"WHEN '{k}' THEN {_mean(k)}" for k in 'abcd')} ELSE 0e0 END AS ambiguity FROM vectors")
def ambiguity(spark, sf_dir):
    return fx.vectors(spark, sf_dir, tuple(f"option_{o}" for o in "abcd")).select("id", vector.ambiguity([F.col(f"option_{o}_vec") for o in "abcd"], F.col("correct_option")).alias("ambiguity"))


_VALID = "json_valid(raw) AND json_type(raw) = 'OBJECT' AND " + " AND ".join(f"json_type(raw, '$.{f}') = 'VARCHAR'" for f in jsonmcq.FIELDS)
_PARSED = ", ".join(f"CASE WHEN ok THEN json_extract_string(raw, '$.{f}') END AS {f}" for f in jsonmcq.FIELDS)
J = f"{M}, {fx.MCQ_JSON_SQL}, v AS (SELECT id, folder, CASE WHEN json_valid(raw) THEN raw END raw, CASE WHEN json_valid(raw) THEN coalesce({_VALID}, false) ELSE false END ok FROM mcq_json)"


def _valid(spark, sf_dir):
    return fx.mcq_json(spark, sf_dir).select("id", "folder", jsonmcq.validated_mcq(F.col("raw")).alias("mcq"))


@query(f"{J} SELECT id, ok AS valid, {_PARSED} FROM v")
def validate_mcq_json(spark, sf_dir):
    return _valid(spark, sf_dir).select("id", F.col("mcq").isNotNull().alias("valid"), "mcq.*")


@query(f"{J} SELECT id FROM v WHERE NOT ok")
def invalid_mcq_rows(spark, sf_dir):
    return relational.null_rows(_valid(spark, sf_dir), "mcq")


_PATCHED = ", ".join(f"CASE WHEN ok THEN json_extract_string(raw, '$.{f}') ELSE '' END AS {f}" for f in jsonmcq.FIELDS)


@query(f"{J} SELECT id, {_PATCHED} FROM v")
def patch_empty_mcq(spark, sf_dir):
    return relational.flattened(relational.patched(_valid(spark, sf_dir), "mcq", jsonmcq.empty_mcq()), "mcq")


@query(f"{J} SELECT id, {_PARSED} FROM v WHERE ok")
def flatten_mcq(spark, sf_dir):
    return relational.flattened(_valid(spark, sf_dir).where(F.col("mcq").isNotNull()), "mcq")


@query(f"{J} SELECT id, t AS temperature, {_PATCHED} FROM v CROSS JOIN (SELECT unnest([0.1e0, 0.5e0, 0.7e0]) t) z WHERE folder IN ({_list(HELD_FOLDERS)})")
def generation_flow(spark, sf_dir):
    """Sheets of the held-out folders, three temperatures, recorded answers as the generator, validated, patched, flattened."""
    folders = spark.createDataFrame([(f,) for f in HELD_FOLDERS], "folder string")
    raw = relational.in_folders(fx.mcq_json(spark, sf_dir), folders)
    return flows.flattened_answers(raw.select("id", "raw", F.explode(F.array(*map(F.lit, flows.TEMPERATURES))).alias("temperature")))


@query(f"WITH {fx.RETRY_SQL} SELECT id, min(attempt) AS attempt, min_by(score, attempt) AS score FROM retry WHERE attempt <= {MAX_ATTEMPTS} AND score >= {ACCEPT_MIN} GROUP BY id")
def retry_accept(spark, sf_dir):
    return prefs.accepted_attempt(fx.retry_scores(spark, sf_dir), ACCEPT_MIN, MAX_ATTEMPTS)


_GEN = f"gen AS (SELECT id, min(attempt) attempt FROM retry JOIN k USING (id) WHERE g = 0 AND attempt <= {MAX_ATTEMPTS} AND score >= {ACCEPT_MIN} GROUP BY id)"
FULL = f"{M}, {fx.SCORED_SQL}, {fx.TEXTS_SQL}, {fx.RETRY_SQL}, {_CLASSES}, {_PAIRS}, {_TEXT_PAIRS}, {_GEN}"
_MADE = "SELECT gen.id, concat(s.completion, chr(10), 'attempt ', attempt) chosen, t.completion rejected, 'generated' chosen_source, t.dataset rejected_source FROM gen JOIN texts s ON s.id = gen.id AND s.dataset = 'm0' JOIN texts t ON t.id = gen.id JOIN scored b ON b.id = gen.id AND b.dataset = t.dataset"


def _made(spark, sf_dir):
    """What the recorded regenerations gave: the seed's text with the number of the attempt."""
    seeds = prefs.bad_only_seed(fx.scored(spark, sf_dir).join(fx.texts(spark, sf_dir), ["dataset", "id"]), N, "completion")
    accepted = prefs.accepted_attempt(fx.retry_scores(spark, sf_dir), ACCEPT_MIN, MAX_ATTEMPTS)
    return seeds.join(accepted, "id").select("id", F.concat("completion", F.lit("\nattempt "), F.col("attempt").cast("string")).alias("completion"))


@query(f"{FULL} SELECT * FROM tp UNION ALL {_MADE}")
def dpo_builder(spark, sf_dir):
    """All pairs of the data sets, and accepted regenerations against the bad MCQs of ids without a good one."""
    return flows.preference_pairs(fx.scored(spark, sf_dir), fx.texts(spark, sf_dir), _made(spark, sf_dir), N)


@query(f"{FULL} SELECT (SELECT count(*) FROM k WHERE b = 0) AS nb_good_only, (SELECT count(*) FROM k WHERE g = 0) AS nb_bad_only, (SELECT count(*) FROM gen) AS nb_generated, (SELECT count(*) FROM tp) + (SELECT count(*) FROM ({_MADE})) AS n_pairs")
def dpo_builder_stats(spark, sf_dir):
    scored, made = fx.scored(spark, sf_dir), _made(spark, sf_dir)
    return flows.builder_stats(scored, made, N)


@query(f"{DEDUP}, h AS ({_held('dd', 'completion', f'floor(count(*) * {EVAL_FRACTION}::double)')}) SELECT completion, label, source, [{_list(prompts.USER_PROMPTS)}][1 + {_INDEX.format('completion')}] AS prompt, held_out FROM dd JOIN h ON key = completion")
def training_prep(spark, sf_dir):
    """Labelled completions with a prompt each and the held-out part, from a parquet table."""
    rows = prefs.kto_dedup(prefs.kto_unpivot(_text_pairs(spark, sf_dir))).drop("id")
    path = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    return flows.training_set(rows, "completion", path)


@query(f"{GRAMS} SELECT id::varchar AS id, {ORIGINALITY} AS originality, {_readability('question')} AS readability, {NEGATION} AS starts_with_negation, {QUESTION} AS is_question FROM g")
def evaluation_run(spark, sf_dir):
    """CSV files in, metrics in a CSV folder: the whole run."""
    own = fx.mcq(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    at = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    io.write_csv(fx.sheets(spark, sf_dir).select(F.col("id").cast("string"), "folder", "content_gpt"), f"{at}/sheets")
    io.write_csv(own.select(*io.MCQS.names), f"{at}/mcqs")
    flows.evaluation_run(spark, f"{at}/sheets", f"{at}/mcqs", f"{at}/out", MetricConfig(stopwords=STOP))
    schema = "id string, question string, option_a string, option_b string, option_c string, option_d string, correct_option string, originality double, readability double, starts_with_negation boolean, is_question boolean"
    return io.read_csv(spark, f"{at}/out", schema).select("id", "originality", "readability", "starts_with_negation", "is_question")


_PROMPT = f"concat('-----', chr(10), 'Question:', chr(10), question, chr(10), 'Options:', chr(10), 'a) ', option_a, chr(10), 'b) ', option_b, chr(10), 'c) ', option_c, chr(10), 'd) ', option_d, chr(10), 'Correct option: ', correct_option, chr(10), '-----', chr(10))"


@query(f"{M} SELECT id, CASE length({_PROMPT}) % 7 WHEN 6 THEN 0 ELSE (length({_PROMPT}) % 7)::int END AS distractor_quality FROM mcq")
def score_generated(spark, sf_dir):
    """Scores of MCQs by a stub judge whose answer depends on the prompt's length and is no number for one in seven."""
    def rule(system, user):
        return "good" if len(user) % 7 == 6 else f" {len(user) % 7}\n"

    return flows.scored_generated(fx.mcq(spark, sf_dir), lambda: judge.StubClient(rule)).select("id", "distractor_quality")


# runs that call an encoder, a judge and own functions
MAX_TOKENS = 64
_RUN = "r AS (SELECT id, question q, nullif(content_gpt, '') s, correct_option, " + ", ".join(f"nullif(option_{o}, '') {o}" for o in "abcd") + " FROM mcq)"
_ENCODED = fx.encoded_sql("vec", " UNION ALL ".join(f"SELECT {x} t FROM r" for x in "qsabcd"), _of(WORDS, "t"), MAX_TOKENS)


def _csv_inputs(spark, sf_dir) -> str:
    """A folder with sheets and MCQs as CSV."""
    at = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    io.write_csv(fx.sheets(spark, sf_dir).select(F.col("id").cast("string"), "folder", "content_gpt"), f"{at}/sheets")
    io.write_csv(fx.mcq(spark, sf_dir).withColumn("id", F.col("id").cast("string")).select(*io.MCQS.names), f"{at}/mcqs")
    return at


@query(
    f"{M}, {_RUN}, {_ENCODED} SELECT id::varchar AS id, {_cos('q.e', 's.e')} AS relevance, CASE lower(correct_option) "
    + " ".join(f"WHEN '{k}' THEN {_mean_of({o: f'{o}.e' for o in 'abcd'}, k)}" for k in "abcd")
    + " ELSE 0e0 END AS ambiguity FROM r " + " ".join(f"LEFT JOIN vec {x} ON {x}.t = r.{x}" for x in "qsabcd")
)
def evaluation_run_vectors(spark, sf_dir):
    """CSV files in, relevance and ambiguity out, by an encoder whose vectors a store keeps."""
    at = _csv_inputs(spark, sf_dir)
    config = MetricConfig(originality=False, readability=False, negation=False, is_question=False, relevance=True, ambiguity=True)
    services = ev.Services(make_encoder=fx.LengthEncoder, vectors=KeyedStore(spark, f"{at}/vectors", VECTOR), max_tokens=MAX_TOKENS)
    flows.evaluation_run(spark, f"{at}/sheets", f"{at}/mcqs", f"{at}/out", config, services=services)
    return io.read_csv(spark, f"{at}/out", flows.result_schema(config, services)).select("id", "relevance", "ambiguity")


def _rating(system: str, user: str) -> str:
    """A judge that fails for every fifth length of a prompt."""
    if len(user) % 5 == 0:
        raise OSError("busy")
    return str(len(user) % 7)


def _services(spark, rule, at: str | None = None) -> ev.Services:
    ratio = ev.CustomMetric("option_ratio", ("option_a", "option_b"), "double", lambda a, b: len(a) / len(b))
    answers = KeyedStore(spark, at, "string") if at else None
    return ev.Services(make_client=lambda: judge.StubClient(rule), calls=judge.Calls(attempts=2, pause=0.0, at_once=4), answers=answers, custom=(ratio,))


_DIFFICULTY = MetricConfig(originality=False, readability=False, negation=False, is_question=True, difficulty=True, names={"difficulty": "rated"})
_FAILING = f"f AS (SELECT id, {QUESTION} is_question, length({_PROMPT}) n, length(option_a)::double a, length(option_b) b FROM mcq)"
_RATIO = "CASE WHEN b > 0 THEN a / b END AS option_ratio"


@query(f"{M}, {_FAILING} SELECT id, is_question, CASE WHEN n % 5 > 0 THEN (n % 7)::varchar END AS rated, {_RATIO}, concat_ws(',', CASE WHEN b = 0 THEN 'option_ratio' END, CASE WHEN n % 5 = 0 THEN 'rated' END) AS failed FROM f")
def evaluation_run_failures(spark, sf_dir):
    """Cells that fail are null and named in ``errors``; the others of their row stay."""
    own = fx.mcq(spark, sf_dir).drop("content_gpt")
    out = ev.complete(own, fx.sheets(spark, sf_dir), _DIFFICULTY, _services(spark, _rating))
    return out.select("id", "is_question", "rated", "option_ratio", F.array_join(F.array_sort(F.map_keys(ev.ERRORS)), ",").alias("failed"))


@query(f"{M}, {_FAILING} SELECT id, is_question, CASE WHEN n % 5 > 0 THEN (n % 7)::varchar ELSE 'late' END AS rated, {_RATIO}, CASE WHEN b = 0 THEN 'option_ratio' ELSE '' END AS failed FROM f")
def evaluation_run_again(spark, sf_dir):
    """A second run makes only the cells that failed: the answers of the first are kept, though this judge would give others."""
    own, at = fx.mcq(spark, sf_dir).drop("content_gpt"), f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    first = stored(ev.complete(own, fx.sheets(spark, sf_dir), _DIFFICULTY, _services(spark, _rating, at)))
    out = ev.complete(first, fx.sheets(spark, sf_dir), _DIFFICULTY, _services(spark, lambda system, user: "late", at))
    return out.select("id", "is_question", "rated", "option_ratio", F.array_join(F.array_sort(F.map_keys(ev.ERRORS)), ",").alias("failed"))


@query(f"{M}, {_FAILING} SELECT id, CASE WHEN n % 5 > 0 THEN (n % 7)::varchar ELSE 'late' END AS answer FROM f")
def answers_resumed(spark, sf_dir):
    """Prompts that a first judge answered are not sent to a second one."""
    own = fx.mcq(spark, sf_dir).select("id", prompts.judge_prompt(C).alias("prompt"))
    kept = KeyedStore(spark, f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}", "string")
    for rule in (_rating, lambda system, user: "late"):
        out = judge.answered(own, "prompt", "Rate.", lambda rule=rule: judge.StubClient(rule), "answer", store=kept, calls=judge.Calls(pause=0.0, at_once=4, per_part=700))
    return out.select("id", "answer")


# lemmas; the lexicon is what stands in several documents
_EXCEPTIONS = (("men", "man"), ("women", "woman"), ("ses", "se"), ("thes", "the"))
_ENDING = " UNION ALL ".join(f"SELECT '{e}' e, '{r}' r, {i} o" for i, (e, r) in enumerate(NOUN_ENDINGS, 1))


def _lemma_sql(forms: str) -> str:
    """lexicon, and lemma (form, lemma) of all of forms (form)."""
    return f"""
lexicon AS (SELECT w word FROM (SELECT doc_id, unnest(list_distinct({_tokens('text')})) w FROM documents) GROUP BY w HAVING count(*) >= 3),
exceptions AS (SELECT unnest([{_list(f for f, _ in _EXCEPTIONS)}]) form, unnest([{_list(m for _, m in _EXCEPTIONS)}]) lemma), endings AS ({_ENDING}),
forms AS (SELECT DISTINCT form FROM ({forms})),
tried AS (SELECT form, form c, 0 o FROM forms UNION ALL SELECT form, lemma, 1 FROM forms JOIN exceptions USING (form)
  UNION ALL SELECT form, concat(substr(form, 1, length(form) - length(e)), r), o FROM forms JOIN endings ON suffix(form, e) AND length(form) > length(e) WHERE form NOT IN (SELECT form FROM exceptions)),
best AS (SELECT form, arg_min(c, (length(c), o)) l FROM tried WHERE c IN (SELECT word FROM lexicon) GROUP BY form),
lemma AS (SELECT form, coalesce(l, form) lemma FROM forms LEFT JOIN best USING (form))
"""


def _lexicon(spark, sf_dir) -> Lexicon:
    tokens = fx.sheets(spark, sf_dir).select(F.explode(F.array_distinct(text.clean_tokens(F.col("content_gpt"), STOP))).alias("word"))
    words = stored(tokens.groupBy("word").count().where("count >= 3").select("word"))
    return Lexicon(words, spark.createDataFrame(list(_EXCEPTIONS), "form string, lemma string"))


@query(f"WITH t AS (SELECT doc_id, {_tokens('text')} ws FROM documents), w AS (SELECT doc_id, unnest(ws) form, unnest(range(1, len(ws) + 1)) pos FROM t), {_lemma_sql('SELECT form FROM w')} SELECT doc_id AS id, coalesce((SELECT string_agg(lemma, ' ' ORDER BY pos) FROM w JOIN lemma USING (form) WHERE w.doc_id = t.doc_id), '') AS lemmas FROM t")
def lemmatized_tokens(spark, sf_dir):
    rows = fx.sheets(spark, sf_dir).select("id", text.clean_tokens(F.col("content_gpt"), STOP).alias("w"))
    return lemmatized(rows, "id", "w", _lexicon(spark, sf_dir)).select("id", F.array_join("w", " ").alias("lemmas"))


_LEMMA_TEXTS = f"{M}, x AS (SELECT DISTINCT t FROM (SELECT question t FROM mcq UNION ALL SELECT content_gpt FROM mcq)), t AS (SELECT t, {_tokens('t')} ws FROM x), w AS (SELECT t, unnest(ws) form, unnest(range(1, len(ws) + 1)) pos FROM t)"


@query(
    f"{_LEMMA_TEXTS}, {_lemma_sql('SELECT form FROM w')}, l AS (SELECT t, list(lemma ORDER BY pos) lt FROM w JOIN lemma USING (form) GROUP BY t), g AS (SELECT t.t, {_grams('lt')} gs FROM t LEFT JOIN l USING (t)), "
    "p AS (SELECT id, coalesce(a.gs, []) qg, coalesce(b.gs, []) sg FROM mcq LEFT JOIN g a ON a.t = question LEFT JOIN g b ON b.t = content_gpt) "
    f"SELECT id, {ORIGINALITY} AS originality FROM p"
)
def originality_lemmatized(spark, sf_dir):
    """Originality over lemmas, by joins on distinct forms."""
    own = fx.mcq(spark, sf_dir).select("id", "question")
    return ev.originality(own, fx.sheets(spark, sf_dir), MetricConfig(stopwords=STOP), _lexicon(spark, sf_dir)).select("id", "originality")


# positions in files, whole groups held out, answers that are not quite JSON
LEAST_FILES, FILE_BYTES = 8, 32_000_000


def _sorted_csv(spark, sf_dir) -> str:
    """Sheets, texts escaped, in the order of their ids (null last), dealt over as many files as keep each to about FILE_BYTES, since a file with line breaks in its values is read by one task."""
    at = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    own = fx.sheets(spark, sf_dir)
    size = own.agg(F.sum(F.octet_length("content_gpt"))).first()[0] or 0
    by = F.col("id").asc_nulls_last()
    rows = own.repartitionByRange(max(LEAST_FILES, math.ceil(size / FILE_BYTES)), by).sortWithinPartitions(by)
    io.write_csv(io.escaped(rows.select(F.col("id").cast("string"), "folder", "content_gpt"), *TEXTS), at)
    return at


@query("SELECT doc_id::varchar AS id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text AS content_gpt FROM documents")
def file_row_numbers(spark, sf_dir):
    rows = file_rows.numbered_csv(spark, _sorted_csv(spark, sf_dir), io.SHEETS)
    return io.unescaped(rows, "content_gpt").select("id", "row_id", "content_gpt")


@query("SELECT doc_id::varchar AS id, row_id, CASE WHEN row_id = 7 THEN 'seventh' WHEN row_id % 10 = 3 THEN NULL ELSE source END AS folder FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 row_id FROM documents) WHERE row_id < 150")
def put_by_position(spark, sf_dir):
    """Cells replaced by position, a few of them named and others from a table; the first 150 rows."""
    rows = io.unescaped(file_rows.numbered_csv(spark, _sorted_csv(spark, sf_dir), io.SHEETS), "folder")
    some = fx.sheets(spark, sf_dir).select(F.col("id").alias("row_id"), F.lit(None).cast("string").alias("folder")).where("row_id % 10 = 3")
    out = file_rows.put_all(file_rows.put(rows, "folder", {7: F.lit("seventh")}), "folder", some)
    return file_rows.head(out, 150).select("id", "row_id", "folder")


@query(
    "WITH g AS (SELECT source, count(*) n, md5(concat('42:', source)) h FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT source, sum(n) OVER (ORDER BY h, source) total FROM g UNION ALL SELECT NULL, 0), "
    f"b AS (SELECT total FROM c ORDER BY abs(total - {TEST_FRACTION}::double * (SELECT sum(n) FROM g)), total LIMIT 1) "
    "SELECT doc_id AS id, documents.source AS folder, coalesce(c.total <= (SELECT total FROM b), false) AS held_out FROM documents LEFT JOIN c ON c.source = documents.source"
)
def folder_split(spark, sf_dir):
    """Whole folders held out, about 30 % of the rows."""
    return group_split(fx.sheets(spark, sf_dir).select("id", "folder"), "folder", TEST_FRACTION)


@query(
    f"{M}, {fx.MCQ_JSON_SQL} SELECT id, " + ", ".join(f"CASE WHEN id % 17 IN (4, 5, 7) THEN NULL ELSE {f} END AS {f}" for f in jsonmcq.FIELDS) + " FROM mcq"
)
def tolerant_mcq_json(spark, sf_dir):
    """MCQs from answers in fences, in prose, or cut off; null for what holds none."""
    whole = F.to_json(F.struct(*jsonmcq.FIELDS))
    bad = F.col("id") % 17
    raw = (
        F.when(bad == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(bad == 2, F.concat(F.lit('Sure, "here" it is:\n'), whole, F.lit("\nHope {this} helps"))).when(bad == 3, F.expr("substr(whole, 1, length(whole) - 2)"))
        .when(bad == 4, F.lit('Well: {"question": 1}')).when(bad == 5, F.lit("No idea")).when(bad == 6, F.concat(F.expr("substr(whole, 1, length(whole) - 1)"), F.lit(", \n"))).when(bad == 7, F.lit(None)).otherwise(whole)
    )
    mcqs = fx.mcq(spark, sf_dir).withColumn("whole", whole)
    return mcqs.select("id", jsonmcq.tolerant_mcq(raw).alias("mcq")).select("id", "mcq.*")
