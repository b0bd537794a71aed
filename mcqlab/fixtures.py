"""MCQ-shaped views over the driver's tables, for queries, tests and benchmarks.

``*_sql`` are the same views in DuckDB's dialect.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.functions.jsonmcq import FIELDS
from mcqlab.sources.io import table

N_DATASETS = 3
DIMENSIONS = 12

_MCQ = """
WITH p AS (SELECT doc_id, source, text, filter(split(text, r'[.\\n]+'), x -> trim(x) <> '') s FROM {documents})
SELECT doc_id id,
  concat(CASE doc_id % 11 WHEN 3 THEN 'No ' WHEN 5 THEN 'What ' WHEN 7 THEN 'Nothing ' ELSE '' END,
         coalesce(trim(try_element_at(s,1)),''), CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '.' END) question,
  coalesce(trim(try_element_at(s,2)),'') option_a, coalesce(trim(try_element_at(s,3)),'') option_b,
  coalesce(trim(try_element_at(s,4)),'') option_c, coalesce(trim(try_element_at(s,5)),'') option_d,
  substr('aBcDe', cast(doc_id % 5 AS int) + 1, 1) correct_option, source folder, text content_gpt
FROM p
"""
MCQ_SQL = """
mcq AS (SELECT doc_id id,
  concat(CASE doc_id % 11 WHEN 3 THEN 'No ' WHEN 5 THEN 'What ' WHEN 7 THEN 'Nothing ' ELSE '' END,
         coalesce(trim(s[1]),''), CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '.' END) question,
  coalesce(trim(s[2]),'') option_a, coalesce(trim(s[3]),'') option_b,
  coalesce(trim(s[4]),'') option_c, coalesce(trim(s[5]),'') option_d,
  substr('aBcDe', (doc_id % 5)::int + 1, 1) correct_option, source folder, text content_gpt
FROM (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text,'[.\\n]+'), lambda x: trim(x) <> '') s FROM documents))
"""
SCORED_SQL = """
scored AS (SELECT concat('m', k) dataset, doc_id id, 1 + cast(floor(doc_id / power(5,k)) AS bigint) % 5 distractor_quality
FROM documents CROSS JOIN (SELECT 0 k UNION ALL SELECT 1 UNION ALL SELECT 2) z WHERE doc_id % 13 <> k)
"""
#: Each (dataset, id) once, and for one id in ten a later row with another score.
LOG_SQL = """
log AS (SELECT dataset, id, distractor_quality, id * 10 row_id FROM scored
UNION ALL SELECT dataset, id, CASE WHEN id % 20 = 0 THEN NULL ELSE 6 - distractor_quality END, id * 10 + 1 FROM scored WHERE id % 10 = 0)
"""
#: Scores of regenerations: three and more attempts for each id.
RETRY_SQL = """
retry AS (SELECT doc_id id, k attempt, CAST((doc_id * 7 + k * 3) % 5 AS int) score
FROM documents CROSS JOIN (SELECT 1 k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) z)
"""


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MCQ, documents=table(spark, sf_dir, "documents"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("folder"), F.col("text").alias("content_gpt"))


def _view(spark: SparkSession, sf_dir: str, sql: str, last: str) -> DataFrame:
    # the few constants are exploded, not joined
    sql = re.sub(r"CROSS JOIN \(SELECT (\d) k((?: UNION ALL SELECT \d)+)\) z", lambda m: f"LATERAL VIEW explode(array({', '.join(re.findall(r'[0-9]', m[0]))})) z AS k", sql)
    return spark.sql(f"WITH documents AS (SELECT doc_id FROM {{d}}), {sql} SELECT * FROM {last}", d=table(spark, sf_dir, "documents"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SCORED_SQL, "scored")


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, f"{SCORED_SQL}, {LOG_SQL}", "log")


def retry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RETRY_SQL, "retry")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions (dataset, id, completion): each generator words an MCQ in its own way, some share a wording."""
    m = mcq(spark, sf_dir)
    from mcqlab.config import McqColumns
    from mcqlab.functions.prompts import mcq_text

    own = m.select("id", mcq_text(McqColumns()).alias("_t"))
    return own.select("id", F.explode(F.array(*(F.lit(f"m{k}") for k in range(N_DATASETS)))).alias("dataset"), "_t").select(
        "dataset", "id", F.when(F.col("id") % 4 == 0, F.col("_t")).otherwise(F.concat("_t", F.lit("\n#"), "dataset")).alias("completion")
    )


MCQ_TEXT = "concat('Question: ', question, chr(10), 'a) ', option_a, chr(10), 'b) ', option_b, chr(10), 'c) ', option_c, chr(10), 'd) ', option_d)"
TEXTS_SQL = f"""
texts AS (SELECT dataset, id, CASE WHEN id % 4 = 0 THEN t ELSE concat(t, chr(10), '#', dataset) END completion
FROM (SELECT id, {MCQ_TEXT} t FROM mcq) CROSS JOIN (SELECT 'm0' dataset UNION ALL SELECT 'm1' UNION ALL SELECT 'm2') z)
"""


def mcq_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, folder, raw): an MCQ as JSON, for some ids invalid in one of several ways."""
    whole = F.to_json(F.struct(*FIELDS))
    bad = F.col("id") % 17
    raw = (
        F.when(bad == 1, F.lit('{"question": 1}')).when(bad == 2, F.lit("{}")).when(bad == 3, F.lit("bad")).when(bad == 4, F.concat(whole, F.lit(" x")))
        .when(bad == 5, F.lit('["q"]')).when(bad == 6, F.regexp_replace(whole, '"option_d":', '"other":')).when(bad == 7, F.lit(None)).otherwise(whole)
    )
    return mcq(spark, sf_dir).select("id", "folder", raw.alias("raw"))


MCQ_JSON_SQL = """
mcq_json AS (SELECT id, folder, CASE id % 17 WHEN 1 THEN '{"question": 1}' WHEN 2 THEN '{}' WHEN 3 THEN 'bad' WHEN 4 THEN concat(j, ' x')
  WHEN 5 THEN '["q"]' WHEN 6 THEN replace(j, '"option_d":', '"other":') WHEN 7 THEN NULL ELSE j END raw
FROM (SELECT id, folder, json_object('question', question, 'option_a', option_a, 'option_b', option_b, 'option_c', option_c, 'option_d', option_d, 'correct_option', correct_option)::varchar j FROM mcq))
"""


def vectors(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("question", "sheet", "option_a", "option_b", "option_c", "option_d")) -> DataFrame:
    """MCQs (id, correct_option) with the named of their vectors (question, sheet, options), dealt from the embeddings table."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    out = mcq(spark, sf_dir).select("id", "correct_option")
    ids = {"question_vec": F.col("id"), "sheet_vec": 7 * F.col("id") + 3} | {f"option_{m}_vec": 4 * F.col("id") + k for k, m in enumerate("abcd")}
    for name, key in ((f"{n}_vec", ids[f"{n}_vec"]) for n in names):
        out = out.withColumn("_k", F.pmod(key, F.lit(n))).join(e.select(F.col("vec_id").alias("_k"), F.col("embedding").alias(name)), "_k").drop("_k")
    return out


class LengthEncoder:
    """An encoder that SQL can follow: a token is the length of a word, a vector the counts of lengths modulo DIMENSIONS, one special token in front."""

    special = 1

    def tokens(self, texts: list[str]) -> list[list[int]]:
        return [[len(w) for w in t.split()] for t in texts]

    def encode(self, tokens: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(tokens), DIMENSIONS))
        for row, ids in zip(out, tokens, strict=True):
            np.add.at(row, np.array([0, *ids]) % DIMENSIONS, 1)
        return out


def encoded_sql(name: str, text: str, words: str, max_tokens: int) -> str:
    """The vectors of distinct texts as ``name`` (t, e); words: the list of words of t."""
    counts = ", ".join(f"len(list_filter(l, lambda x: x % {DIMENSIONS} = {i})){' + 1' if i == 0 else ''}" for i in range(DIMENSIONS))
    return f"""
{name} AS (SELECT t, list_transform(c, lambda x: (x / sqrt(list_sum(list_transform(c, lambda y: y * y))::double))::float) e
FROM (SELECT t, [{counts}]::double[] c FROM (SELECT t, list_transform(({words})[1:{max_tokens - 1}], lambda w: length(w)) l FROM (SELECT DISTINCT t FROM ({text}) WHERE t IS NOT NULL))))
"""


VECTORS_SQL = """
n AS (SELECT count(*) n FROM embeddings),
vectors AS (SELECT id, correct_option, q.embedding question_vec, s.embedding sheet_vec, a.embedding option_a_vec, b.embedding option_b_vec, c.embedding option_c_vec, d.embedding option_d_vec
FROM mcq CROSS JOIN n JOIN embeddings q ON q.vec_id = id % n JOIN embeddings s ON s.vec_id = (7*id+3) % n JOIN embeddings a ON a.vec_id = (4*id) % n
JOIN embeddings b ON b.vec_id = (4*id+1) % n JOIN embeddings c ON c.vec_id = (4*id+2) % n JOIN embeddings d ON d.vec_id = (4*id+3) % n)
"""
