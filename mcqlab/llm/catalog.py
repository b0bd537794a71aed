"""Queries of the numbered operators, and SQL where they have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mcqlab.llm import collocations, filter_audit, fingerprint, language_id, media, order_minhash, packing, quality, sentence_pieces, suffix_dedup, token_counts, url_filter, vector_links
from mcqlab.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filtered(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_url_filter that SQL can express."""
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.graded(docs, model, with_text=False)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    model = language_id.fitted(docs.where(~F.col("held_out")))
    return language_id.predicted(docs.drop("lang"), model, with_text=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs.withColumn("prompt", packing.prompt_length(F.col("text"))), prompt="prompt")


def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.linked(table(spark, sf_dir, "embeddings"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op11_fingerprint that SQL can express."""
    rows = fingerprint.edits(table(spark, sf_dir, "documents")).where("NOT guest")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(filter_audit.failure_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (url_rules, edited_texts, op1_url_filter, op2_quality, op3_order_minhash, op4_language_id, op5_token_counts, op6_suffix_dedup, op7_sentence_pieces, op8_packing, op9_vector_links, op10_media, op11_fingerprint, op12_collocations, op13_filter_audit)}
#: The others train models, sketch, or write formats that SQL lacks; they are tested against brute force.
SQL: dict[str, str] = {
    "url_rules": """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path FROM h)
SELECT page_id, host, path, CASE
  WHEN concat('.', host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN concat('.', host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN concat('.', host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN concat('.', host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN concat('.', host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
FROM p
""",
    "op9_vector_links": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98e0),
r AS (SELECT a n, a c FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT n, min(c) c FROM r GROUP BY n), k AS (SELECT a, count(*) k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON n = vec_id LEFT JOIN k ON a = vec_id
""",
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') t, length(coalesce(text, '')) n FROM documents),
e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id, t), first(t) OVER (ORDER BY doc_id, t)) nxt FROM d)
SELECT doc_id, n::bigint AS n_chars, sha256(concat(substr(t, 1, n - n // 2), substr(nxt, 1, n // 2))) AS edited_sha256 FROM e
""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) s FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::hugeint total FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n, string_split(phrase, ' ') ws FROM f WHERE k > 1 AND n >= 100),
i AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') phrase, n FROM (SELECT lang, n, ws, m, unnest(range(1, k - m + 2)) i FROM c CROSS JOIN (SELECT unnest([2, 3, 4]) m) WHERE m < k)),
x AS (SELECT lang, phrase, max(n) longer FROM i GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, k)) cut FROM c LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * n),
s AS (SELECT k.lang, k.phrase, k.n a, cut, l.n l, r.n r, total n, (1000::hugeint * k.n * total) // (l.n::hugeint * r.n) score FROM k JOIN t USING (lang)
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM b QUALIFY rank <= 2000
""",
    "op13_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
d AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') w, min(doc_id) OVER (PARTITION BY t) low FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN low < doc_id THEN 16 ELSE 0 END failed FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, failed, count(*) n, sum(good) good, sum(toxic) toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 4, 8, 16]) b),
o AS (SELECT concat(p.c, q.c, r.c, s.c, u.c) filter_order, [p.b, q.b, r.b, s.b, u.b] bs FROM x p JOIN x q ON p.b <> q.b JOIN x r ON r.b NOT IN (p.b, q.b) JOIN x s ON s.b NOT IN (p.b, q.b, r.b) JOIN x u ON u.b NOT IN (p.b, q.b, r.b, s.b)),
s AS (SELECT filter_order, step, bs[step] b, coalesce(list_sum(bs[1:step - 1]), 0) done FROM o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) step)),
r AS (SELECT part, filter_order, step, b, sum(n) FILTER (failed::int & (done + b)::int = 0) kept, sum(n) FILTER (failed::int & b <> 0 AND failed::int & done::int = 0) removed,
  sum(n) FILTER (failed::int & b <> 0 AND failed::int & done::int <> 0) redundant, sum(n) FILTER (failed = b) unique_fails,
  sum(good) FILTER (failed::int & b <> 0 AND failed::int & done::int = 0) good_lost, sum(toxic) FILTER (failed::int & b <> 0 AND failed::int & done::int = 0) toxic_lost
  FROM m CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
  coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, (coalesce(sum(removed) OVER (PARTITION BY part, b), 0))::bigint AS shapley FROM r
""",
}
