"""Operators on Spark against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mcqlab.llm import language_id, media, order_minhash, packing, quality, sentence_pieces, suffix_dedup, token_counts, url_filter, vector_links
from mcqlab.llm import catalog as llm
from mcqlab.llm import features as ft
from mcqlab.llm.common import components, table
from tests.llm.test_small import levenshtein
from tests.oracle import check


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "One two three. " * 30, "en"), (2, None, "en"), (3, "", None), (4, "¿Qué?  ½ ▁ <|endoftext|>", "es"), (5, "A" * 9000, "xx"),
        (6, "One two three. " * 30, "en"), (6, "One two three. " * 30, "en"), (None, "no id", "en"), (7, "mail me@example.org or call +49 30 1234567 now", "en"), (8, " \n\t", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS n", "1 AS rep", "2 AS score", "3 AS a", "4 AS spans")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = []
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else None


def test_url_rules(spark, sf_dir):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y", "https://a.b.net/es/#q", "x://com", "x://com/", "x://example.com/en/", "x://net/fr/a://b", "x://ÉA.com/é?", "x://xcom/", "x://a.net?/es/", "a\nb://c.com/\nd"]
    urls += [r["url"] for r in table(spark, sf_dir, "pages").select("url").collect()]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filtered(rows).collect()}
    assert len(got) == len(urls) + 3
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert got[i]["rule"] == (rule and rule[0])
        assert got[i]["verdict"] == (rule[1] if rule else "block" if got[i]["score"] > 0.75 else "allow")
    assert url_filter.filtered(rows.where("false")).count() == 0


def test_url_model_tells_unseen_urls(spark):
    own = url_filter.labelled_urls(spark).withColumn("part", F.crc32("url") % 4)
    right = []
    for k in range(4):
        rows = url_filter.filtered(own.where(F.col("part") == k), rules=(), labelled=own.where(F.col("part") != k)).collect()
        right += [(r["score"] > 0.5) == (r["blocked"] > 0) for r in rows]
    assert len(right) == own.count() and np.mean(right) > 0.8


def test_url_scores_equal_plain_ones(spark):
    weights, intercept = url_filter.trained(url_filter.labelled_urls(spark))
    urls = [None, "", "x://", "https://Win.example.org/Go.php?x", "http://a.b/" + "long/" * 3000, "https://docs.quillstack.org/reference/string-functions"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit("mine"))
    rows = url_filter.filtered(frame).collect()
    grams = frame.select("page_id", F.explode(url_filter.grams(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))))).collect()
    for r in rows:
        own = [g[1] for g in grams if g[0] == r["page_id"]]
        parts = [(brute_rule(r["url"])[0], 3), (brute_rule(r["url"])[0], 4), (brute_rule(r["url"])[1], 3), (brute_rule(r["url"])[1], 4)]
        assert len(own) == sum(max(1, len(t) + 2 - n + 1) for t, n in parts)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(np.mean([weights[k] for k in own]) + intercept))))


def test_url_rules_equal_sql(spark):
    assert check(spark, "/root/testdata/sf0.01", llm.QUERIES["url_rules"], llm.SQL["url_rules"]) == 250


def test_packing(docs, none):
    own = Tokenizer.from_file(packing.TOKENIZER)
    rows = packing.packed(docs, with_ids=True).collect()
    assert packing.packed(none).count() == 0
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((str(k), own.encode(t, add_special_tokens=False).ids + [2]) for k, t in texts if k != 6)
    by, sequences = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by.setdefault(str(r["doc_id"]), []).append((r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted((k, sum((list(x) for _, x in sorted(v)), [])) for k, v in by.items() if k != "6") == want
    assert sum(len(x) for _, x in by["6"]) == 2 * len(own.encode("One two three. " * 30, add_special_tokens=False).ids) + 2
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0


def test_packing_of_short_texts_needs_no_padding(spark):
    texts = spark.range(5000).selectExpr("id AS doc_id", "concat('word ', id % 10, ' end end') AS text").coalesce(1)
    rows = packing.packed(texts).collect()
    lengths, parts = {}, {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
        parts[r["sequence_id"]] = parts.get(r["sequence_id"], 0) + 1
    assert all(n & (n - 1) == 0 for n in lengths.values()) and max(parts.values()) <= packing.SEGMENTS
    assert {r["doc_id"] for r in rows} == set(range(5000)) and sum(lengths.values()) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_media(docs, none):
    rows = media.media_columns(docs, with_media=True).collect()
    assert media.media_columns(none).count() == 0
    for r, d in zip(rows, docs.collect(), strict=True):
        raw = (d["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (d["doc_id"], len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert len(r["rgb"]) == 3 * r["height"] * r["width"]
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 6)}) == 1


def test_token_counts(docs, none):
    table_ = token_counts.counts(token_counts.RANKS)
    n = lambda t: len(table_.encoding.encode_ordinary(t))
    rows = token_counts.counted(docs, with_tree=True).collect()
    assert token_counts.counted(none).count() == 0
    for r, d in zip(rows, docs.collect(), strict=True):
        text = d["text"] or ""
        new = text
        for e in reversed(token_counts.found_edits(text)):
            new = new[: e["start"]] + e["text"] + new[e["end"] :]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"], r["text_edited"]) == (n(text), n(new), len(new), new)
        assert sum(r["leaf_chars"]) == len(new) and sum(r["leaf_tokens"]) == n(new)
    assert rows[8]["n_edits"] == 2
    clash = docs.selectExpr("*", "7 AS n_tokens")
    assert token_counts.counted(clash, keep=("doc_id", "n_tokens")).columns.count("n_tokens") == 1


def test_a_kept_tree_takes_a_second_batch_of_edits(spark):
    table_ = token_counts.counts(token_counts.RANKS)
    text = "call +49 30 1234567 now, then write. " * 2000
    first = token_counts.counted(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_tree=True)
    edits = "array(struct(30000 AS start, 30005 AS `end`, 'other words' AS text), null, struct(null AS start, 1 AS `end`, 'x' AS text))"
    second = token_counts.counted(first.selectExpr("doc_id", "text_edited AS text", "leaf_chars", "leaf_tokens", f"{edits} AS edits"), "edits", tree=("leaf_chars", "leaf_tokens"), with_tree=True)
    a, b = first.first(), second.first()
    want = a["text_edited"][:30000] + "other words" + a["text_edited"][30005:]
    assert b["text_edited"] == want and b["n_tokens"] == a["n_tokens_edited"]
    assert b["n_tokens_edited"] == len(table_.encoding.encode_ordinary(want)) and 0 < b["n_recounted"] < 300


def test_sentence_pieces(docs, none):
    rows = sentence_pieces.encoded(docs, with_ids=True).collect()
    assert sentence_pieces.encoded(none).count() == 0
    assert all(r["round_trip"] for r in rows)
    assert all(r["n_best_scores"] == sorted(r["n_best_scores"], reverse=True) and r["n_best_scores"][0] == r["score"] for r in rows)
    ids = sentence_pieces.encoded(docs, keep=("doc_id", "text"), with_ids=True).selectExpr("doc_id", "text AS was", "n_best_ids[0] AS ids")
    assert all(r["text"] == (r["was"] or "") for r in sentence_pieces.decoded(ids).collect())
    clash = sentence_pieces.encoded(docs.selectExpr("*", "5 AS n_ids"), keep=("doc_id", "score", "n_ids"))
    assert clash.columns.count("n_ids") == 1 and [r["n_ids"] for r in clash.collect()] == [r["n_ids"] for r in rows]


def test_language_id(spark, docs, none):
    rows = llm.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    model = language_id.fitted(docs)
    got = {r["doc_id"]: r for r in language_id.predicted(docs, model).collect()}
    assert set(model.languages) == {"en", "es", "xx"}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[8]["lang_pred"] == "und" and got[2]["score"] == 0 and got[2]["rejected"]
    assert language_id.predicted(docs, language_id.fitted(none)).where("lang_pred <> 'und'").count() == 0


def test_language_scores_equal_plain_ones(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language_id.fitted(docs)
    rows = docs.where("length(text) < 20000").limit(25).collect()
    got = {r["doc_id"]: r for r in language_id.predicted(docs, model).collect()}
    for r in rows:
        raw = r["text"].lower().encode()
        grams = [int.from_bytes(bytes([n]) + raw[i : i + n], "big") * int(ft.MIX) % 2**64 >> 64 - language_id.BITS for n in language_id.SIZES for i in range(len(raw) - n + 1)]
        z = (model.columns[:, grams].mean(1) @ model.mix + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r["doc_id"]]["lang_pred"] == model.languages[p.argmax()] and got[r["doc_id"]]["score"] == pytest.approx(p.max())


def test_many_languages_are_all_learnt():
    r = np.random.default_rng(1)
    examples = []
    for c in range(300):
        alphabet = r.choice(1 << language_id.BITS, 40, replace=False)
        for _ in range(12):
            k = np.unique(r.choice(alphabet, 25))
            examples.append((f"l{c:03}", k.astype("<u4").tobytes(), np.ones(len(k), "<u4").tobytes()))
    model = language_id.trained(examples, epochs=4)
    assert len(model.languages) == 300 and model.columns.shape == (language_id.DIMENSIONS, 1 << language_id.BITS)
    means = language_id._Bags(examples).means(np.arange(len(examples)), model.columns.T)
    right = model.probabilities(means).argmax(1) == [model.languages.index(e[0]) for e in examples]
    assert right.mean() > 0.5


def test_quality(spark, docs, none):
    d = "/root/testdata/sf0.1"
    rows = llm.QUERIES["op2_quality"](spark, d).join(table(spark, d, "labels"), "doc_id").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    poor = [r["selected"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.1
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in rows)
    model = quality.fitted(docs, spark.createDataFrame([(1, 1, None), (1, 0, 1), (7, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int"))
    assert quality.graded(docs, model).count() == docs.count() and (np.diff(model.thresholds) > 0).all()
    assert quality.graded(none, quality.fitted(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_quality_of_unseen_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels").withColumn("unseen", F.crc32(F.col("doc_id").cast("string")) % 4 == 1)
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fitted(docs, labels.where("NOT unseen"))
    rows = docs.join(labels.where("unseen"), "doc_id")
    few = rows.where("quality = 1 AND toxic = 0 AND length(text) BETWEEN 2000 AND 6000").withColumn("text", F.concat("text", F.lit(" you pathetic worthless idiot."))).withColumn("toxic", F.lit(2))
    got = quality.graded(rows.unionByName(few), model, with_text=False).collect()
    share = {k: np.mean([r["selected"] for r in got if (r["quality"], r["toxic"]) == k]) for k in ((0, 0), (1, 0), (1, 1), (1, 2))}
    print(share)
    assert share[1, 0] > 0.98 and share[1, 1] < 0.15 and share[0, 0] < 0.05
    assert share[1, 2] < 0.2  # three words of some hundreds


def test_cumulative_link_gradient():
    r = np.random.default_rng(2)
    top, n, rows = 3, 12, 40
    k, owner = r.integers(0, n, 200), np.sort(r.integers(0, rows, 200))
    v, y, weight = r.random(200), r.integers(0, top + 1, rows), r.random(rows)
    p = r.normal(size=n + top)
    args = top, k, v, owner, y, weight, 1e-3
    loss, g = quality.likelihood(p, *args)
    above = 1 / (1 + np.exp(quality.cuts(p[n:])[None] - np.bincount(owner, weights=v * p[k], minlength=rows)[:, None]))
    chance = [[1, *a, 0][c] - [1, *a, 0][c + 1] for a, c in zip(above.tolist(), y)]
    assert loss == pytest.approx(-(weight * np.log(chance)).sum() + 5e-4 * (p[:n] ** 2).sum())
    for i in range(n + top):
        step = np.zeros(n + top)
        step[i] = 1e-6
        assert (quality.likelihood(p + step, *args)[0] - quality.likelihood(p - step, *args)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-5)


def plain_features(text, model):
    """Keys and values of one text, word by word."""
    def polynomial(raw):
        return sum(int(ft.BYTE_VALUES[b]) * pow(int(ft.BASE), i, 2**64) for i, b in enumerate(raw)) % 2**64

    def bucket(h):
        return int(ft.mixed(np.array([h % 2**64], np.uint64))[0]) >> 64 - quality.BITS

    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words, own = [], b""
    for b in [*low, 32]:
        if ft.WORD[b]:
            own += bytes([b])
        elif own:
            words.append(own)
            own = b""
    number = [bucket(polynomial(x) + len(x)) for x in words]
    out = {}

    def add(key, value):
        out[key] = out.get(key, 0) + value

    if words:
        for x in number:
            add(x, 1 / (len(words) + quality.FEW))
        add(quality.FEW_WORDS, quality.FEW / (len(words) + quality.FEW))
    runs = [int.from_bytes(bytes([3]) + raw[i : i + 3], "big") * int(ft.MIX) % 2**64 >> 64 - quality.BITS for i in range(len(raw) - 2)]
    if runs:
        for x in runs:
            add(quality.GRAMS + x, 1 / (len(runs) + quality.FEW))
        add(quality.FEW_GRAMS, quality.FEW / (len(runs) + quality.FEW))
    marks = [quality.MARKS + x for x in number]
    marks += [((3 + j) << quality.BITS) + bucket(polynomial(x[:n])) for j, n in enumerate(quality.BEGINNINGS) for x in words if len(x) > n]
    for key in set(marks):
        if model.weights[key]:
            n = marks.count(key)
            out[key] = np.log2(1 + (n if key < quality.WORD_MARKS else n * quality.DENSE / (len(words) + quality.FEW))) / 16
    if any(model.strong[key] for key in marks):
        out[quality.ANY] = 1
    out[quality.REPEATS] = np.log2(1 + sum(a == b for a, b in zip(words, words[1:]))) / 16
    return out


def test_quality_scores_equal_plain_ones(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fitted(docs, table(spark, d, "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "the The"), (-5, "é" * 70)], "doc_id long, text string")
    rows = docs.where("doc_id % 40 = 3 AND length(text) < 20000").union(odd).collect()
    got = {r["doc_id"]: r for r in quality.graded(spark.createDataFrame(rows, docs.schema), model).collect()}
    assert len(rows) > 20
    for r in rows:
        score = sum(model.weights[k] * v for k, v in plain_features(r["text"], model).items())
        above = [1 / (1 + np.exp(c - score)) for c in model.thresholds]
        assert got[r["doc_id"]]["expected_grade"] == pytest.approx(sum(above), abs=1e-6)
        assert got[r["doc_id"]]["tail_probability"] == pytest.approx(above[model.tail], abs=1e-6)
        assert got[r["doc_id"]]["selected"] == (got[r["doc_id"]]["tail_probability"] >= model.least)
    assert got[-1]["expected_grade"] == got[-2]["expected_grade"] == pytest.approx(sum(1 / (1 + np.exp(c)) for c in model.thresholds))


def test_quality_threshold_bounds_all_grades():
    grades = np.repeat([0, 1, 2], 200)
    chance = np.concatenate([np.linspace(0, 0.2, 200), np.linspace(0.1, 0.4, 200), np.linspace(0.6, 1, 200)])
    chance[-2:] = 0.001  # odd texts of the best grade
    cut = quality.threshold(chance, grades, 2)
    assert 0.001 <= cut < 0.61 and (chance[400:] < cut).mean() <= quality.MOST_LOST
    assert 0.4 < quality.threshold(np.concatenate([chance, np.full(800, 0.7)]), np.concatenate([grades, np.full(800, 2)]), 2) < 0.61


def words_of(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split()


def grams_of(text):
    w = words_of(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_classes(rows, least=0.8):
    grams = {k: grams_of(t) for k, t in rows}
    root = {k: k for k in grams}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(k for k in grams if grams[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = grams[a], grams[b]
            longer = max(len(x), len(y))
            if min(len(x), len(y)) >= least * longer and len(set(x) & set(y)) >= 0.5 * len(set(x)) and levenshtein(x, y) <= (1 - least) * longer + 1e-9:
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {k: find(k) for k in grams}


def test_near_duplicates(spark, docs, none):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    new = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, passage = [], new(60)
    for base in (new(120) for _ in range(6)):
        rows.append(base)
        for k in range(6):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append(t[k:] if k < 3 else t)
    rows += [passage + new(50) for _ in range(20)]  # share a passage only
    chain = new(100)
    for k in range(8):  # each like the next
        chain = chain[4:] + new(4)
        rows.append(chain)
    rows += [["a", "b"], ["A", "b"], [], ["a"], ["a", "b", "c", "d", "e"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)] + [(900, None), (901, "!!"), (902, "!!")]
    want = brute_classes(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS s", "1 AS component").repartition(5)
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_duplicates(frame).collect()}
    assert got == want
    assert order_minhash.near_duplicates(none).count() == 0
    twice = [(1, "a b c d e f g"), (1, "q r s t u v"), (2, "Q r s t u v"), (3, "a b c d e f g"), (None, "a b c d e f g"), (4, "!"), (4, None), (4, "")]
    again = spark.createDataFrame(twice, "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["class_id"] or 0) for x in order_minhash.near_duplicates(again).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4)]
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in order_minhash.representatives(again).collect()) == [(0, twice[0][1]), (1, twice[0][1]), (1, twice[1][1]), (4, ""), (4, ""), (4, "!")]
    small = order_minhash.near_duplicates(docs).collect()
    assert len(small) == docs.count() and {x["class_id"] for x in small if x["doc_id"] in (1, 6)} == {1}


def test_near_copies_of_all_lengths_are_found(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(100_000)}"
    rows, linked = [], {}
    for i in range(400):
        base = [word() for _ in range(r.choice([8, 10, 14, 20, 40, 90, 250]))]
        copy = list(base)
        for _ in range(max(1, round(len(base) * r.uniform(0.01, 0.1)))):  # changed, added and dropped words
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([[word()], [], [copy[at], word()]])
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        x, y = grams_of(rows[-2][1]), grams_of(rows[-1][1])
        linked[2 * i + 1] = levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9
    got = {x["doc_id"]: x["kept"] for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[2 * i] for i in range(400)) and all(got[k] for k in linked if not linked[k])
    found = [not got[k] for k in linked if linked[k]]
    assert len(found) > 80 and sum(found) >= 0.98 * len(found)


def brute_spans(rows):
    raws, seen, out = [(k, (t or "").encode()) for k, t in rows], {}, {}
    for _, raw in raws:
        for p in range(len(raw) - 199):
            seen[raw[p : p + 200]] = seen.get(raw[p : p + 200], 0) + 1
    for k, raw in raws:
        m = bytearray(len(raw))
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                m[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, x in zip(raw, m) if not x)
        out[k] = len(raw), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize(("most", "piece"), [(16_384, 256_000), (2, 256_000), (16_384, 260)])
def test_suffix_dedup(spark, none, most, piece):
    r = random.Random(most + piece)
    base = ["".join(r.choice("abcdefé ") for _ in range(r.randint(150, 900))) for _ in range(10)]
    rows = []
    for i in range(50):
        parts = []
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            x = r.randint(0, len(b) // 2)
            parts += [b[x : r.randint(x, len(b))] if r.random() < 0.6 else b, "".join(r.choice("xyz") for _ in range(r.randint(0, 120)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 150), (102, "q" * 199), (103, "z" * 200), (104, "line of text here. " * 20), (105, ""), (106, None)]
    rows += [(200 + k, "".join(f"w{k}{j} " * r.randint(3, 60) for j in range(7))) for k in range(8)]  # periodic stretches
    rows += [(300, "tail" + "periodic! " * 30), (301, "periodic! " * 33 + "end")]
    want = brute_spans(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS pos", "1 AS g")
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.deduplicated(frame, most=most, piece=piece).collect()}
    assert got == want
    frame = frame.selectExpr("*", "5 AS spans", "6 AS n_bytes", "7 AS kept_text", "8 AS t1", "9 AS k0")
    kept = suffix_dedup.deduplicated(frame, keep=("pos", "g", "spans", "n_bytes", "kept_text", "t1", "k0"), with_text=True, most=most).collect()
    assert all((x["pos"], x["g"], x["spans"], x["t1"], x["k0"]) == ("k", 1, 5, 8, 9) and x["n_bytes"] == want[x["doc_id"]][0] for x in kept)
    assert all(x["kept_text"] is None if x["doc_id"] == 106 else len(x["kept_text"].encode()) >= x["n_bytes"] - x["n_removed"] for x in kept)
    assert suffix_dedup.deduplicated(none.select("doc_id", "text")).count() == 0


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    r = random.Random(8)
    new = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b, c = new(300), new(260), new(400)
    texts = [a + new(50), new(40) + a, b, c, c, new(500), new(30) + b, "short", "short"]
    ids = [1, None, 1, 2, 2, 2, None, None, None]
    want = brute_spans(list(enumerate(texts)))
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = sorted((str(x["doc_id"]), *tuple(x)[1:]) for x in suffix_dedup.deduplicated(frame).collect())
    assert got == sorted((str(i), *want[k]) for k, i in enumerate(ids))


def test_vector_links(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + r.normal(size=16) * r.choice([0, 0.02, 0.06, 0.1])).tolist(), int(i % 3)) for i in range(300)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, base[0].tolist(), None), (1005, [], 1), (1006, [1.0, 0.0], 1), (1007, [5.0, 0.0], 1), (1008, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS m")
    x = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    links = {i: {j for j in x if j != i and label[i] == label[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98} for i in x}
    want = {}
    for i, _, _ in sorted(rows, key=lambda t: t[0]):
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        want[i] = len(links.get(i, ())), min(reach), min(reach) == i
    for most in (4096, 7):
        got = {t["vec_id"]: (t["n_links"], t["component_id"], t["kept"]) for t in vector_links.linked(frame, most=most).collect()}
        assert got == want
    assert vector_links.linked(frame.where("false")).count() == 0


def test_vector_links_equal_sql(spark):
    name = "op9_vector_links"
    assert check(spark, "/root/testdata/sf0.01", llm.QUERIES[name], llm.SQL[name]) == 500


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
