"""Fingerprints, collocations and the filter audit against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mcqlab.llm import catalog as llm
from mcqlab.llm import collocations, filter_audit, fingerprint
from tests.oracle import check

ALPHABET = ["alpha", "Beta", "gam-ma", "d", "é", "of the", "new york city", "x,", "y.\n", "tab\tbed", ";", "Z"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = [(i * 3, t, rng.choice(["en", "fr", None])) for i, t in enumerate(texts)]
    rows += [(500, None, "en"), (501, "", None), (502, " \n\t", "und"), (503, "One two " * 4000, "de"), (504, "ÄÖ😀 " * 7, "de"), (504, "ÄÖ😀 " * 7, "de"), (None, "no id here", "en"), (None, texts[0], ""), (505, texts[0], "fr"), (506, texts[0], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS n", "1 AS score", "2 AS part", "3 AS range", "4 AS phrase", "5 AS term", "'q' AS t", "6 AS key")


@pytest.mark.parametrize("name", ["edited_texts", "op12_collocations", "op13_filter_audit"])
def test_queries_equal_sql(spark, sf_dir, name):
    check(spark, sf_dir, llm.QUERIES[name], llm.SQL[name])


# collocations


def brute_phrases(rows, least, top, longest=5):
    f = Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            f.update((lang if lang is not None else "und", tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    total = Counter()
    for (lang, p), a in f.items():
        total[lang] += a * (len(p) == 1)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inner = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner[lang, p[i : i + m]] = max(inner[lang, p[i : i + m]], a)
    found = {}
    for (lang, p), a in candidates.items():
        if inner[lang, p] < a:
            score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, xs in found.items() for r, x in enumerate(sorted(xs)[:top]))


@pytest.mark.parametrize(("least", "top", "shards", "cells"), [(3, 2000, 4, 1 << 16), (2, 7, 3, 64), (100, 50, 1, 1 << 16)])
def test_collocations(docs, least, top, shards, cells):
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    got = collocations.collocations(docs.repartition(5), least=least, top=top, shards=shards, cells=cells)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


@pytest.mark.parametrize(("shards", "cells", "longest"), [(3, 1 << 16, 5), (2, 64, 6), (1, 1 << 16, 6)])
def test_later_scans_read_runs_of_frequent_phrases(spark, monkeypatch, shards, cells, longest):
    rng = random.Random(7)
    passage = ["one", "t" * 64, "Three", "f" * 65, "é" * 90, "six", "seven"]  # words around the width that is hashed at once
    rows = []
    for i in range(300):
        rare = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        a, b = rng.randrange(60), rng.randrange(4)
        rows.append((" ".join([*rare[:a], *passage[b : b + rng.randrange(2, 8)], *rare[a:]]) + ("." if i % 3 else ", one"), rng.choice(["en", "", None])))
    read, real = {}, collocations.scanned

    def seen(shard, sieve, scan, *rest):
        read[scan] = shard.agg(F.sum(F.length("t"))).first()[0] or 0
        return real(shard, sieve, scan, *rest)

    monkeypatch.setattr(collocations, "scanned", seen)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=5, longest=longest, shards=shards, cells=cells)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 5, 2000, longest)
    if cells > 64:  # a small sieve takes every phrase for a frequent one
        assert 2 * sum(n for scan, n in read.items() if scan // shards == 3) < sum(n for scan, n in read.items() if scan // shards == 0)


def test_phrases_hash_like_their_words():
    words = pa.array(["", "a", "12345678", "123456789", "x" * 64, "x" * 65, "x" * 66, "a"], pa.large_string())
    own = collocations.word_hashes(words)
    assert len(set(own.tolist())) == 7 and own[1] == own[7]
    assert collocations.word_hashes(words.slice(2, 3)).tolist() == own[2:5].tolist()
    lang = collocations.word_hashes(pa.array(["en", ""], pa.large_string()))
    first = collocations.extended(lang, own[[1, 5]])
    assert collocations.phrase_hashes(pa.array(["en", ""]), pa.array(["a", "x" * 65])).tolist() == first.tolist()
    longer = collocations.extended(first[1:], collocations.extended(lang[1:], own[2:3]))
    assert collocations.phrase_hashes(pa.array(["en", ""]), pa.array(["a", "x" * 65 + " 12345678"])).tolist() == [first[0], longer[0]]


def test_no_collocations(docs):
    assert collocations.collocations(docs.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(10**15, 10**16, 10**15 + 7, 10**15 + 9), (100, 10**12, 3 * 10**9 + 1, 101), (5, 7, 11, 13)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in frame.select(collocations.exact_score(*map(F.col, "anlr"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_pieces():
    texts = ["aB  c,d\te", "", "é f", "g"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, text, joined = collocations.tokens(data, at)
    assert words.to_pylist() == ["ab", "c", "d", "e", "é", "f", "g"] and text.tolist() == [0, 0, 0, 0, 2, 2, 3]
    assert joined.tolist() == [True, False, True, False, True, False, False]


# the filter audit


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, part in rows:
        t = t or ""
        ws = re.findall("[^ \t-\r]+", t)
        own = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        failed.append((part or "", {k for k, v in own.items() if v}, *(any(x[j] == 1 for x in labels if i is not None and x[0] == i) for j in (1, 2))))
    out, total = {}, Counter()
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[part, f] += len(gone)
                fails = sum(f in x[1] for x in own)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit(spark, docs):
    more = spark.createDataFrame([(900 + i, t, "fr") for i, t in enumerate(["WORD " * 300, "a # b", " ".join(f"w{k}" for k in range(250)), "WORD " * 300, "a # b"])], "doc_id long, text string, lang string")
    every = docs.unionByName(more, allowMissingColumns=True)
    labels = [(3, 1, 0), (6, 0, 1), (6, 1, 0), (901, 1, 1), (904, 1, None), (None, 1, 1), (503, None, 1)]
    sets = filter_audit.failure_sets(every, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audited(sets).collect()}
    want = brute_audit([tuple(r) for r in every.select("doc_id", "text", "lang").collect()], labels)
    assert got == want
    assert filter_audit.audited(filter_audit.failure_sets(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0


def test_paths():
    for k in (1, 3, 5):
        reaching, leaving = filter_audit.paths(k)
        assert reaching == [math.factorial(s.bit_count()) for s in range(1 << k)] and leaving == [math.factorial(k - s.bit_count()) for s in range(1 << k)]
    with pytest.raises(ValueError):
        filter_audit.audited(None, "AAB")


# fingerprints


def brute_sample(weights, g, j):
    def x64(value, seed):
        return xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed)

    best = None
    for term, w in weights.items():
        key = xxhash.xxh64_intdigest(term.encode(), 42) ^ g
        h = [xxhash.xxh64_intdigest((3 * j + i).to_bytes(4, "little"), x64(key, 42)) for i in range(3)]
        u = lambda x: (((x >> 32) + 0.5) / 2**32, ((x & (2**32 - 1)) + 0.5) / 2**32)
        r, c, b = -math.log(u(h[0])[0] * u(h[0])[1]), math.log(-math.log(u(h[1])[0] * u(h[1])[1])), u(h[2])[0]
        t = math.floor(math.log(w) / r + b)
        best = min(best or (math.inf,), (c - r * (t - b + 1), term, t))
    return best


def brute_edit(rows):
    order = sorted(((i, t) for i, t in rows if i is not None), key=lambda x: (x[0], x[1]))
    out = []
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        out.append((i, t, t[: len(t) - half] + following[:half], following))
    return out + [(None, t, t[: len(t) - len(t) // 2], "") for i, t in rows if i is None]


def test_fingerprints(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    got = fingerprint.fingerprinted(docs.repartition(3), samples=16, cached=5, per_range=2).collect()
    want = brute_edit(rows)
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in got) == sorted((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    prints = {}
    for r in got:
        for t in [t for i, t, e, _ in want if i == r["doc_id"] and hashlib.sha256(e.encode()).hexdigest() == r["edited_sha256"]][:1]:
            assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    for name in ("fingerprint", "edited_fingerprint"):
        assert all(len(r[name]) == 8 * 16 for r in got)
    # samples by the formula, on every text whose best two terms are not a rounding error apart
    weights = {t: Counter(re.findall("[^\x00-\x20]+", t)) or Counter({"": 1}) for _, t, e, f in want for t in (t, e, f)}
    drawn = {t: [brute_sample(w, k // 4, k % 4)[1:] for k in range(16)] for t, w in weights.items()}
    parts = {t: [p[8 * k : 8 * k + 8] for k in range(16)] for t, p in prints.items()}
    texts = sorted(parts)
    for a in texts[:20]:
        for b in texts:
            assert [x == y for x, y in zip(parts[a], parts[b], strict=True)] == [x == y for x, y in zip(drawn[a], drawn[b], strict=True)]
    by_hash = {hashlib.sha256(e.encode()).hexdigest(): (t, e, f) for i, t, e, f in want if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            t, e, f = by_hash[r["edited_sha256"]]
            assert r["near_edited"] == sum(x == y for x, y in zip(drawn[t], drawn[e], strict=True)) / 16
            assert r["near_next"] == sum(x == y for x, y in zip(drawn[t], drawn[f], strict=True)) / 16
    assert fingerprint.fingerprinted(docs.where("false")).count() == 0
    one = fingerprint.fingerprinted(docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    with pytest.raises(ValueError):
        fingerprint.fingerprinted(docs, samples=5)


def test_collisions_follow_generalised_jaccard(spark):
    a, b = "p " * 8 + "q " * 4 + "r s t", "p " * 4 + "q " * 6 + "r u"
    frame = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprinted(frame, samples=2000).collect()}
    x, y = (Counter(t.split()) for t in (a, b))
    similarity = sum((x & y).values()) / sum((x | y).values())
    assert got[1]["near_next"] == pytest.approx(similarity, abs=0.04)


# what was mended in this round


def test_power_of_two_sequences_stay_apart(spark):
    from mcqlab.llm import order_minhash

    words = ["yes"]
    while len(words) < 1024:
        words += ["no" if w == "yes" else "yes" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join("no" if w == "yes" else "yes" for w in words)), (3, "Yes, " + " ".join(words[1:]))]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_samples_of_equal_ids(spark):
    from mcqlab.llm import language_id, sampling

    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), F.concat(F.when(F.col("id") % 2 == 0, "the house ").otherwise("la maison "), F.col("id").cast("string")).alias("text"))
    for changed in (rows, rows.withColumn("doc_id", F.lit(None).cast("long")), rows.withColumn("doc_id", F.col("doc_id") % 3), rows.withColumns({"doc_id": F.lit(7), "text": F.lit("same")})):
        assert {r["lang"]: r["count"] for r in sampling.sampled(changed, "lang", "doc_id", 400, text="text").groupBy("lang").count().collect()} == {"en": 400, "fr": 400}
    assert language_id.fitted(rows.withColumn("doc_id", F.lit(None).cast("long"))).languages == ["en", "fr"]


def test_vectors_of_repeated_ids(spark):
    from mcqlab.llm import vector_links

    rows = [(9, "a", [1.0, 0.0, 0.01]), (9, "a", [1.0, 0.0, 0.02]), (1, "b", [1.0, 2.0, 3.0]), (2, "b", [1.0, 2.0, 3.0001]), (1, "c", [5.0, 0.0, 1.0]), (3, "c", [5.0, 0.0, 1.01]), (4, "c", [5.0, 0.0, 1.02])]
    got = sorted(map(tuple, vector_links.linked(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_clashing_names_of_any_case(spark):
    from mcqlab.llm import url_filter

    got = url_filter.filtered(spark.createDataFrame([(1, "http://A.com/x", "q", 1)], "page_id long, url string, Host string, VERDICT int"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "score", "verdict"] and got.first()["host"] == "a.com"


def test_loss_tokens_are_those_after_the_prompt(spark):
    from mcqlab.llm import packing

    rows = [(1, "ten words stand in this first line of all here\n" + "and the rest bears loss " * 1500), (2, "one line only"), (3, "\nall of it"), (4, None), (5, "prompt alone\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("p", packing.prompt_length(F.col("text")))
    bpe = packing.WordBpe()
    count = lambda t: len(bpe.encode(t)) // 4
    for loss in (4096, 1000):
        pieces = packing.packed(docs, prompt="p", loss=loss).collect()
        for i, text in rows:
            own = sorted((r["start"], r["length"], r["loss_tokens"]) for r in pieces if r["doc_id"] == i)
            free = count(text[: text.find("\n") + 1]) if text and "\n" in text else 0
            assert sum(n for _, n, _ in own) == count(text or "") + 1 and sum(x for _, _, x in own) == count(text or "") + 1 - free
            assert all(x == max(0, s + n - max(s, free)) for s, n, x in own)
        used = {}
        for r in pieces:
            used.setdefault(r["sequence_id"], []).append((r["length"], r["loss_tokens"]))
        totals = [(sum(n for n, _ in own), sum(x for _, x in own)) for own in used.values()]
        assert all(x <= loss and (n == 4096 or n & (n - 1) == 0) for n, x in totals)
        assert (max(n for n, _ in totals) == 4096) == (loss == 4096)


def test_log_probabilities_of_a_model_stay(monkeypatch):
    import sentencepiece

    from mcqlab.llm import sentence_pieces

    rng = random.Random(8)
    names = sorted({"▁" * rng.randrange(2) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(30)} | {"▁", "a", "b", "c"})

    class Model:
        def __init__(self, model_file):
            self.scores = {p: -1.5 - 0.37 * k for k, p in enumerate(names)}

        def get_piece_size(self):
            return len(names) + 256

        def id_to_piece(self, i):
            return names[i] if i < len(names) else f"<0x{i - len(names):02X}>"

        def get_score(self, i):
            return self.scores[names[i]]

        def is_byte(self, i):
            return i >= len(names)

        def is_control(self, i):
            return False

        is_unknown = is_unused = is_control

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    pieces = sentence_pieces.Pieces("none")
    scores = Model(None).scores
    assert all(pieces.score[p][0] == pytest.approx(s, abs=2e-6) for p, s in scores.items())
    real = sentence_pieces.Pieces.__init__  # merge ranks still become log-probabilities
    monkeypatch.setattr(Model, "get_score", lambda self, i: -float(i))
    real(ranked := sentence_pieces.Pieces.__new__(sentence_pieces.Pieces), "none")
    assert sum(math.exp(s) for s, _ in ranked.score.values()) == pytest.approx(1, abs=1e-3)


def test_vectors_travel_once(spark, monkeypatch):
    """No copies of a vector for each cell of a grid: what is stored is less than the vectors themselves."""
    from pathlib import Path
    from urllib.parse import urlparse

    from mcqlab.llm import vector_links

    sizes, stored = [], vector_links.stored

    def watched(df, *by):
        out = stored(df, *by)
        sizes.append(sum(f.stat().st_size for f in Path(urlparse(out._stored_at).path).rglob("*.parquet")))
        return out

    monkeypatch.setattr(vector_links, "stored", watched)
    r = np.random.default_rng(4)
    rows = [(i, i % 2, r.normal(size=64).tolist()) for i in range(2000)]
    assert vector_links.linked(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).where("n_links = 0 AND kept").count() == 2000
    assert sum(sizes) < 2000 * 64 * 4


def test_near_pairs_of_tiles(monkeypatch):
    from mcqlab.llm import vector_links

    monkeypatch.setattr(vector_links, "TILE", (7, 11))
    z = vector_links.turned(np.random.default_rng(3).normal(size=(150, 8)))
    block, allowed = z[:, :3], 0.05
    square = ((block[:, None].astype(float) - block[None]) ** 2).sum(2)
    every = np.arange(150)
    for home, visitors in ((every, every), (every[::3], every[1::3])):
        same = home is visitors
        got = [tuple(p) for i, j in vector_links.near_pairs(block, home, visitors, allowed, same) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = {(i, j) for i in home.tolist() for j in visitors.tolist() if square[i, j] <= allowed}
        if same:
            got, want = [(min(p), max(p)) for p in got], {(i, j) for i, j in want if i < j}
        assert len(got) == len(set(got)) and want <= set(got) and all(square[p] <= allowed + 3e-5 for p in got)
