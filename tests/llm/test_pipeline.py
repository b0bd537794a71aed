"""The stages, each against what its input says."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from mcqlab.llm.common import stored, table
from tests.llm.test_operators import brute_classes, brute_spans


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = table(spark, d, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        new = stored(f(spark, docs, d))
        out.append((docs, new))
        docs = new
    return out


def test_columns_and_rows(stages):
    for docs, new in stages[:-1]:
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
    for docs, new in stages[:3]:
        assert new.exceptAll(docs).count() == 0 and 0 < new.count() <= docs.count()


def test_poor_documents_go_and_clean_ones_stay(spark, stages):
    docs, new = stages[0]
    labels = table(spark, "/root/testdata/sf0.001", "labels").join(docs.select("doc_id"), "doc_id")
    kept = {r["doc_id"] for r in new.collect()}
    good = [r["doc_id"] in kept for r in labels.where("quality = 1 AND toxic = 0").collect()]
    poor = [r["doc_id"] in kept for r in labels.where("quality = 0").collect()]
    assert sum(good) >= 0.9 * len(good) and sum(poor) <= 0.4 * len(poor)


def test_one_document_of_each_class_stays(stages):
    docs, new = stages[2]
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in new.collect()} == {k for k, v in want.items() if k == v}


def test_repeats_are_cut(stages):
    docs, new = stages[3]
    want = brute_spans([(r["doc_id"], r["text"]) for r in docs.collect()])
    for r in new.collect():
        n, gone, _, _ = want[r["doc_id"]]
        assert n - gone <= len(r["text"].encode()) <= n - gone + 8 and r["n_chars"] == len(r["text"])


def test_all_tokens_are_packed(stages):
    docs, new = stages[4]
    rows = new.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_packed_sequences_come_out_with_their_tokens(stages):
    rows = stages[4][1].collect()
    assert rows and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_module_names():
    assert [re.sub("_", " ", n) for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "minhash near dedup", "suffix array dedup", "packing"]
