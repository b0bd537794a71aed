"""Embeddings of texts by an injected encoder, and the store that keeps them.

A text is cut to the encoder's limit in tokens, not characters, and texts go to the
model in batches of a stated number of padded tokens, alike in length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mcqlab.operators.store import Extension, KeyedStore, text_key

MAX_TOKENS, BATCH_TOKENS = 512, 16_384
VECTOR = "array<float>"


class Encoder(Protocol):
    """Loaded once a task. ``tokens`` gives the ids of whole texts without special tokens; ``encode`` adds these."""

    special: int

    def tokens(self, texts: list[str]) -> list[list[int]]: ...

    def encode(self, tokens: list[list[int]]) -> np.ndarray: ...


def token_batches(lengths: list[int], budget: int) -> Iterator[list[int]]:
    """Places of texts, shortest first, in batches whose number times longest text keeps to the budget; a longer text is alone."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if batch and (len(batch) + 1) * max(1, lengths[i]) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def encoded(texts: DataFrame, make_encoder: Callable[[], Encoder], max_tokens: int = MAX_TOKENS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(key, text) -> (key, value, error): vectors of length 1; a batch that fails gives errors for its own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        room = max_tokens - encoder.special
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            values: list[np.ndarray | None] = [None] * len(keys)
            errors: list[str | None] = [None] * len(keys)
            try:
                ids = [t[:room] for t in encoder.tokens(texts)]
            except Exception as e:  # the model's own failures cost the batch
                ids, errors = [], [repr(e)] * len(keys)
            for places in token_batches([len(t) + encoder.special for t in ids], batch_tokens):
                try:
                    x = np.asarray(encoder.encode([ids[i] for i in places]), np.float64)
                    length = np.sqrt((x * x).sum(1, keepdims=True))
                    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0).astype(np.float32)
                    for i, v in zip(places, x, strict=True):
                        values[i] = v
                except Exception as e:
                    for i in places:
                        errors[i] = repr(e)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["key", "value", "error"])

    return texts.select("key", "text").mapInArrow(run, f"key binary, value {VECTOR}, error string")


def extend_vectors(store: KeyedStore, texts: list[tuple[DataFrame, Column]], make_encoder: Callable[[], Encoder], max_tokens: int = MAX_TOKENS, batch_tokens: int = BATCH_TOKENS, among: DataFrame | None = None) -> Extension:
    """Encodes the texts of all (table, column) that the store lacks; equal texts once. among: only texts whose key this table has."""
    from functools import reduce

    wanted = reduce(DataFrame.unionByName, [rows.select(text_key(c).alias("key"), c.alias("text")) for rows, c in texts])
    return store.extend(wanted, lambda new: encoded(new, make_encoder, max_tokens, batch_tokens), among=among)
