"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of two to four bytes of the lower-cased text. A text is the mean of
its subwords' embeddings; embeddings and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample (``per_language`` rows of each language,
MOST_ROWS rows and MOST_KEYS features in all; no language is left out). Confidence is calibrated by a temperature on a part of the sample that
training does not see; texts below a calibrated threshold are marked rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected; repeated rows get equal results; whole texts of any length count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mcqlab.llm import features as ft
from mcqlab.llm.common import buffer_of, slices
from mcqlab.llm.sampling import collected, sampled

BITS, DIMENSIONS, SIZES = 14, 16, (2, 3, 4)
PER_LANGUAGE, MOST_ROWS, MOST_KEYS = 400, 20_000, 8_000_000


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # [m, buckets]: what is averaged over subwords
    mix: np.ndarray  # [m, languages]
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means @ self.mix + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _lowered(column) -> tuple[np.ndarray, np.ndarray]:
    return buffer_of(pc.utf8_lower(column))


def bags(rows: DataFrame, text: str, label: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of the rows; at most MOST_KEYS buckets reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _lowered(b.column(1))
            out = []
            for i in range(b.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                count = np.bincount(np.concatenate([ft.gram_buckets(own, n, BITS) for n in SIZES]), minlength=1 << BITS)
                k = np.flatnonzero(count)
                out.append((k.astype("<u4").tobytes(), count[k].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.binary()) for v in zip(*out, strict=True))] if out else [b.column(0), pa.array([], pa.binary()), pa.array([], pa.binary())], ["label", "k", "n"])

    return collected(rows.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInArrow(run, "label string, k binary, n binary"), MOST_KEYS)


class _Bags:
    """Rows of (bucket, share) pairs behind each other; no dense matrix is made."""

    def __init__(self, examples: list):
        keys = [np.frombuffer(k, "<u4") for _, k, _ in examples]
        self.at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        self.k = np.concatenate(keys).astype(np.int32) if keys else np.zeros(0, np.int32)
        self.v = np.zeros(len(self.k), np.float32)
        for i, (_, _, n) in enumerate(examples):
            count = np.frombuffer(n, "<u4").astype(np.float32)
            self.v[self.at[i] : self.at[i + 1]] = count / max(1.0, count.sum())

    def rows(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, shares, and row in the batch."""
        size = self.at[batch + 1] - self.at[batch]
        owner = np.repeat(np.arange(len(batch)), size)
        where = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[batch], size)
        return self.k[where], self.v[where], owner

    def means(self, batch: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Average embeddings of rows."""
        out = np.zeros((len(batch), e.shape[1]))
        for s in range(0, len(batch), 256):
            k, v, owner = self.rows(batch[s : s + 256])
            for d in range(e.shape[1]):
                out[s : s + 256, d] = np.bincount(owner, weights=v * e[k, d], minlength=min(256, len(batch) - s))
        return out


def trained(examples: list, epochs: int = 12, rate: float = 4.0, seed: int = 3) -> Model:
    """Stochastic gradient descent on the log loss, classes weighted alike; a fifth of the rows calibrates."""
    languages = sorted({x[0] for x in examples})
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, 0)), np.zeros(0))
    rng, number = np.random.default_rng(seed), {c: i for i, c in enumerate(languages)}
    x, y = _Bags(examples), np.array([number[e[0]] for e in examples])
    order = rng.permutation(len(y))
    held, own = order[: len(order) // 5], order[len(order) // 5 :]
    weight = (len(own) / len(languages) / np.maximum(np.bincount(y[own], minlength=len(languages)), 1))[y]
    e = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS))
    w = rng.normal(0, 0.5, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 32)):
            k, v, owner = x.rows(batch)
            hidden = np.stack([np.bincount(owner, weights=v * e[k, d], minlength=len(batch)) for d in range(DIMENSIONS)], 1)
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= (weight[batch] / len(batch))[:, None]
            back = p @ w.T
            w, bias = w - 0.25 * step * hidden.T @ p, bias - 0.1 * step * p.sum(0)
            for d in range(DIMENSIONS):
                e[:, d] -= 20 * step * np.bincount(k, weights=v * back[owner, d], minlength=1 << BITS)
    few = len(languages) <= DIMENSIONS  # then one column a language costs less than one a dimension
    model = Model(languages, np.ascontiguousarray((e @ w).T if few else e.T), np.eye(len(languages)) if few else w, bias)
    if len(held) >= 20:
        means = x.means(held, model.columns.T)

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(means)[np.arange(len(held)), y[held]] + 1e-12).mean()

        model.temperature = min(np.geomspace(0.1, 5, 40), key=loss)
        p = model.probabilities(means)
        right = p.argmax(1) == y[held]
        # rejected: less sure than all but one in 500 right predictions on the calibration rows, and than 1.5 times chance
        model.least = min(float(np.quantile(p.max(1)[right], 0.002)) * 0.9 if right.any() else 1.0, 0.9)
        model.least = max(model.least, min(0.5, 1.5 / len(languages)))
    return model


def fitted(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the rows with a language."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return trained(bags(sampled(rows, lang, key, per_language, MOST_ROWS, text=text), text, lang))


def predicted(docs: DataFrame, model: Model, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected (columns of those names are replaced).

    with_text: the text too; without it, it need not come back from the workers.
    """
    names = ("lang_pred", "score", "rejected")
    kept = docs.drop(*names)
    at = kept.columns.index(text)
    back = [i for i in range(len(kept.columns)) if with_text or i != at]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x 2**BITS numbers at most, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column(at)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offsets = _lowered(column)
            means = np.zeros((b.num_rows, len(m.columns)))
            for i, j in slices(offsets):
                own, at0 = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                count = np.zeros(j - i)
                for n in SIZES:
                    k = ft.gram_buckets(own, n, BITS)
                    first, last = at0[:-1], at0[1:] - (n - 1)
                    count += np.maximum(last - first, 0)
                    for c, column in enumerate(m.columns):
                        means[i:j, c] += ft.text_sums(column[k], first, last)
                means[i:j] /= np.maximum(count, 1)[:, None]
            p = m.probabilities(means) if m.languages else np.zeros((b.num_rows, 1))
            best, top = p.argmax(1), p.max(1)
            known = letters & bool(m.languages)
            name = [m.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            score = np.where(known, top, 0.0)
            yield pa.RecordBatch.from_arrays([*map(b.column, back), pa.array(name, pa.string()), pa.array(score), pa.array(~known | (score < m.least))], [*(b.schema.names[i] for i in back), *names])

    schema = "".join(f"`{kept.columns[i]}` {kept.dtypes[i][1]}, " for i in back)
    return kept.mapInArrow(run, f"{schema}lang_pred string, score double, rejected boolean")
