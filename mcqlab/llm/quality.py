"""Quality classifier: ordinal regression with cumulative links on hashed texts.

One weight vector over hashed features is shared by all grades; ordered thresholds cut
its score into grades. Shares of words, and of runs of three bytes, tell the look of a
text. Words and beginnings of words that the lower grades hold more often than the best
are marks. Marks that are words count by the logarithm of their number, so a few of them
tell in a text of any length; beginnings, which clean texts hold now and then, by that of
their share. The chance of a grade above k is 1 / (1 + exp(threshold_k - score)),
that of grade k the difference of two of them, and weights and thresholds are fitted to
the likelihood of the grades. From it come the expected grade and the tail probability
that selection uses. Fitted on a bounded sample (``per_grade`` rows of each grade,
MOST_KEYS features in all); its held-out rows of all grades set the selection threshold.

Defined results: a null or empty text has no features, its score is 0; repeated rows
get equal results; whole texts of any length count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mcqlab.llm import features as ft
from mcqlab.llm.common import buffer_of, discard, mixed, slices, stored
from mcqlab.llm.sampling import collected, sampled

BITS, GRAM = 17, 3
PER_GRADE, MOST_KEYS = 1500, 4_500_000
NAMES = ("expected_grade", "tail_probability", "selected")
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
#: Keys of features: shares of words, of byte runs; marks of words, of beginnings; words like the one before; the missing share of short texts; any strong mark.
GRAMS, MARKS, WORD_MARKS = 1 << BITS, 2 << BITS, 3 << BITS
REPEATS = (3 + len(BEGINNINGS)) << BITS
FEW_WORDS, FEW_GRAMS, ANY, SIZE = REPEATS + 1, REPEATS + 2, REPEATS + 3, REPEATS + 4
FEW, DENSE = 16, 256  # added to the number of words or runs that shares are of; the share of a beginning is times DENSE before its logarithm
UNLIKE, STRONG = 12.0, 60.0  # squared deviations between grades from which a mark is used, and is strong
RARE = 0.01  # share of the best rows that may hold a strong mark
MOST_LOST = 0.02  # of the best held-out rows, at the selection threshold


@dataclass
class Model:
    weights: np.ndarray  # by the keys of features
    thresholds: np.ndarray
    tail: int  # selection asks for a grade above this
    strong: np.ndarray  # which features are strong marks
    least: float = 0.5

    def chances(self, score: np.ndarray) -> np.ndarray:
        """Chance of a grade above k, for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -50, 50)))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: good but toxic; 2: good and clean. Null without a rating."""
    return F.when(quality.isNotNull(), F.when(quality <= 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2))


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First key, words that are longer, and their buckets, for each length of BEGINNINGS."""
    prefix = ft.prefix_hashes(ft.BYTE_VALUES[ft.LOWER[data]])
    for j, n in enumerate(BEGINNINGS):
        longer = np.flatnonzero(ends - starts > n)
        yield (3 + j) << BITS, longer, _word_buckets(mixed(ft.spans(prefix, starts[longer], starts[longer] + n)))


def damped(n: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + n) / 16


def bags(rows: DataFrame, text: str, grade: str) -> list[tuple[int, bytes, bytes]]:
    """(grade, keys, numbers) of the rows; at most MOST_KEYS keys reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(1))
            out = []
            for i in range(b.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                hashes, starts, ends, _ = ft.words(own, np.array([0, len(own)]))
                k, v = [], []
                for base, x in ((0, _word_buckets(hashes)), (GRAMS, ft.gram_buckets(own, GRAM, BITS)), *((base, x) for base, _, x in beginnings(own, starts, ends))):
                    own_k, n = np.unique(x, return_counts=True)
                    k.append(own_k + base)
                    v.append(n)
                k.append(np.array([REPEATS]))
                v.append(np.array([(hashes[1:] == hashes[:-1]).sum()]))
                out.append((np.concatenate(k).astype("<u4").tobytes(), np.concatenate(v).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[j] for o in out], pa.binary()) for j in (0, 1))], ["label", "k", "n"])

    return collected(rows.select(F.col(grade).cast("int").alias("label"), F.col(text).alias("text")).mapInArrow(run, "label int, k binary, n binary"), MOST_KEYS)


def _used(examples: list[tuple[int, bytes, bytes]], rows: np.ndarray, grades: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features to fit: shares that are not rare, and marks that a lower grade holds more often than the best; which marks are strong."""
    holds = np.zeros((top + 1, SIZE), np.int32)
    for i in rows:
        k = np.frombuffer(examples[i][1], "<u4")
        holds[grades[i], k] += 1
        holds[grades[i], k[k < GRAMS] + MARKS] += 1
    used = holds.sum(0) >= max(3, 0.01 * len(rows))
    used[MARKS:REPEATS] = False
    strong = np.zeros(SIZE, bool)
    n, best = np.bincount(grades[rows], minlength=top + 1), holds[top, MARKS:REPEATS]
    for g in range(top):
        if n[g] and n[top]:
            own = holds[g, MARKS:REPEATS]
            p = (own + best + 1) / (n[g] + n[top] + 2)
            more = own / n[g] - best / n[top]
            far = np.where((own >= 3) & (more > 0), more * more / (p * (1 - p) * (1 / n[g] + 1 / n[top])), 0)
            used[MARKS:REPEATS] |= far >= UNLIKE
            strong[MARKS:WORD_MARKS] |= ((far >= STRONG) & (best <= RARE * n[top]))[:GRAMS]
    used[REPEATS:] = True
    return used, strong


def _features(keys: bytes, numbers: bytes, used: np.ndarray, strong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used keys and values of one row."""
    k, n = np.frombuffer(keys, "<u4"), np.frombuffer(numbers, "<u4")
    ks, vs = [], []
    for base, few in ((0, FEW_WORDS), (GRAMS, FEW_GRAMS)):
        own = (k >= base) & (k < base + GRAMS)
        if total := int(n[own].sum()):
            ks += [k[own], [few]]
            vs += [n[own] / (total + FEW), [FEW / (total + FEW)]]
    word, start, last = k < GRAMS, (k >= MARKS) & (k < REPEATS), k == REPEATS
    marks, often = np.concatenate([k[word] + MARKS, k[start]]), np.concatenate([n[word], n[start]])
    often = np.where(marks < WORD_MARKS, often, DENSE * often / (int(n[word].sum()) + FEW))
    k, v = np.concatenate([*ks, marks, k[last]]).astype(np.int32), np.concatenate([*vs, damped(often), damped(n[last])])
    if strong[k].any():
        k, v = np.append(k, np.int32(ANY)), np.append(v, 1.0)
    return k[used[k]], v[used[k]]


def threshold(chance: np.ndarray, grades: np.ndarray, top: int) -> float:
    """The cut with the smallest sum of the lost share of the best grade and the passed shares of the others.

    No more than MOST_LOST of the best rows may be lost, by an estimate one standard error above what is seen.
    """
    values = np.unique(chance)
    cuts = np.concatenate([values[:1], (values[1:] + values[:-1]) / 2])
    below = {g: np.searchsorted(np.sort(chance[grades == g]), cuts) / (grades == g).sum() for g in range(top + 1) if (grades == g).any()}
    lost = below.pop(top)
    n = (grades == top).sum()
    cost = np.where(lost + np.sqrt((lost + 1 / n) * (1 - lost) / n) <= MOST_LOST, lost + sum(1 - x for x in below.values()), np.inf)
    return float(cuts[cost.argmin()])


def cuts(q: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the steps."""
    return q[0] + np.concatenate([[0], np.cumsum(np.exp(q[1:]))])


def likelihood(p: np.ndarray, top: int, k: np.ndarray, v: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The weighted negative log likelihood of grades y under cumulative links, and its gradient.

    p: weights, then the first of ``top`` thresholds and the logarithms of the steps. Row
    owner[i] has the value v[i] of feature k[i].
    """
    n = len(p) - top
    score = np.bincount(owner, weights=v * p[k], minlength=len(y))
    above = np.ones((len(y), top + 2))  # chances of a grade above -1, 0, ..., top
    above[:, -1] = 0
    above[:, 1:-1] = 1 / (1 + np.exp(np.clip(cuts(p[n:])[None] - score[:, None], -50, 50)))
    rows = np.arange(len(y))
    upper, lower = above[rows, y], above[rows, y + 1]
    chance = np.maximum(upper - lower, 1e-12)
    loss = -(weight * np.log(chance)).sum() + decay / 2 * (p[:n] ** 2).sum()
    g = np.empty_like(p)
    g[:n] = np.bincount(k, weights=v * ((upper + lower - 1) * weight)[owner], minlength=n) + decay * p[:n]
    back = np.zeros(top + 2)
    np.add.at(back, y, weight * upper * (1 - upper) / chance)
    np.add.at(back, y + 1, -weight * lower * (1 - lower) / chance)
    steps = np.cumsum(back[1:-1][::-1])[::-1]
    g[n] = steps[0]
    g[n + 1 :] = steps[1:] * np.exp(p[n + 1 :])
    return loss, g


def trained(examples: list[tuple[int, bytes, bytes]], rounds: int = 300, rate: float = 3.0, decay: float = 1e-6, seed: int = 5) -> Model:
    """Adam on the likelihood, all grades weighted alike; a fifth of the rows sets the selection threshold."""
    grades = np.array([e[0] for e in examples], np.int64)
    top = max(1, int(grades.max())) if len(grades) else 1
    order = np.random.default_rng(seed).permutation(len(examples))
    held, own = np.sort(order[: len(order) // 5]), np.sort(order[len(order) // 5 :])

    def flat(rows):
        k, v = zip(*(_features(*examples[i][1:], fit, strong) for i in rows)) if len(rows) else ((), ())
        owner = np.repeat(np.arange(len(rows)), np.array([len(x) for x in k], np.int64))
        return (np.concatenate(k) if k else np.zeros(0, np.int32)), (np.concatenate(v) if v else np.zeros(0)), owner, grades[rows]

    fit, strong = _used(examples, own, grades, top)
    k, v, owner, y = flat(own)
    used, k = np.unique(k, return_inverse=True)
    weight = 1 / np.maximum(np.bincount(y, minlength=top + 1), 1)[y] / (top + 1)
    p = np.zeros(len(used) + top)  # weights, then the first threshold and the logarithms of the steps
    p[len(used)] = -0.5
    m, s = np.zeros_like(p), np.zeros_like(p)

    model = Model(np.zeros(SIZE), cuts(p[len(used) :]), top - 1, strong)
    if not len(examples):
        return model
    for t in range(1, rounds + 1):
        _, g = likelihood(p, top, k, v, owner, y, weight, decay)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        move[len(used) :] *= 0.02
        p -= rate * move
    model.weights[used] = p[: len(used)]
    model.thresholds = cuts(p[len(used) :])
    k, v, owner, y = flat(held)
    if (y == top).sum() >= 20:
        chance = model.chances(np.bincount(owner, weights=v * model.weights[k], minlength=len(held)))[:, model.tail]
        model.least = threshold(chance, y, top)
    return model


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_grade: int = PER_GRADE) -> Model:
    """A model from a bounded sample of rated documents; a document's lowest rating counts."""
    rated = labels.select(key, grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("grade IS NOT NULL").groupBy(key).agg(F.min("grade").alias("grade"))
    chosen = sampled(rated, "grade", key, per_grade)
    found = stored(docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key))
    out = trained(bags(sampled(found, "grade", key, per_grade, text=text), text, "grade"))  # an id may have many rows
    discard(found)
    return out


def graded(docs: DataFrame, model: Model, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with expected_grade, tail_probability and selected (columns of those names are replaced).

    with_text: the text too; without it, it need not come back from the workers.
    """
    kept = docs.drop(*NAMES)
    at = kept.columns.index(text)
    back = [i for i in range(len(kept.columns)) if with_text or i != at]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w, marks = m.weights, m.weights != 0
        for b in batches:
            data, offsets = buffer_of(b.column(at))
            score = np.zeros(b.num_rows)
            for i, j in slices(offsets):
                own, at0 = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, starts, ends, first = ft.words(own, at0)
                owner = np.repeat(np.arange(j - i), np.diff(first))
                words, grams = _word_buckets(hashes), np.maximum(np.diff(at0) - (GRAM - 1), 0)
                runs = ft.text_sums(w[GRAMS:MARKS][ft.gram_buckets(own, GRAM, BITS)], at0[:-1], at0[:-1] + grams)
                for sums, n, few in ((ft.text_sums(w[words], first[:-1], first[1:]), np.diff(first), FEW_WORDS), (runs, grams, FEW_GRAMS)):
                    score[i:j] += np.where(n > 0, (sums + FEW * w[few]) / (n + FEW), 0)
                found = np.zeros(j - i, bool)
                for base, which, x in ((MARKS, np.arange(len(words)), words), *beginnings(own, starts, ends)):
                    hit = marks[x + base]
                    pair, n = np.unique(owner[which[hit]] * (1 << BITS) + x[hit], return_counts=True)
                    if base > MARKS:
                        n = DENSE * n / (np.diff(first)[pair >> BITS] + FEW)
                    score[i:j] += np.bincount(pair >> BITS, weights=damped(n) * w[base + (pair & (GRAMS - 1))], minlength=j - i)
                    found[owner[which[m.strong[x + base]]]] = True
                score[i:j] += found * w[ANY]
                like = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
                score[i:j] += w[REPEATS] * damped(np.bincount(owner[1:][like], minlength=j - i))
            above = m.chances(score)
            tail = above[:, m.tail]
            yield pa.RecordBatch.from_arrays([*map(b.column, back), pa.array(above.sum(1)), pa.array(tail), pa.array(tail >= m.least)], [*(b.schema.names[i] for i in back), *NAMES])

    schema = "".join(f"`{kept.columns[i]}` {kept.dtypes[i][1]}, " for i in back)
    return kept.mapInArrow(run, f"{schema}expected_grade double, tail_probability double, selected boolean")
