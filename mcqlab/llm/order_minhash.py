"""Order MinHash near-duplicates.

A document is its sequence of shingles of five lower-cased words (all its words, if it
has fewer). Documents of equal word sequences are one class. Each of SKETCHES random
orders picks the LENGTH smallest occurrence-labelled shingles of a class; kept in text
order, they are a bucket key, so buckets collect texts of small edit distance. Two
classes are linked if 1 - edit distance / longer length, over shingles, is 0.8 or
more; candidates are verified by a banded alignment whose band is that allowance.

No bucket is turned into all its pairs. Its members are first aligned with its
leader, the member that stands in the fullest buckets. Where that leaves members
unlinked, the pairs still open go through an exact prefix filter: linked texts must
share one of their rarest shingles, so texts that only share a common passage never
meet. Word sequences are told apart by a hash of 128 bits of their text, words by
32 bits.

Defined results: null and empty texts, and texts without a word, are classes of their
own and link with nothing; a row without an id is ignored for links and gets a null
class; of a repeated id, each row is in the class of its own text; repeated rows get
equal results; very long texts count whole; other columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mcqlab.llm import features as ft
from mcqlab.llm.common import MIX, buffer_of, components, dealt_join, discard, mixed, slices, stored

WORDS, SKETCHES, LENGTH, LEAST = 5, 24, 3, 0.8
PIECE = 50_000  # shingles handled at once
_ORDERS = mixed(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * MIX)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of five words; of all words if there are fewer."""
    words = words.astype(np.uint64)
    if len(words) <= WORDS:
        rows = [words] if len(words) else []
        return np.array([_joined(r[:, None])[0] for r in rows], np.uint64)
    return _joined(np.stack([words[k : len(words) - WORDS + 1 + k] for k in range(WORDS)]))


def _joined(parts: np.ndarray) -> np.ndarray:
    out = np.full(parts.shape[1], len(parts), np.uint64)
    for p in parts:
        out = mixed(out * MIX + p)
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingles made distinct by how often they stood before in the text."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    if len(starts) == len(grams):
        return grams
    nth = np.arange(len(grams)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(grams)]])))
    out = np.empty_like(grams)
    out[order] = np.where(nth > 0, mixed(ranked + nth.astype(np.uint64) * MIX), ranked)
    return out


def sketches(grams: np.ndarray) -> np.ndarray:
    """One key for each random order: its LENGTH smallest labelled shingles, in text order."""
    own = labelled(grams)
    flip, odd = _ORDERS[:SKETCHES, None], _ORDERS[SKETCHES:, None] | np.uint64(1)
    places = np.zeros((SKETCHES, 0), np.int64)
    for k in range(0, len(own), PIECE):
        here = np.concatenate([places, np.broadcast_to(np.arange(k, min(k + PIECE, len(own))), (SKETCHES, min(PIECE, len(own) - k)))], axis=1)
        value = (own[here] ^ flip) * odd
        least = min(LENGTH, here.shape[1])
        pick = np.argpartition(value, least - 1, axis=1)[:, :least] if here.shape[1] > least else np.broadcast_to(np.arange(least), (SKETCHES, least))
        places = np.take_along_axis(here, pick, axis=1)
    places = np.sort(places, axis=1)
    key = np.arange(SKETCHES, dtype=np.uint64)
    for column in places.T:
        key = mixed(key * MIX + own[column])
    return key.view(np.int64)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit word hashes of many texts, and their offsets."""
    hashes, _, _, at = ft.words(data, offsets)
    return (hashes >> np.uint64(32)).astype(np.uint32), at


def _sequence_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The two halves of a 128-bit hash of the word sequence of each of the rows: of its lower-cased words, a space after each."""
    owner = np.repeat(np.arange(len(start)), end - start)
    place = np.arange(len(owner)) + owner
    plain = np.full(len(owner) + len(start), 32, np.uint8)
    plain[place] = ft.LOWER[data[np.arange(len(owner)) + np.repeat(start - np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start)]] if len(start) else 0
    bound = np.concatenate([[0], np.cumsum(end - start + 1)])[at]
    whole = memoryview(plain)
    digests = b"".join(xxhash.xxh3_128_digest(whole[bound[r] : bound[r + 1]]) for r in rows)
    return list(np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T)


def sketched(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, hash, n, k1, k2, sketch) of every document with a word and an id; k1, k2 identify the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(2))
            for i, j in slices(offsets):
                own = data[offsets[i] : offsets[j]]
                hashes, s, e, at = ft.words(own, offsets[i : j + 1] - offsets[i])
                words = (hashes >> np.uint64(32)).astype(np.uint32)
                some = np.flatnonzero(np.diff(at))
                keys = _sequence_keys(own, s, e, at, some)
                flat = [sketches(shingles(words[at[r] : at[r + 1]])) for r in some]
                n = np.maximum(np.diff(at)[some] - WORDS + 1, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * SKETCHES), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                take = pa.array(some + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(n), *map(pa.array, keys), lists], ["doc_id", "hash", "n", "k1", "k2", "sketch"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    return own.mapInArrow(run, "doc_id long, hash long, n long, k1 long, k2 long, sketch array<long>")


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance within a band of ``most`` around the diagonal; more than ``most`` means it is larger.

    The band of each column is one integer of vertical differences (bit-parallel);
    what lies outside counts as growing by one.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    places = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    low, width = 0, min(n, most + 1)
    up, down, score = (1 << width) - 1, 0, width
    for j, x in enumerate(b):
        if j:
            if low + width < min(n, j + most + 1):
                up |= 1 << width
                width += 1
                score += 1
            if j - most > low:
                up >>= 1
                down >>= 1
                low += 1
                width -= 1
        equal = 0
        for p in places.get(x, ()):
            if low <= p < low + width:
                equal |= 1 << (p - low)
        mask = (1 << width) - 1
        across = (((equal & up) + up) ^ up) | equal
        right = (down | ~(across | up)) & mask
        left = up & across
        if right >> (width - 1) & 1:
            score += 1
        elif left >> (width - 1) & 1:
            score -= 1
        right = (right << 1 | 1) & mask
        left = left << 1 & mask
        both = equal | down
        up = (left | ~(both | right)) & mask
        down = right & both
    return score if score <= most else most + 1


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> tuple[bool, bool]:
    """Whether two shingle sequences are linked, and whether they may be near (half of the longer one in common)."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if min(len(a), len(b)) < longer - most:
        return False, min(len(a), len(b)) * 2 >= longer
    x, y = labelled(a), labelled(b)
    bound = longer - len(np.intersect1d(x, y, assume_unique=True))  # no alignment does better
    if bound > most:
        return False, bound * 2 <= longer
    same = int(np.argmin(np.concatenate([a[: len(b)] == b[: len(a)], [False]])))
    a, b = a[same:], b[same:]
    tail = int(np.argmin(np.concatenate([a[::-1][: len(b)] == b[::-1][: len(a)], [False]])))
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    band = min(most, 2 * bound + 16)
    while (d := edit_distance(a, b, band)) > band and band < most:
        band = min(most, 2 * band)
    return d <= most, True


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(a, b) -> (a, b, linked, near); words: (doc_id, w) with 32-bit word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                t, out = whole.slice(k, 1024), []
                for a, x, y in zip(t.column(0).to_pylist(), t.column(2), t.column(3), strict=True):
                    if a != last:
                        last, left = a, shingles(np.frombuffer(x.as_buffer(), "<u4"))
                    out.append(aligned(left, shingles(np.frombuffer(y.as_buffer(), "<u4")), least))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *(pa.array([o[i] for o in out], pa.bool_()) for i in (0, 1))], ["a", "b", "linked", "near"])

    # few leaders stand in most pairs
    often = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).join(words.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")), "a"))
    both = dealt_join(pairs, often, ["a"], "n").join(words.select(F.col("doc_id").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(run, "a long, b long, linked boolean, near boolean")


def words_of(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """wanted (cid, rep, k1, k2) -> (doc_id, w): the words of each class under its cid, from rows of the id rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(0))
            for i, j in slices(offsets):
                own = data[offsets[i] : offsets[j]]
                hashes, s, e, at = ft.words(own, offsets[i : j + 1] - offsets[i])
                words = (hashes >> np.uint64(32)).astype(np.uint32)
                keys = _sequence_keys(own, s, e, at, np.arange(j - i))
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array([words[at[r] : at[r + 1]].tobytes() for r in range(j - i)], pa.binary())], ["k1", "k2", "w"])

    ids = wanted.select(F.col("rep").alias("_rep"))
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(ids, F.col("_id") == F.col("_rep"), "left_semi").select("_text")
    found = own.mapInArrow(run, "k1 long, k2 long, w binary")
    return wanted.join(found, ["k1", "k2"]).groupBy(F.col("cid").alias("doc_id")).agg(F.first("w").alias("w"))


def _rest(members: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members (rep, component) of different components that may be linked: an exact prefix filter.

    Linked sequences have least * longer labelled shingles in common, so the first
    (1 - least) * n + 1 of each, in one common order, share one. Rare shingles come
    first in that order, by their number of members here.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                grams = [labelled(shingles(np.frombuffer(w.as_buffer(), "<u4"))).view(np.int64) for w in b.column(2)]
                at = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))], ["rep", "component", "g"])

    own = members.join(words.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "component", "w")
    grams = stored(own.mapInArrow(explode, "rep long, component long, g long"))
    often = stored(grams.groupBy("g").agg(F.count("*").alias("df"), F.min("component").alias("c0"), F.max("component").alias("c1")))
    # a shingle of one component only orders the prefixes; it makes no pair
    ranked = dealt_join(grams, often, ["g"], "df").groupBy("rep", "component").agg(F.array_sort(F.collect_list(F.struct("df", "g", (F.col("c0") < F.col("c1")).alias("shared")))).alias("gs"))
    prefix = F.slice("gs", 1, (F.size("gs") - F.ceil(F.lit(least) * F.size("gs") - F.lit(1e-9)) + 1).cast("int"))
    keys = stored(ranked.select("rep", "component", F.size("gs").alias("n"), F.explode(F.filter(prefix, lambda x: x["shared"])).alias("x")).select("rep", "component", "n", "x.g"))
    discard(grams, often)
    # components meet first, so that no pair within one is made
    kinds = keys.groupBy("g", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    c, d = kinds.alias("c"), kinds.alias("d")
    may = (F.col("c.high") >= F.lit(least) * F.col("d.low")) & (F.col("d.high") >= F.lit(least) * F.col("c.low"))
    met = c.join(d, (F.col("c.g") == F.col("d.g")) & (F.col("c.component") < F.col("d.component")) & may).select("c.g", F.col("c.component").alias("cx"), F.col("d.component").alias("cy"))
    x = keys.select("g", F.col("component").alias("cx"), F.col("rep").alias("rx"), F.col("n").alias("nx"))
    y = keys.select("g", F.col("component").alias("cy"), F.col("rep").alias("ry"), F.col("n").alias("ny"))
    close = (F.col("nx") >= F.lit(least) * F.col("ny")) & (F.col("ny") >= F.lit(least) * F.col("nx"))
    return met.join(x, ["g", "cx"]).join(y, ["g", "cy"]).where(close).select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).distinct()


def _with_component(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return rows.join(named, F.col(of) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", of)).drop("_node", "_component")


def class_labels(docs: DataFrame, text: str, doc_id: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2) with an id and a word, and (k1, k2, class_id) of the word sequences, both stored."""
    own = stored(sketched(docs, text, doc_id))
    grouped = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # the numbers are fixed by being written with the rows
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()))
    keys = stored(classes.select(F.col("cid").alias("rep"), "n", F.explode(F.array_distinct("sketch")).alias("s")))
    # a bucket's leader is its member in the fullest buckets: the middle of a group of copies, within reach of most of them
    sizes = stored(keys.groupBy("s").agg(F.count("*").alias("m")).where("m > 1"))
    met = stored(dealt_join(keys, sizes, ["s"], "m"))
    shared = stored(met.join(met.groupBy("rep").agg(F.sum("m").alias("weight")), "rep"))
    leaders = stored(shared.groupBy("s").agg(F.min(F.struct(-F.col("weight"), "rep", "n")).alias("l"), F.first("m").alias("size")).select("s", F.col("l.rep").alias("a"), F.col("l.n").alias("na"), "size"))
    members = stored(dealt_join(shared, leaders, ["s"], "size").where("rep <> a").select("s", "m", "a", "na", F.col("rep").alias("b"), F.col("n").alias("nb")))
    discard(keys, sizes, met, shared, leaders)
    close = (F.col("na") >= F.lit(least) * F.col("nb")) & (F.col("nb") >= F.lit(least) * F.col("na"))
    pairs = stored(members.where(close).select("a", "b").distinct())
    crowded = members.where("m > 2")
    ids = crowded.select(F.col("b").alias("cid")).union(crowded.select("a")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    words = stored(words_of(docs, classes.join(ids, "cid").select("cid", "rep", "k1", "k2"), text, doc_id))
    first = stored(verified(pairs, words, least))
    links = first.where("linked").select("a", "b")
    labels = components(links)
    # open: members apart from their bucket's leader, if another such member or one on the leader's side may be linked with them
    of_leaders = stored(_with_component(crowded.groupBy("a").agg(F.count("*").alias("led")), labels, "a", "ca"))
    state = dealt_join(stored(_with_component(crowded, labels, "b", "cb")), of_leaders, ["a"], "led")
    state = stored(state.join(first, ["a", "b"], "left"))
    apart = F.col("ca") != F.col("cb")
    near = F.coalesce("near", (F.col("na") <= 2 * F.col("nb")) & (F.col("nb") <= 2 * F.col("na")))  # not aligned: lengths alone rule out the link
    direct = F.coalesce("linked", F.lit(False))
    bucket = state.groupBy("s").agg(
        F.count("*").alias("size"), F.min(F.when(apart, F.col("cb"))).alias("c0"), F.max(F.when(apart, F.col("cb"))).alias("c1"),
        F.max(apart & near).alias("any_near"), F.max(~apart & direct).alias("any_direct"), F.max(~apart & ~direct).alias("any_by_chain"),
    )
    bucket = bucket.withColumn("joined", (F.col("any_near") & F.col("any_direct")) | F.col("any_by_chain")).where((F.col("c0") < F.col("c1")) | (F.col("joined") & F.col("c0").isNotNull()))
    bucket = stored(bucket.select("s", "size", "joined"))
    still = stored(dealt_join(state, bucket, ["s"], "size").where(apart | F.col("joined")).select(F.col("b").alias("rep"), F.col("cb").alias("component")).distinct())
    discard(members, pairs, labels, of_leaders, state, bucket)
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(_rest(still, words, least).join(known, ["a", "b"], "left_anti"))
    links = stored(links.union(verified(more, words, least).where("linked").select("a", "b")))
    discard(first, more, words, still)
    labels = components(links)
    named = _with_component(classes.select("k1", "k2", "cid", "rep", "copies"), labels, "cid", "component")
    smallest = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("size"))
    sequences = stored(dealt_join(stored(named), stored(smallest), ["component"], "size").select("k1", "k2", "class_id", "copies"))
    discard(classes, links, labels)
    return own, sequences


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST, with_hash: bool = False) -> DataFrame:
    """docs -> (doc_id, class_id, kept): the smallest id that links and copies reach, and whether it is the row's own.

    with_hash: the text's hash too.
    """
    own, sequences = class_labels(docs, text, doc_id, least)
    facts = dealt_join(own.select("doc_id", "hash", "k1", "k2"), sequences, ["k1", "k2"], "copies").select("doc_id", "hash", "class_id")
    # rows without a word or an id have no sequence
    rest = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNull() | ~has_word(F.col("text")))
    out = facts.unionByName(rest.select("doc_id", F.xxhash64("text").alias("hash"), F.col("doc_id").alias("class_id")))
    return out.select("doc_id", *["hash"] * with_hash, "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def has_word(text: Column) -> Column:
    """Whether a text has an ASCII letter or digit, or a character beyond ASCII."""
    return F.coalesce(text.rlike(r"[^\x00-/:-@\[-`{-\x7f]"), F.lit(False))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The rows of docs that bear the smallest id of their class, and those without a class."""
    others = near_duplicates(docs, text, doc_id, least, with_hash=True).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    return docs.join(others, (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left_anti")
