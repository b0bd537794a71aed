"""Phrase collocations by dynamic itemset counting.

Texts are dealt to SHARDS, which are scanned in a cycle. All words are counted from the
first scan on; a phrase of two to five words is counted from the scan after both its
subphrases (without its first, and without its last word) have reached the threshold,
whatever its length, and for one full cycle, so its count is exact. Scans go on until no
phrase can still be under way.

In cycle c all frequent phrases of c words are known. What later cycles count has over
c + 1 words, so from cycle 2 on a scan also writes the runs of such phrases, and the next
scan of the shard reads these alone.

Which phrases have reached the threshold, and before which scan, tasks learn from a
sieve: an array of CELLS bytes, the only thing that is broadcast. Each phrase marks its
cells with the scan when it reaches; the latest of its marks is when it counts as there.
A mark never changes, so a phrase that the sieve takes for another is counted for one
full cycle too, and its count is as exact: the sieve only ever costs work. Counts stay in
tables of strings; nothing rests on a hash.

Defined results: a null text is empty; a null language is ``und``; repeated rows and rows
of one id each count, rows without an id too; texts and words of any length count whole;
other columns are left out; an empty table has no phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mcqlab.llm.common import MIX, buffer_of, dealt_join, discard, mixed, slices, stored
from mcqlab.llm.features import LOWER

SHARDS, LONGEST, LEAST, TOP = 4, 5, 100, 2000
CELLS, MARKS = 1 << 24, 3
NEVER = 255
PARTS = 16
SLICE = 2_000_000  # bytes of text counted at once
WIDE = 64
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(10, 14)]] = True
BLANK[[9, 32]] = True
COUNTED = "lang string, phrase string, k int, since int, n long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The words of many texts, the text of each, and whether the next word stands in the same piece."""
    inside = ~(BREAK[data] | BLANK[data])
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=at[1:])
    words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(at), pa.py_buffer(LOWER[data][inside]))
    text = np.searchsorted(offsets, s, side="right") - 1
    piece = np.cumsum(BREAK[data])[s] if len(s) else s
    return words, text, np.append((piece[1:] == piece[:-1]) & (text[1:] == text[:-1]), False)[: len(s)]


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """MARKS cells for each hash."""
    return (mixed(hashes + (np.arange(1, MARKS + 1, dtype=np.uint64) * MIX)[:, None]) % np.uint64(cells)).astype(np.int64)


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those without the last word and of that word."""
    return mixed(hashes * MIX + words)


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """Hashes of words, from eight bytes of each at a time; what a word has beyond WIDE bytes is hashed by itself."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    at, size = at[:-1], np.diff(at)
    padded = np.concatenate([np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    hashes = mixed(size.astype(np.uint64))
    for k in range(0, WIDE, 8):
        here = np.flatnonzero(size > k)
        if not len(here):
            break
        hashes[here] = extended(hashes[here], eights[at[here] + k] & FIRST_BYTES[np.minimum(size[here] - k, 8)])
    for i in np.flatnonzero(size > WIDE):
        hashes[i : i + 1] = extended(hashes[i : i + 1], np.array([xxhash.xxh64_intdigest(padded[at[i] + WIDE : at[i] + size[i]])], np.uint64))
    return hashes


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hashes of phrases, as ``counted`` makes them from their words."""
    words = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    own = extended(np.repeat(word_hashes(langs.cast(pa.large_string())), size), word_hashes(words.flatten()))
    first = np.cumsum(size) - size
    hashes = own[first]
    for i in range(1, size.max(initial=0)):
        here = np.flatnonzero(size > i)
        hashes[here] = extended(hashes[here], own[first[here] + i])
    return hashes


def since(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """The scan from which each phrase counts as having reached the threshold, NEVER if it has not."""
    return sieve[cells_of(hashes, len(sieve))].max(axis=0).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)


def kinds_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, the number of each value's kind, and where each kind stands first."""
    numbers, kinds = pd.factorize(values)
    first = np.empty(len(kinds), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return kinds, numbers, first


def counted(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: list[str], sieve: np.ndarray, scan: int, shards: int, longest: int, trim: bool = False) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases under way in some texts; langs: the number of each text's language name.

    With trim also, as rows of k = 0, the runs of words that later cycles need.
    """
    strings, text, joined = tokens(data, offsets)
    if not len(strings):
        return
    coded = strings.dictionary_encode()
    words = coded.dictionary
    single, inverse, first = kinds_of(langs[text] * len(words) + coded.indices.to_numpy(zero_copy_only=False))
    del strings, coded, text
    lang_of, word_of = single // len(words), single % len(words)
    hashes = extended(word_hashes(pa.array(names, pa.large_string()))[lang_of], word_hashes(words)[word_of])
    cycle = scan // shards

    def rows(k: int, chosen: np.ndarray, first: np.ndarray, act: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = first[chosen]
        parts = [words.take(pa.array(word_of[inverse[at + i]])) for i in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        named = pa.array(names, pa.string()).take(pa.array(lang_of[inverse[at]]))
        return pa.RecordBatch.from_arrays([named, phrase.cast(pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(act[chosen].astype(np.int32)), pa.array(n[chosen])], ["lang", "phrase", "k", "since", "n"])

    def runs_of(places: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
        """Runs of three and more phrases of ``cycle`` words, each from the word after that of the one before."""
        ends = np.flatnonzero(np.append(~beside, True)) if len(places) else np.zeros(0, np.int64)
        begins = np.append(0, ends[:-1] + 1)[: len(ends)]
        whole = ends - begins >= 2
        first, size = places[begins[whole]], (ends - begins)[whole] + cycle
        at = np.append(0, np.cumsum(size))
        own = words.take(pa.array(word_of[inverse[np.arange(at[-1]) + np.repeat(first - at[:-1], size)]]))
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), own), pa.scalar(" ", pa.large_string()))
        named = pa.array(names, pa.string()).take(pa.array(lang_of[inverse[first]]))
        none = np.zeros(len(first), np.int32)
        return pa.RecordBatch.from_arrays([named, text.cast(pa.string()), pa.array(none), pa.array(none), pa.array(none.astype(np.int64))], ["lang", "phrase", "k", "since", "n"])

    if scan < shards:
        yield rows(1, np.arange(len(single)), first, np.zeros(len(single), np.int64), np.bincount(inverse, minlength=len(single)))
    places, ids, gram_hashes, there = np.arange(len(inverse)), inverse, hashes, since(hashes, sieve)
    for k in range(2, longest + 1):
        # phrases of k - 1 words that have reached the threshold, at two neighbouring places
        alive = there[ids] <= scan
        places, ids = places[alive], ids[alive]
        beside = (places[1:] == places[:-1] + 1) & joined[places[:-1]]
        if trim and k == cycle + 1:
            yield runs_of(places, beside)
        pair = np.flatnonzero(beside)
        if not len(pair):
            return
        left, right, places = ids[pair], ids[pair + 1], places[pair]
        last = inverse[places + k - 1]
        kinds, ids, first = kinds_of(left * len(single) + last)
        n = np.bincount(ids, minlength=len(kinds))
        act = np.maximum(there[left[first]], there[right[first]])
        gram_hashes = extended(gram_hashes[left[first]], hashes[last[first]])
        first = places[first]
        under_way = np.flatnonzero(scan < act + shards)
        if k > cycle and len(under_way):  # shorter ones that are frequent have had their full cycle
            yield rows(k, under_way, first, act, n)
        there = np.maximum(since(gram_hashes, sieve), act)  # the sieve may take a phrase for another before it was ever counted


@lru_cache(1)
def opened(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def scanned(shard: DataFrame, sieve: Broadcast, scan: int, shards: int, longest: int, trim: bool) -> DataFrame:
    """(lang, t) -> counts of the phrases under way, by slice of text; with trim, also what later cycles need of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(1))
            coded = b.column(0).dictionary_encode()
            langs, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
            for i, j in slices(offsets, SLICE):
                yield from counted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], langs[i:j], names, opened(sieve.value), scan, shards, longest, trim)

    return shard.mapInArrow(run, COUNTED)


def marked(reached: DataFrame, sieve: np.ndarray, scan: int) -> int:
    """Marks the cells of phrases (lang, phrase) that count as there from this scan on; at most cells / 64 numbers come to the driver."""
    cells = len(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = cells_of(phrase_hashes(b.column(0), b.column(1)), cells).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    found = reached.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not found.num_rows:
        return 0
    at, bits = (found.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    flags = np.unpackbits(np.ascontiguousarray(bits.view(np.uint64).astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    new = (at[:, None] * 64 + np.arange(64))[flags.astype(bool)]
    new = new[sieve[new] == NEVER]
    sieve[new] = scan
    return len(new)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """A stored table (lang, phrase, k, n) of every word, and of every phrase of at least ``least`` occurrences."""
    if cells % 64 or shards < 1 or least < 1 or shards * longest >= NEVER:
        raise ValueError("cells: a multiple of 64; at least one shard and one occurrence; fewer than 255 scans")
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # the shard of a row is fixed by being written; copies of one text are dealt to all shards
    dealt = stored(own.withColumn("shard", F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), F.lit(shards)).cast("int")), "shard")
    sieve = np.full(cells, NEVER, np.uint8)
    texts = [dealt.where(F.col("shard") == i).select("lang", "t") for i in range(shards)]
    running, finished, steps, trimmed, last, scan = None, [], [], [], 0, 0
    while scan < last + shards:
        shared = spark.sparkContext.broadcast(zlib.compress(sieve, 1))
        # before cycle 2 there are too many counts to be written along with the runs
        trim = 2 <= scan // shards <= longest - 2
        new = scanned(texts[scan % shards], shared, scan, shards, longest, trim)
        if trim:
            both = stored(new)
            trimmed.append(both)
            new, texts[scan % shards] = both.where("k > 0"), both.where("k = 0").select("lang", F.col("phrase").alias("t"))
        if running is not None:
            new = new.unionByName(running)
        # tasks have counted theirs already, and what is carried on has one row a phrase: dealt out as it is, not summed on both sides
        step = stored(new.repartition("lang", "phrase").groupBy("lang", "phrase", "k", "since").agg(F.sum("n").alias("n")))
        steps.append(step)
        shared.destroy()  # the step is written
        over = F.col("since") + shards - 1 <= scan
        finished.append(step.where(over & ((F.col("k") == 1) | (F.col("n") >= least))).select("lang", "phrase", "k", "n"))
        running = step.where(~over)
        scan += 1
        if marked(step.where((F.col("n") >= least) & (F.col("k") < longest)), sieve, scan):  # marks of before stay as they are
            last = scan
    counts = stored(reduce(DataFrame.unionByName, finished))
    discard(dealt, *steps, *trimmed)
    return counts


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def uncovered(candidates: DataFrame, share: int = 100) -> DataFrame:
    """Candidates that stand in no longer candidate with at least ``share`` percent of their occurrences."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _part(words, i, m))))
    inner = candidates.where("k > 2").select("lang", "n", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("n"), F.lit(True))).drop("longer")


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in decimals of 38 digits, enough for 10**17 words."""
    wide = lambda x: x.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


def best_cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, n, total) with l, r and score of the cut of the lowest score, the first of several."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), _part(words, F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), _part(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"))))
    rows = stored(phrases.select("*", cut).select("*", sides.alias("s")).select("lang", "phrase", "n", "total", "cut", "s.*"))
    often = rows.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    sizes = stored(often.join(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"]))
    met = dealt_join(rows, sizes, ["lang", "part"], "uses")
    cuts = met.groupBy("lang", "phrase", "n", "total", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = exact_score(F.col("n"), F.col("total"), F.col("l"), F.col("r"))
    best = cuts.groupBy("lang", "phrase", "n", "total").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    out = stored(best.select("lang", "phrase", "n", "total", "b.*"))
    discard(rows, sizes)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """docs -> (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, number and bytes."""
    counts = frequent_phrases(docs, text, lang, least, longest, shards, cells)
    totals = stored(counts.groupBy("lang").agg(F.sum(F.when(F.col("k") == 1, F.col("n"))).alias("total"), F.count_if(F.col("k") > 1).alias("phrases")))
    kept = stored(uncovered(counts.where("k > 1")))
    phrases = dealt_join(kept, totals, ["lang"], "phrases")
    scored = best_cuts(phrases, counts)
    discard(counts, totals, kept)
    order = [F.desc("score"), F.desc("n"), F.asc("phrase")]
    # a language is ranked in parts first, so the last task gets PARTS * top rows of it at most
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
