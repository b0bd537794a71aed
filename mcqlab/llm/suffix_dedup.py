"""Suffix-array dedup: removal of the bytes that repeated strings of 200 bytes cover.

Winnowing picks anchors: in every window of 200 bytes the smallest of its 32-byte
grams by hash, so equal windows have equal anchors at equal places. Only anchors whose
gram occurs again matter. What a window can see around its anchor is the anchor's
context (168 bytes before, 200 from its start). Contexts that agree in their gram's
and their own hash (64 bits each) and in their shape are taken as equal and covered as
a whole. Where contexts of a gram differ, one of each kind is fetched, and in each task
the contexts are suffix-sorted, once read rightwards and once leftwards from the
anchor: prefix polynomial hashes and binary search give common extensions, a bottom-up
mergesort compares suffixes by them, and extensions of neighbours are verified byte by
byte. Neighbours have the longest common extensions; where the longest to the left and
to the right belong to different partners, the windows of the contexts are compared.

A task sorts at most MOST contexts of one gram. Those of a gram with more (the edge of
a passage that many documents share) are dealt out over tasks by their windows' hashes
(two of 64 bits), which gives the same spans. Grams, contexts and texts that many rows
share are joined by ``dealt_join``.

Matches never cross documents; strings are judged on the input.

Defined results: a null text counts as empty; texts under 200 bytes lose nothing; very
long texts count whole. Rows are told apart by their text, not by their id: each row of
a repeated or null id is a document of its own, and copies of a text of 200 bytes or
more lose all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mcqlab.llm import features as ft
from mcqlab.llm.common import buffer_of, dealt_join, discard, frequent, mixed, slices, stored, without

SPAN, GRAM, MOST = 200, 32, 16_384
BEFORE = SPAN - GRAM
PIECE = 256_000  # bytes of text, and window places, handled at once
LOW = np.uint64(0xFFFFFFFF)
TEXT = ["t1", "t2"]  # two hashes of 64 bits that stand for a text
RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def anchors(data: np.ndarray, offsets: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, their documents (row numbers), gram hashes, and starts and ends of their contexts.

    Of windows that start in [first, last).
    """
    empty = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return empty, empty, empty.astype(np.uint64), empty, empty
    prefix = ft.prefix_hashes(ft.BYTE_VALUES[data])
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * ft.powers(len(prefix))[1][: len(data) - GRAM + 1])
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)  # the smallest hash, then the first place
    width, wanted = 1, SPAN - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = offsets[owner[: len(least)] + 1] - np.arange(len(least)) >= SPAN
    place = np.unique((least[first:last][whole[first:last]] & LOW).astype(np.int64))
    doc = owner[place].astype(np.int64)
    return place, doc, grams[place], np.maximum(place - BEFORE, offsets[doc]), np.minimum(place + SPAN, offsets[doc + 1])


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int | None, int]]:
    """Parts of bounded size: first row, bytes, offsets, range of window starts, and the place where the bytes begin in a cut text."""
    for i, j in slices(offsets, most):
        if j - i > 1 or offsets[j] - offsets[i] <= most:
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0, None, 0
            continue
        size = int(offsets[j] - offsets[i])
        for a in range(0, size - SPAN + 1, most):
            low, high = max(0, a - BEFORE), min(size, a + most + SPAN + BEFORE)
            yield i, data[offsets[i] + low : offsets[i] + high], np.array([0, high - low]), a - low, a + most - low, low


def anchor_rows(docs: DataFrame, most: int = PIECE) -> DataFrame:
    """(t1, t2, text) -> (t1, t2, at, g, c): text, place and reach of an anchor's context, gram, context.

    ``at`` is the place times 65,536, plus 256 times the reach to the left, plus that to the right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(2))
            before: tuple[int, np.ndarray] = -1, np.zeros(0, np.int64)  # row and anchors of the piece before
            for i, own, at, first, last, low in _pieces(data, offsets, most):
                place, doc, g, start, end = anchors(own, at, first, last)
                prefix = ft.prefix_hashes(mixed(ft.BYTE_VALUES[own]))
                left, right = place - start, end - place
                c = mixed(ft.spans(prefix, start, end) + (left * 1000 + right).astype(np.uint64))
                new = np.ones(len(place), bool)
                if last is not None:
                    if before[0] == i:
                        new = ~np.isin(place + low, before[1])
                    before = i, place + low
                take = pa.array((doc + i)[new])
                code = ((place + low - at[doc]) << 16 | left << 8 | right)[new]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *map(pa.array, (code, g[new].view(np.int64), c[new].view(np.int64)))], ["t1", "t2", "at", "g", "c"])

    return docs.mapInArrow(run, "t1 long, t2 long, at long, g long, c long")


class Suffixes:
    """Suffixes (start, end) of a buffer, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end
        self.prefix = ft.prefix_hashes(ft.BYTE_VALUES[data])
        self.back = ft.powers(len(self.prefix))[1]
        self.steps = int((end - start).max(initial=1)).bit_length()

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes i and j, by binary search on hashes."""
        a, b = self.start[i], self.start[j]
        ha, hb, ba, bb = self.prefix[a], self.prefix[b], self.back[a], self.back[b]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.end[i] - a, self.end[j] - b)
        for _ in range(self.steps):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - ha) * ba == (self.prefix[b + middle] - hb) * bb
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def checked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extensions, verified byte by byte: a hash collision can only have made them too long."""
        n = self.common(i, j)
        width = int(n.max(initial=0))
        span = np.arange(width)
        for k in range(0, len(i), 4096):
            own = slice(k, k + 4096)
            a, b = (np.minimum(self.start[x[own], None] + span, len(self.data) - 1) for x in (i, j))
            wrong = (self.data[a] != self.data[b]) & (span < n[own, None])
            bad = wrong.any(1)
            n[own] = np.where(bad, wrong.argmax(1) if width else 0, n[own])
        return n

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j."""
        n = self.common(i, j)
        ends_i, ends_j = n == self.end[i] - self.start[i], n == self.end[j] - self.start[j]
        last = len(self.data) - 1
        less = self.data[np.minimum(self.start[i] + n, last)] < self.data[np.minimum(self.start[j] + n, last)]
        return np.where(ends_i, ~ends_j, ~ends_j & less)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Suffixes sorted within groups (already side by side), by a bottom-up mergesort; ties keep their order."""
        n, width = len(group), 1
        out, index = np.arange(n), np.arange(n)
        most = int(np.bincount(group).max(initial=1))
        first = np.concatenate([[0], np.cumsum(np.bincount(group))])[group]  # runs count from their group's start
        size = np.bincount(group)[group]
        while width < most:
            run = (index - first) // width
            left = run % 2 == 0
            other = first + (run + np.where(left, 1, -1)) * width
            low = np.minimum(other, first + size)
            high = np.minimum(other + width, first + size)
            begin = low.copy()
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) >> 1
                mine, theirs = out[k], out[middle]
                goes = np.empty(len(k), bool)  # whether the other run's element comes first
                side = left[k]
                goes[side] = self.before(theirs[side], mine[side])
                goes[~side] = ~self.before(mine[~side], theirs[~side])
                low[k] = np.where(goes, middle + 1, low[k])
                high[k] = np.where(goes, high[k], middle)
            target = first + (run // 2) * 2 * width + (index - first - run * width) + (low - begin)
            merged = np.empty_like(out)
            merged[target] = out
            out, width = merged, 2 * width
        return out


def _windows(values: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray, offsets: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place (before the anchor, in ``offsets``) of the windows of SPAN bytes that hold a context's anchor."""
    prefix = ft.prefix_hashes(values)
    hashes, rows, places = [], [], []
    for o in offsets:
        own = np.flatnonzero((left >= o) & (right >= SPAN - o))
        start = base[own] + left[own] - o
        hashes.append(mixed(ft.spans(prefix, start, start + SPAN) + np.uint64(o)))
        rows.append(own)
        places.append(np.full(len(own), o))
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)


def covered(group: np.ndarray, data: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, start, end relative to the anchor) that contexts share with others of their group.

    Contexts stand in data from base on; groups are side by side. A context has
    ``left`` bytes before its anchor and ``right`` from there. Equal windows hold the
    anchor at equal places, so only windows of one such place are compared.
    """
    n = len(group)
    ahead = Suffixes(data, base + left, base + left + right)
    mirror = data[::-1]
    behind = Suffixes(mirror, len(data) - (base + left), len(data) - base)
    best = []
    for s in (ahead, behind):
        order = s.order(group)
        same = group[order[1:]] == group[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        reach, partner = np.zeros(n, np.int64), np.full(n, -1)
        ext = s.checked(a, b)
        for x, y in ((a, b), (b, a)):
            more = ext > reach[x]
            reach[x[more]], partner[x[more]] = ext[more], y[more]
        best.append((reach, partner))
    (right_most, with_right), (left_most, with_left) = best
    rows, starts, ends = [], [], []
    possible = np.flatnonzero((right_most >= GRAM) & (left_most + right_most >= SPAN))
    settled = np.zeros(len(possible), bool)
    for side, partner, most in ((behind, with_right, left_most), (ahead, with_left, right_most)):
        ok = partner[possible] >= 0
        k = possible[ok]
        settled[ok] |= side.checked(k, partner[k]) >= most[k]
    done, rest = possible[settled], possible[~settled]
    rows.append(done)
    starts.append(-left_most[done])
    ends.append(right_most[done])
    if len(rest):
        groups = np.flatnonzero(np.isin(group, group[rest]))
        step = max(1, PIECE // len(groups))
        for o0 in range(0, BEFORE + 1, step):
            h, r, o = _windows(ft.BYTE_VALUES[data], base[groups], left[groups], right[groups], range(o0, min(o0 + step, BEFORE + 1)))
            r = groups[r]
            h = mixed(h + mixed(group[r].astype(np.uint64)))
            by = np.argsort(h, kind="stable")
            h, r, o = h[by], r[by], o[by]
            again = np.concatenate([np.zeros(min(1, len(h)), bool), h[1:] == h[:-1]])
            k = np.flatnonzero(again)
            if not len(k):
                continue
            lead = np.flatnonzero(~again)[np.cumsum(~again) - 1]
            # verified against the first window of the same hash
            ok = np.zeros(len(h), bool)
            for s in range(0, len(k), 4096):
                own, first = k[s : s + 4096], lead[k[s : s + 4096]]
                a, b = (base[r[x]] + left[r[x]] - o[x] for x in (own, first))
                ok[own] = (data[a[:, None] + np.arange(SPAN)] == data[b[:, None] + np.arange(SPAN)]).all(1)
            ok[lead[k[ok[k]]]] = True
            rows.append(r[ok])
            starts.append(-o[ok])
            ends.append(SPAN - o[ok])
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (t1, t2, text), wanted (t1, t2, at, g, m) -> (g, m, t1, t2, at, context bytes), from one copy of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                b = whole.slice(k, 128)
                out = []
                for one, two, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    for p in places:
                        at = p["at"]
                        pos = at >> 16
                        out.append((p["g"], p["m"], one, two, at, raw[pos - (at >> 8 & 255) : pos + (at & 255)]))
                        if len(out) == 8192:
                            yield batch(out)
                            out = []
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 5 else pa.binary()) for i in range(6)], ["g", "m", "t1", "t2", "at", "b"])

    places = wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("at", "g", "m")).alias("places"))
    one = docs.groupBy(*TEXT).agg(F.first("text").alias("text"))
    found = one.join(places, TEXT).select(*TEXT, F.encode("text", "UTF-8").alias("text"), "places")
    return found.mapInArrow(run, "g long, m long, t1 long, t2 long, at long, b binary")


def _shape(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and starts, left and right reaches of contexts."""
    data, offsets = _binary(t["b"])
    at = t["at"].to_numpy()
    return data, offsets[:-1], at >> 8 & 255, at & 255


def _spans(t: pa.Table, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    take, pos = pa.array(rows), t["at"].to_numpy()[rows] >> 16
    return pa.RecordBatch.from_arrays([t["t1"].combine_chunks().take(take), t["t2"].combine_chunks().take(take), pa.array(pos + start), pa.array(pos + end)], ["t1", "t2", "start", "end"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by g, at most MOST of each -> (t1, t2, start, end) of covered spans. A group may go on in the next batch."""
    kept: list[pa.RecordBatch] = []

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        _, group = np.unique(t["g"].to_numpy(), return_inverse=True)
        return _spans(t, *covered(group, *_shape(t)))

    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            b = whole.slice(k, 2048)
            g = b.column(0).to_numpy()
            last = int(np.searchsorted(g, g[-1], side="left"))
            if last or (kept and kept[-1].column(0)[-1].as_py() != g[-1]):
                yield spans([*kept, b.slice(0, last)])
                kept = [b.slice(last)]
            else:
                kept.append(b)
    if kept:
        yield spans(kept)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary()).combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _dealt_out(contexts: DataFrame) -> DataFrame:
    """The same for grams with any number of contexts: windows meet by two hashes, with map-side counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                t = pa.Table.from_batches([whole.slice(k, 1024)])
                data, *shape = _shape(t)
                values, g = ft.BYTE_VALUES[data], t["g"].to_numpy().view(np.uint64)
                (h, rows, o), (other, _, _) = _windows(values, *shape, range(BEFORE + 1)), _windows(mixed(values), *shape, range(BEFORE + 1))
                spans = _spans(t, rows, -o, SPAN - o)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(h + mixed(g[rows])).view(np.int64)), pa.array(other.view(np.int64)), *spans.columns], ["h", "h2", "t1", "t2", "start", "end"])

    windows = stored(contexts.mapInArrow(run, "h long, h2 long, t1 long, t2 long, start long, `end` long"))
    again = stored(windows.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    return dealt_join(windows, again, ["h", "h2"], "n").select(*TEXT, "start", "end")


def repeated_spans(docs: DataFrame, most: int = MOST, piece: int = PIECE) -> DataFrame:
    """(t1, t2, text), no text under SPAN bytes -> (t1, t2, spans), stored: the spans to remove, neither merged nor sorted."""
    first = stored(anchor_rows(docs, piece))
    again = stored(first.groupBy("g").agg(F.count("*").alias("n"), (F.min("c") < F.max("c")).alias("mixed")).where("n > 1"))
    rows = stored(dealt_join(first, again, ["g"], "n").drop("n"))
    discard(first, again)
    kinds = stored(rows.groupBy("g", "c").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct(*TEXT, "at")).alias("one")))
    pos, left, right = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    whole = dealt_join(rows, kinds.where("n > 1").select("g", "c", "n"), ["g", "c"], "n").select(*TEXT, (pos - left).alias("start"), (pos + right).alias("end"))
    # grams of different contexts, one of which at least is not settled
    differing = kinds.where("mixed").select("g", "n", "one")
    open_ = stored(differing.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("least = 1").select("g", "m"))
    wanted = dealt_join(differing, open_, ["g"], "m").select("one.*", "g", "m")
    found = stored(_contexts(docs, wanted))
    small = found.where(F.col("m") <= most).repartition("g").sortWithinPartitions("g")
    spans = whole.union(small.mapInArrow(_grouped, "t1 long, t2 long, start long, `end` long"))
    many = found.where(F.col("m") > most)
    if not many.isEmpty():
        spans = spans.union(_dealt_out(many))
    out = stored(spans.groupBy(*TEXT).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(rows, kinds, open_, found)
    return out


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans, clipped to the text."""
    by = np.argsort(starts, kind="stable")
    starts, ends = np.maximum(starts[by], 0), np.maximum.accumulate(np.minimum(ends[by], size))
    if not len(starts):
        return starts, ends
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first], ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(starts) - 1]])]


def _whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without characters that it cuts."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), with_text: bool = False, most: int = MOST, piece: int = PIECE) -> DataFrame:
    """docs -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and the columns to keep.

    with_text: kept_text too, where characters that a span cuts stay whole; null for a
    null text. A kept column gives way to a result of its name.
    """
    names = [*RESULT, *["kept_text"] * with_text]
    keep = without(keep, names)
    kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b, out = whole.slice(k, 256), []
                data, offsets = buffer_of(b.column(1))
                lists, null = b.column(2), b.column(1).is_null().to_pylist()
                for i, key in enumerate(b.column(0).to_pylist()):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    places = lists[i].values if lists[i].is_valid else None
                    start, end = ([places.field(j).to_numpy() for j in (0, 1)] if places is not None else [np.zeros(0, np.int64)] * 2)
                    start, end = merged(start, end, len(raw))
                    cut = list(zip(start.tolist(), end.tolist(), strict=True))
                    left = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                    row = key, len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest()
                    if with_text:
                        cut = [_whole_characters(raw, *c) for c in cut]
                        row = *row, None if null[i] else b"".join(raw[x:y] for x, y in zip([0, *(c[1] for c in cut)], [*(c[0] for c in cut), len(raw)], strict=True)).decode()
                    out.append(row)
                yield pa.RecordBatch.from_arrays([*(pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)), *b.columns[3:]], names + list(keep))

    # inner names are numbered, so that no kept column can have one of them
    others = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), *others)
    long = F.octet_length("text") >= SPAN
    spans = repeated_spans(own.where(long).select(*TEXT, "text"), most, piece)
    # texts of very many copies lose all they have: they are known by name and need no join
    counts = stored(own.where(long).groupBy(*TEXT).agg(F.count("*").alias("n")).where("n > 1"))
    many = frequent(counts, TEXT, "n", own.count())
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    outcome = ["doc_id", "text", "spans", *(f"k{i}" for i in range(len(keep)))]
    copies = own.where(many).withColumn("spans", all_of_it.cast("array<struct<start:bigint,end:bigint>>")).select(*outcome)
    joined = own.where(~many).join(spans, TEXT, "left").select(*outcome).unionByName(copies)
    schema = ["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text, *(f"`{c}` {joined.schema[f'k{i}'].dataType.simpleString()}" for i, c in enumerate(keep))]
    return joined.mapInArrow(run, ", ".join(schema))
