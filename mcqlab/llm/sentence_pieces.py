"""SentencePiece encoding and decoding with N-best segmentations.

Over the lattice of pieces, a forward Viterbi pass gives the best score of every
prefix; a backward A-star search takes these as exact heuristics, so complete paths
leave its queue in the order of their scores. No piece but a run of spaces holds a
space after another character, or a line break, so a text's lattice is a chain of the
lattices of its chunks (spaces and what follows them, line breaks); the N best of the
chain are built from the N-1 chunks whose second path loses least. The forward pass
runs over all new chunks of a batch at once.

The model's vocabulary is one of merges, whose scores are ranks. Sums of ranks mean
nothing, so a piece of rank r gets the log-probability of a Zipf law, 1 / (r + SHIFT),
normed over the vocabulary; sums of these are likelihoods of segmentations. The best
segmentation is mostly that of the merges, though not always: of the distinct words of
the test tables 77 % are cut alike, of natural ones 96 %, and it has 2 % fewer pieces.

Characters outside the vocabulary become byte pieces. Normalisation is the identity
with one space put in front, so decoding returns the text exactly.

Defined results: a null text gives no ids and null text; an empty text gives no ids;
ties go to the path found first, the same everywhere; repeated rows are encoded again.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, product

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from mcqlab.llm.common import without

MODEL = public_tokenizers.path("piece_bpe_32k.model")
N_BEST, SHIFT, GRAIN = 4, 10.0, 2.0**-20
CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n")
BASE, MIXER, TABLE_BITS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 21
SPACE, LITERAL = "▁", "￿"
MINUS = float("-inf")


class Pieces(dict):
    """Chunk -> (ids of its best path as bytes, its score, loss of its second path)."""

    def __init__(self, path: str = MODEL, n: int = N_BEST, most: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.n, self.most = n, most
        self.kept: dict[str, list] = {}
        self.score: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.score[piece] = model.get_score(i), (i,)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if all(s <= 0 and s == int(s) for s, _ in self.score.values()):  # merge ranks; else the model's own log-probabilities stay
            ranks = {p: SHIFT - s for p, (s, _) in self.score.items()}
            total = math.log(sum(1 / r for r in ranks.values()))
            self.score = {p: (-math.log(ranks[p]) - total, i) for p, (_, i) in self.score.items()}
        # multiples of GRAIN add up exactly, so paths of equal score tie, whatever the order of their pieces
        self.score = {p: (round(s / GRAIN) * GRAIN, i) for p, (s, i) in self.score.items()}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces of this model cross chunks")
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values()) - 10.0
        self._hash_pieces()

    def _hash_pieces(self) -> None:
        """Two tables from hash bits to the pieces; the second has what finds no free place in the first."""
        names = list(self.score)
        self.value_of = np.array([self.score[p][0] for p in names])
        self.id_of = np.array([self.score[p][1][0] for p in names], np.uint32)
        self.hash_of = np.zeros(len(names), np.uint64)
        self.tables = np.full((2, 1 << TABLE_BITS), -1, np.int32)
        for k, p in enumerate(names):
            h = 0
            for x in p:
                h = (h * BASE + ord(x)) % 2**64
            h = h * MIXER % 2**64
            self.hash_of[k] = h
            for t, at in enumerate((h >> 64 - TABLE_BITS, h >> 8 & (1 << TABLE_BITS) - 1)):
                if self.tables[t, at] < 0:
                    self.tables[t, at] = k
                    break
            else:
                raise ValueError("the tables are too small")

    def _looked_up(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for no piece."""
        out = np.full(h.shape, -1, np.int32)
        for t, at in enumerate((h >> np.uint64(64 - TABLE_BITS), h >> np.uint64(8) & np.uint64((1 << TABLE_BITS) - 1))):
            k = self.tables[t][at.astype(np.int64)]
            out = np.where((k >= 0) & (self.hash_of[k] == h), k, out)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Viterbi passes over many new chunks at once; long ones and those with unknown characters are left to lookups."""
        known = self.score
        by_size: dict[int, list[str]] = {}
        for c in chunks:
            if c not in self and len(c) <= 32 and "▁" not in c and all(x in known or x == " " for x in c):
                by_size.setdefault(-(-len(c) // 4), []).append(c)
        for size, own in by_size.items():
            for k in range(0, len(own), 4096):
                self._learn(own[k : k + 4096], 4 * size)

    def _learn(self, chunks: list[str], wide: int) -> None:
        n, lengths = len(chunks), np.array([len(c) for c in chunks])
        padded = "".join(c.replace(" ", SPACE).ljust(wide, "\0") for c in chunks)
        codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(n, wide).T.astype(np.uint64)  # [place, chunk]
        most = min(self.longest, wide)
        h, found = np.zeros((wide, n), np.uint64), []
        for size in range(1, most + 1):  # pieces of each size, by start
            h = h[: wide - size + 1] * np.uint64(BASE) + codes[size - 1 :]
            found.append(self._looked_up(h * np.uint64(MIXER)))
        first, second = np.full((wide + 1, n), MINUS), np.full((wide + 1, n), MINUS)
        first[0] = 0.0
        step, piece = np.zeros((wide + 1, n), np.int64), np.zeros((wide + 1, n), np.int32)
        for end in range(1, wide + 1):
            one, two = first[end], second[end]
            for size in range(min(most, end), 0, -1):
                k = found[size - 1][end - size]
                s = np.where(k >= 0, self.value_of[k], MINUS)
                x, y = first[end - size] + s, second[end - size] + s
                better = x > one
                two[:] = np.where(better, np.maximum(one, y), np.maximum(two, x))
                step[end] = np.where(better, size, step[end])
                piece[end] = np.where(better, k, piece[end])
                one[:] = np.where(better, x, one)
        every, at = np.arange(n), lengths.copy()
        backwards = []
        while at.any():
            here = at > 0
            backwards.append(np.where(here, piece[at, every], -1))
            at = np.where(here, at - step[at, every], 0)
        ids = np.stack(backwards[::-1], 1)
        count = (ids >= 0).sum(1)
        flat = self.id_of[ids[ids >= 0]].tobytes()
        stop = np.cumsum(count) * 4
        score, other = first[lengths, every], second[lengths, every]
        for c, a, b, s, o in zip(chunks, (stop - 4 * count).tolist(), stop.tolist(), score.tolist(), other.tolist(), strict=True):
            self[c] = flat[a:b], s, s - o

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the pieces (start, score, ids) that end there."""
        own, score, longest = chunk.replace(SPACE, LITERAL).replace(" ", SPACE), self.score, self.longest
        out = [[]]
        for end in range(1, len(own) + 1):
            here = [(start, *found) for start in range(max(0, end - longest), end) if (found := score.get(own[start:end]))]
            if own[end - 1] not in score:
                here.append((end - 1, self.unknown, tuple(self.byte_ids[b] for b in chunk[end - 1].encode())))
            out.append(here)
        return out

    def paths(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids), best first."""
        edges = self.edges(chunk)
        best = [0.0]
        for here in edges[1:]:
            best.append(max([best[start] + s for start, s, _ in here]))
        found, ticket = [], count()
        queue = [(-best[-1], len(chunk), next(ticket), 0.0, None)]
        while queue and len(found) < self.n:
            _, at, _, behind, path = heapq.heappop(queue)
            if not at:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, s, ids in edges[at]:
                heapq.heappush(queue, (-(best[start] + s + behind), start, next(ticket), s + behind, (ids, path)))
        return found

    def __missing__(self, chunk: str) -> tuple:
        own, get, longest = chunk.replace(SPACE, LITERAL).replace(" ", SPACE), self.score.get, self.longest
        first, second, back = [0.0], [MINUS], [(0, ())]  # best and second best score of each prefix
        for end in range(1, len(own) + 1):
            one = two = MINUS
            for start in range(end - longest if end > longest else 0, end):
                if found := get(own[start:end]):
                    s, ids = found
                    if (x := first[start] + s) > one:
                        one, two, step = x, max(one, second[start] + s), (start, ids)
                    elif x > two:
                        two = x
            if own[end - 1] not in self.score:
                if (x := first[-1] + self.unknown) > one:
                    one, two, step = x, max(one, second[-1] + self.unknown), (end - 1, tuple(self.byte_ids[b] for b in chunk[end - 1].encode()))
                elif x > two:
                    two = x
            first.append(one)
            second.append(two)
            back.append(step)
        at, ids = len(own), []
        while at:
            at, piece = back[at]
            ids.append(piece[0] if len(piece) == 1 else piece[::-1])
        if any(type(x) is tuple for x in ids):
            ids = [y for x in ids for y in (x if type(x) is tuple else (x,))]
        found = self[chunk] = array("I", ids[::-1]).tobytes(), first[-1], first[-1] - second[-1]
        return found

    def alternatives(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best of a chunk, the Viterbi path first."""
        if chunk not in self.kept:
            ids, score, _ = self[chunk]
            best = tuple(np.frombuffer(ids, "<u4").tolist())
            others = [p for p in self.paths(chunk) if p[1] != best]
            self.kept[chunk] = [(score, best), *others[: self.n - 1]]
        return self.kept[chunk]

    def split(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all learnt."""
        if len(self) > self.most:
            self.clear()
            self.kept.clear()
        out = [CHUNK.findall(" " + t) if t else [] for t in texts]
        if new := set().union(*out).difference(self):
            self.learn(new)
        return out

    def encode(self, chunks: list[str]) -> list[tuple[float, bytes]]:
        """The N best (score, ids) of a text's chunks, best first."""
        if not chunks:
            return [(0.0, b"")]
        entries = list(map(self.__getitem__, chunks))
        parts, gains, losses = zip(*entries)
        score, ids = sum(gains), b"".join(parts)
        near = heapq.nsmallest(self.n - 1, zip(losses, range(len(losses))))
        paths = {i: self.alternatives(chunks[i]) for loss, i in near if loss < -MINUS}
        options = [[(p[0] - gains[i], i, k) for k, p in enumerate(own)] for i, own in sorted(paths.items())]
        combined = heapq.nsmallest(self.n, ((-sum(o[0] for o in c), [o[2] for o in c], c) for c in product(*options)))
        starts = {i: sum(map(len, parts[:i])) for i in paths}
        best = []
        for lost, _, c in combined:
            cut, at = [], 0
            for _, i, k in c:
                if k:  # another path of chunk i
                    cut += [ids[at : starts[i]], array("I", paths[i][k][1]).tobytes()]
                    at = starts[i] + len(parts[i])
            best.append((score - lost, b"".join([*cut, ids[at:]]) if cut else ids))
        return best

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode(errors="replace")


@lru_cache(2)
def pieces(path: str, n: int) -> Pieces:
    """One per Python worker."""
    return Pieces(path, n)


def encoded(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = N_BEST, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """docs -> kept columns, n_ids, ids_crc32, score, n_best_scores, n_best_crc32, round_trip; with_ids: n_best_ids too.

    round_trip: decoding the ids returned the text. A kept column gives way to a result
    of its name.
    """
    fields = [("n_ids", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("score", "double", pa.float64()), ("n_best_scores", "array<double>", pa.list_(pa.float64())), ("n_best_crc32", "array<long>", pa.list_(pa.int64())), ("round_trip", "boolean", pa.bool_())]
    if with_ids:
        fields.append(("n_best_ids", "array<array<int>>", pa.list_(pa.list_(pa.int32()))))
    kept = docs.select(*without(keep, [f for f, _, _ in fields]), docs[text].alias("_text"))

    def one(text: str, chunks: list[str], own: Pieces) -> tuple:
        best = own.encode(chunks)
        score, ids = best[0]
        sums = [zlib.crc32(x) for _, x in best]
        row = len(ids) // 4, sums[0], score, [s for s, _ in best], sums, own.decode(ids) == text
        return (*row, [np.frombuffer(x, "<i4") for _, x in best]) if with_ids else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, n)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
                out = zip(*[one(t, c, own) for t, c in zip(texts, own.split(texts), strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, kind) for v, (_, _, kind) in zip(out, fields, strict=True))], [*b.schema.names[:-1], *(f for f, _, _ in fields)])

    return kept.mapInArrow(run, ", ".join([f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]] + [f"{f} {kind}" for f, kind, _ in fields]))


def decoded(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """rows with the text of an array column of ids; null for null."""
    kept = rows.drop(out)
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, N_BEST)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes) + f", `{out}` string")
