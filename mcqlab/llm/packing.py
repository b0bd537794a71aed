"""Packing of documents into sequences: vector bin packing by dot products.

A sequence has limits on tokens, segments and loss-bearing tokens. The open sequence
takes the example whose demands (its tokens, one segment, its loss-bearing tokens) have
the largest dot product with what is left of the limits, among those that fit; when none
fits, one is cut to fill it. Each task packs its own partition, so nothing is shuffled. A
sequence that another limit, or a task's end, leaves short is cut into sequences of
power-of-two lengths, which need no padding.

Defined results: null and empty texts are one end token; very long texts are cut;
rows with a null id are packed as well; repeated rows are packed again; other columns
are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQUENCE, SEGMENTS, END_ID = 4096, 256, 2
KNOWN = 500_000  # words that a Python worker remembers, of about 200 bytes each
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, loss_tokens long"


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class WordBpe(dict):
    """Ids of texts, as little-endian 32-bit integers, by a word-wise BPE vocabulary.

    No token crosses white space, so what stands between white space is looked up in
    this dict and merged once; the dict is emptied when it grows over ``most``
    entries. Texts of unusual characters, or with something that looks like a special
    token, go through the tokenizer as a whole.
    """

    UNUSUAL = re.compile("[^\t\n\r -~\xa0-ɏ‐-―‘-‟•…]")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")

    def __init__(self, path: str = TOKENIZER, most: int = KNOWN):
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        self.merge, self.symbols = self.whole.model.tokenize, byte_symbols()
        if json.load(open(path))["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("not a word-wise vocabulary")

    def __missing__(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isalpha() and chunk.isascii() else self.WORDS.findall(chunk)
        mapped = (w if w.isascii() else "".join(map(self.symbols.__getitem__, w.encode())) for w in words)
        found = self[chunk] = array("I", [t.id for w in mapped for t in self.merge(w)]).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if self.UNUSUAL.search(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > self.most:
            self.clear()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(2)
def word_bpe(path: str, known: int = KNOWN) -> WordBpe:
    """One per Python worker, kept from task to task."""
    return WordBpe(path, known)


def dot_product_packing(demands: np.ndarray, limits: np.ndarray, may_cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Items with demands (tokens, loss-bearing tokens) -> sequences of (item, start, length).

    limits: tokens, segments, loss-bearing tokens. Loss-bearing tokens are the last ones
    of an item, after its prompt, so a piece bears those that it holds. An item must fit
    alone unless it may be cut. All but the last sequence are full, or no item fits.
    """
    left = np.stack([demands[:, 0], np.ones(len(demands)), demands[:, 1]], 1)  # tokens, one segment, loss-bearing tokens
    start = np.zeros(len(left), np.int64)
    weight = 1.0 / limits
    alive = np.flatnonzero(left[:, 0] > 0)
    out: list[list[tuple[int, int, int]]] = []
    while alive.size:
        room, own = limits.astype(np.float64), []
        while alive.size and room[0] > 0 and room[1] > 0:
            d = left[alive]
            value = d @ (weight * weight * room)
            value[(d > room).any(1)] = -1
            last = room[1] == 1 and may_cut
            k = int(value.argmax())
            if value[k] >= 0 and not (last and left[alive[k], 0] < room[0]):
                i, take = int(alive[k]), int(left[alive[k], 0])
            elif may_cut:
                k = int(d[:, 0].argmax())
                i = int(alive[k])
                take = int(min(left[i, 0], room[0], left[i, 0] - left[i, 2] + room[2]))
                if take <= 0:
                    break
            else:
                break
            own.append((i, int(start[i]), take))
            start[i] += take
            cost = max(0, take - (left[i, 0] - left[i, 2]))
            room -= (take, 1, cost)
            left[i] -= (take, 0, cost)
            if left[i, 0] <= 0:
                alive = np.delete(alive, k)
        if not own:
            raise ValueError("an item fits no sequence")
        out.append(own)
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One short sequence cut into sequences whose lengths are powers of two."""
    pieces, out = list(pieces)[::-1], []
    total = sum(p[2] for p in pieces)
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        own, room = [], size
        while room:
            i, start, n = pieces.pop()
            own.append((i, start, take := min(n, room)))
            room -= take
            if take < n:
                pieces.append((i, start + take, n - take))
        out.append(own)
    return out


def prompt_length(text: Column) -> Column:
    """The characters of an instruction example that bear no loss: its first line, with the line's end; none of a text of one line."""
    return F.coalesce(F.instr(text, "\n"), F.lit(0))


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prompt: str | None = None, sequence: int = SEQUENCE, segments: int = SEGMENTS, loss: int = SEQUENCE, tokenizer: str = TOKENIZER, with_ids: bool = False, known: int = KNOWN) -> DataFrame:
    """docs -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    prompt: a column with the number of leading characters, up to white space, whose
    tokens bear no loss; all tokens do without it. with_ids: a column ids with the piece's tokens as well.
    known: words that a worker remembers; fewer take less memory and more time.
    """
    columns = [doc_id, text] + ([prompt] if prompt else [])
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    limits = np.array([sequence, segments, loss])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base, count = word_bpe(tokenizer, known), TaskContext.get().partitionId() << 33, 0
        end = np.array([END_ID], "<u4").tobytes()
        pool: list[tuple[int | None, int, bytes, int, int]] = []  # doc_id, start, ids, tokens of the document and of its prompt

        def rows(sequences, items) -> pa.RecordBatch:
            nonlocal count
            out: list[tuple] = []
            for own in sequences:
                at = 0
                for i, start, n in own:
                    key, first, ids, total, free = items[i]
                    piece = ids[4 * start : 4 * (start + n)]
                    out.append((key, first + start, n, zlib.crc32(piece), total, base + count, at, max(0, first + start + n - max(first + start, free)), *([np.frombuffer(piece, "<i4")] if with_ids else [])))
                    at += n
                count += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

        def demands(items):
            return np.array([(n := len(x[2]) // 4, min(n, x[1] + n - x[4])) for x in items], np.int64).reshape(-1, 2)

        def unpadded(sequences):
            return [own for s in sequences for own in ([s] if sum(n for _, _, n in s) == sequence else powers_of_two(s))]

        for batch in batches:
            prompts = batch.column(2).to_pylist() if prompt else [0] * batch.num_rows
            for k in range(0, batch.num_rows, 512):
                whole, items = [], []
                part = batch.slice(k, 512)
                for key, value, chars in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), prompts[k : k + 512], strict=True):
                    ids = bpe.encode(value or "") + end
                    n, free = len(ids) // 4, len(bpe.encode(value[:chars])) // 4 if value and chars and chars > 0 else 0
                    full = n // sequence if loss >= sequence else 0
                    items.append((key, 0, ids, n, free))
                    whole += [[(len(items) - 1, sequence * j, sequence)] for j in range(full)]
                    if full * sequence < n:
                        pool.append((key, full * sequence, ids[4 * full * sequence :], n, free))
                if whole:
                    yield rows(whole, items)
                if len(pool) >= 2048:
                    done = dot_product_packing(demands(pool), limits)
                    yield rows(unpadded(done[:-1]), pool)
                    pool = [(pool[i][0], pool[i][1] + s, pool[i][2][4 * s : 4 * (s + n)], pool[i][3], pool[i][4]) for i, s, n in done[-1]]
        if pool:
            done = dot_product_packing(demands(pool), limits)
            yield rows(unpadded(done), pool)

    return docs.select(*columns).mapInArrow(run, schema)
