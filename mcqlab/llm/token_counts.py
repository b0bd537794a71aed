"""Edit-aware token counts: a segment tree of pre-tokens per document.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of its
pre-tokens' counts. Leaves of the tree are groups of pre-tokens, inner nodes hold
sums. An edit replaces a range of characters: only the touched leaves, with a
boundary leaf on either side as context, are cut into pre-tokens and counted again,
until the new cuts meet the old ones; then the sums above them are updated. Trees are
kept as two array columns, which a later batch of edits takes up again.

Defined results: a null or empty text has no tokens; edits outside a text are clipped
to it; edits of one document must not overlap and count in the order of their starts;
repeated rows are counted again; texts are counted whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mcqlab.llm.common import without

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF = 64  # pre-tokens of a leaf
PATTERN = regex.compile(public_tokenizers.PATTERN)
#: What the redaction edits replace: mail addresses, phone-like numbers, secrets of 32 and more hex digits. Each run of characters is tried from its start only.
SENSITIVE = regex.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|\+?(?<![0-9(])[0-9(][0-9() -]{7,}[0-9]|\b[0-9a-f]{32,}+\b")
MASK = "[redacted]"


class Counts(dict):
    """Tokens of a pre-token; emptied when it grows over ``most`` entries."""

    def __init__(self, path: str, most: int = 600_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def __missing__(self, piece: str) -> int:
        found = self[piece] = len(self.encoding.encode_ordinary(piece))
        return found

    def of(self, pieces: list[str]) -> int:
        if len(self) > self.most:
            self.clear()
        return sum(map(self.__getitem__, pieces))


@lru_cache(2)
def counts(path: str) -> Counts:
    """One per Python worker."""
    return Counts(path)


class SegmentTree:
    """Leaf texts and counts of one document; ``total`` is the root's sum.

    known: lengths and counts of the leaves from an earlier tree of the same text, which
    then need not be cut or counted again.
    """

    def __init__(self, text: str, table: Counts, known: tuple[list[int], list[int]] | None = None):
        self.table, self.encoded, self.pieces = table, 0, None
        if known is None:
            pieces = PATTERN.findall(text)
            groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
            self.pieces = len(pieces)
            self.leaves = ["".join(x) for x in groups]
            self.sums, self.lengths = [[table.of(x) for x in groups]], [[len(x) for x in self.leaves]]
        else:
            if sum(known[0]) != len(text) or len(known[0]) != len(known[1]):
                raise ValueError("the tree is not that of this text")
            ends = list(accumulate(known[0]))
            self.leaves = [text[e - n : e] for e, n in zip(ends, known[0])]
            self.sums, self.lengths = [list(known[1])], [list(known[0])]
        for levels in (self.sums, self.lengths):
            while len(levels[-1]) > 1:
                low = levels[-1]
                levels.append([sum(low[i : i + 2]) for i in range(0, len(low), 2)])

    @property
    def total(self) -> int:
        return self.sums[-1][0]

    @property
    def length(self) -> int:
        return self.lengths[-1][0]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's start."""
        k, start = 0, 0
        for level in reversed(self.lengths[:-1]):
            k *= 2
            if k + 1 < len(level) and at - start >= level[k]:
                start += level[k]
                k += 1
        return k, start

    def _set(self, k: int, pieces: list[str]) -> None:
        self.leaves[k] = "".join(pieces)
        for levels, value in ((self.sums, self.table.of(pieces)), (self.lengths, sum(map(len, pieces)))):
            i, change = k, value - levels[0][k]
            for level in levels:
                level[i] += change
                i //= 2
        self.encoded += len(pieces)

    def replace(self, start: int, end: int, text: str) -> None:
        """Characters [start, end) become ``text``."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        if start == end and not text:
            return
        first, at = self._leaf_at(max(0, start - 1))
        while first > 0 and (start - at <= 2 or not self.leaves[first]):  # the cut before the edit can depend on what follows it
            first -= 1
            at -= self.lengths[0][first]
        last, last_at = self._leaf_at(max(0, end - 1) if end else 0)
        stop = last_at + self.lengths[0][last]
        old = "".join(self.leaves[first : last + 1])
        done = old[: start - at] + text
        rest = old[end - at :]
        while True:
            follow = last + 1
            context = ""
            while follow < len(self.leaves) and len(context) < 2:
                context += self.leaves[follow]
                follow += 1
            pieces, upto, size = [], 0, len(done) + len(rest)
            for piece in PATTERN.findall(done + rest + context):
                if upto >= size:
                    break
                pieces.append(piece)
                upto += len(piece)
            # cuts meet: the new ones end a piece where the old leaf ended, and the next leaf starts as it did
            if upto == size and (follow == last + 1 or self._starts_alike(done + rest, last, context)):
                break
            last += 1
            rest += self.leaves[last]
            stop += self.lengths[0][last]
        self._set(first, pieces)
        for k in range(first + 1, last + 1):
            if self.leaves[k]:
                self._set(k, [])

    def _starts_alike(self, left: str, last: int, context: str) -> bool:
        """Whether the leaf after ``last`` is cut as before, now that other text stands before it."""
        k = next((k for k in range(last + 1, len(self.leaves)) if self.leaves[k]), None)
        if k is None:
            return True
        nearby = self.leaves[k]
        after = next((x for x in self.leaves[k + 1 :] if x), "")[:2]  # cuts look ahead, never back
        upto, old = 0, []
        for piece in PATTERN.findall(nearby + after):
            if upto < len(nearby):
                old.append(piece)
            upto += len(piece)
        tail, upto = PATTERN.findall(left + nearby + after), 0
        for i, piece in enumerate(tail):
            if upto == len(left):
                return tail[i : i + len(old)] == old
            upto += len(piece)
        return False


def found_edits(text: str, pattern: regex.Pattern = SENSITIVE, replacement: str = MASK) -> list[dict]:
    """Edits (start, end, text) that replace what matches, in time that grows with the text."""
    return [{"start": m.start(), "end": m.end(), "text": replacement} for m in pattern.finditer(text)]


def counted(docs: DataFrame, edits: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS, tree: tuple[str, str] | None = None, with_tree: bool = False) -> DataFrame:
    """docs -> kept columns and counts before and after the edits of an array column (start, end, text).

    Without a column of edits they are those of ``found_edits``. n_pretokens and
    n_recounted tell how many pre-tokens a text has and how many the edits made anew.
    with_tree: text_edited, and the edited tree as its leaves' lengths and counts
    (leaf_chars, leaf_tokens). tree: the names of two such columns that an earlier call
    returned for this text; then only leaves that edits touch are cut and counted, and
    n_pretokens is null. A kept column gives way to a result of its name.
    """
    fields = [(n, "long", pa.int64()) for n in ("n_chars_edited", "n_edits", "n_tokens", "n_tokens_edited", "n_pretokens", "n_recounted")]
    if with_tree:
        fields += [("text_edited", "string", pa.string()), ("leaf_chars", "array<int>", pa.list_(pa.int32())), ("leaf_tokens", "array<int>", pa.list_(pa.int32()))]
    given = [F.col(c) if c else F.lit(None) for c in (edits, *(tree or (None, None)))]
    kept = docs.select(*without(keep, [f for f, _, _ in fields]), docs[text].alias("_text"), *(c.alias(f"_given{i}") for i, c in enumerate(given)))

    def one(text: str, changes: list | None, chars: list | None, tokens: list | None, table: Counts) -> tuple:
        own = SegmentTree(text, table, (chars, tokens) if chars is not None and tokens is not None else None)
        before, shift = own.total, 0
        if edits is None:
            changes = found_edits(text)
        changes = sorted((e for e in changes or [] if e is not None and e["start"] is not None and e["end"] is not None), key=lambda e: (e["start"], e["end"]))
        for e in changes:
            size = own.length
            own.replace(e["start"] + shift, e["end"] + shift, e["text"] or "")
            shift += own.length - size
        row = own.length, len(changes), before, own.total, own.pieces, own.encoded
        return (*row, "".join(own.leaves), own.lengths[0], own.sums[0]) if with_tree else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts(ranks)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                given = zip(*(b.column(b.num_columns - i).to_pylist() for i in (4, 3, 2, 1)), strict=True)
                out = [one(t or "", *rest, table) for t, *rest in given]
                yield pa.RecordBatch.from_arrays([*b.columns[:-4], *(pa.array(v, kind) for v, (_, _, kind) in zip(zip(*out, strict=True), fields, strict=True))], [*b.schema.names[:-4], *(f for f, _, _ in fields)])

    schema = [f"`{c}` {kind}" for c, kind in kept.dtypes[:-4]] + [f"{f} {kind}" for f, kind, _ in fields]
    return kept.mapInArrow(run, ", ".join(schema))
