"""Prompts that keep to a budget of tokens: the context is cut, at the end of a sentence where there is one.

The tokenizer is injected and loaded once a task; it gives the end, in characters, of
each token of a text, so the cut is exact in tokens without counting prefixes one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ends of sentences: a mark with what closes after it, before white space or the end; or a line's end.
SENTENCE_END = re.compile(r"[.!?…]+[\"')\]]*(?=\s|$)|\n")


class Tokenizer(Protocol):
    def ends(self, text: str) -> list[int]:
        """The end of each token, in characters, ascending."""
        ...


def cut_at_sentence(context: str, most: int) -> str:
    """At most so many characters, up to the last end of a sentence among them; up to the last word without one."""
    if len(context) <= most:
        return context
    ends = [m.end() for m in SENTENCE_END.finditer(context) if m.end() <= most]
    if ends:
        return context[: ends[-1]].rstrip()
    space = max((m.start() for m in re.finditer(r"\s", context[: most + 1])), default=most)
    return context[:space].rstrip()


def fitted(before: str, context: str, after: str, tokenizer: Tokenizer, budget: int) -> tuple[str | None, int]:
    """The prompt and its number of tokens; no prompt if what must be kept is over the budget already."""
    count = lambda x: len(tokenizer.ends(before + x + after))
    if count("") > budget:
        return None, count("")
    if (n := count(context)) <= budget:
        return before + context + after, n
    ends, room = tokenizer.ends(context), budget - count("")
    kept = cut_at_sentence(context, ends[room - 1] if room else 0)
    while (n := count(kept)) > budget:  # tokens may split anew where the parts meet
        ends = tokenizer.ends(kept)
        room = min(len(ends) - 1, bisect_right(ends, len(kept)) - (n - budget))
        kept = cut_at_sentence(kept, ends[room - 1] if room > 0 else 0) if room > 0 else ""
    return before + kept + after, n


def budgeted(rows: DataFrame, before: Column, context: Column, after: Column, make_tokenizer: Callable[[], Tokenizer], budget: int, out: str = "prompt") -> DataFrame:
    """rows with ``out`` and ``{out}_tokens``; null where the fixed parts alone pass the budget or a part is null."""
    fields = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make_tokenizer()
        for b in batches:
            parts = [b.column(len(fields) + i).to_pylist() for i in range(3)]
            got = [(None, None) if None in p else fitted(*p, tokenizer, budget) for p in zip(*parts, strict=True)]
            columns = [b.column(i) for i in range(len(fields))] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + [out, f"{out}_tokens"])

    own = rows.select("*", before.alias("_before"), context.alias("_context"), after.alias("_after"))
    return own.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_tokens", T.IntegerType())]))
