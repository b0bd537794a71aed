"""Labelled completions over a stream, one row each: a positive label wins, then the smallest id and source.

State is kept by completion until the watermark passes ``keep`` after its last row.
A row is emitted whenever the winner changes, so a sink that replaces rows by completion
and version holds what ``prefs.kto_dedup`` gives for all rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINNER = "completion string, id string, label boolean, source string, version int"
STATE = "id string, label boolean, source string, version int, seen long"


def _before(a: tuple, b: tuple) -> bool:
    """Whether (label, id, source) a wins over b."""
    rank = lambda x: (not x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or "")
    return rank(a) < rank(b)


def first_completions(rows: DataFrame, time: str, delay: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """A stream of (completion, id, label, source, time) -> winners with a version that grows; rows later than the watermark are left out."""
    wait = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        best, version, seen = (None, 0, 0) if old is None else ((old[1], old[0], old[2]), old[3], old[4])
        changed = False
        for b in batches:
            for i, label, source, at in zip(b["id"], b["label"], b["source"], b["_ms"], strict=True):
                new = (bool(label), i, source)
                if best is None or _before(new, best):
                    best, changed = new, True
                seen = max(seen, int(at))
        version += changed
        state.update((best[1], best[0], best[2], version, seen))
        state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame([(key[0], best[1], best[0], best[2], version)], columns=["completion", "id", "label", "source", "version"])

    own = rows.withWatermark(time, delay).select("completion", F.col("id").cast("string").alias("id"), "label", "source", F.unix_millis(time).alias("_ms"), time)
    return own.groupBy("completion").applyInPandasWithState(run, WINNER, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(winners: DataFrame) -> DataFrame:
    """The last winner of each completion, from what the stream emitted."""
    last = F.max_by(F.struct("id", "label", "source"), "version")
    return winners.groupBy("completion").agg(last.alias("_l")).select("_l.id", "completion", "_l.label", "_l.source")
