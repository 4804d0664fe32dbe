"""Sliding-window limiter over a stream: after ``most`` failures within ``seconds`` a key is locked; attempts while locked don't count.

The state of a key goes once the watermark has passed the last attempt by the length of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, id long, refused boolean, retry_after long"
STATE = "times array<long>"


def decide(times: list[int], now: int, ok: bool, most: int, window: int) -> tuple[list[int], bool, int]:
    """New failure times (microseconds), whether the attempt is refused, and the seconds to wait."""
    times = [t for t in times if t > now - window]
    if len(times) >= most:
        return times, True, max(1, -((times[0] + window - now) // -1_000_000))
    return ([] if ok else [*times, now]), False, 0


def limit(attempts: DataFrame, most: int = 5, seconds: int = 900, lateness: str = "1 hour") -> DataFrame:
    """key, id, refused, retry_after of a stream attempts(key string, id long, us long, ok boolean); rows of a batch are taken in time order.

    lateness: how far behind the latest attempt others may come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = []
        for r in pd.concat(list(batches)).sort_values(["us", "id"]).itertuples():
            times, refused, wait = decide(times, int(r.us), bool(r.ok), most, seconds * 1_000_000)
            rows.append((key[0], int(r.id), refused, wait))
        state.update((times,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(times, default=0) // 1000) + seconds * 1000))
        yield pd.DataFrame(rows, columns=["key", "id", "refused", "retry_after"])

    # a millisecond later, as the watermark begins at the epoch
    timed = attempts.withColumn("at", F.timestamp_micros(F.col("us") + 1000)).withWatermark("at", lateness)
    return timed.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(attempts: DataFrame, most: int = 5, seconds: int = 900) -> DataFrame:
    """key, id, refused, retry_after of stored attempts(key string, id long, us long, ok boolean), which stream through in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.key != key:
                    key, times = r.key, []
                times, refused, wait = decide(times, int(r.us), bool(r.ok), most, seconds * 1_000_000)
                rows.append((key, int(r.id), refused, wait))
            yield pd.DataFrame(rows, columns=["key", "id", "refused", "retry_after"])

    return attempts.select("key", "id", "us", "ok").repartition("key").sortWithinPartitions("key", "us", "id").mapInPandas(run, OUT)
