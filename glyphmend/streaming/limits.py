"""Sliding-window rate limits: a request is admitted if fewer than ``allowance`` were admitted in its window.

Admission is recursive (rejected requests do not count), so each user's requests are taken in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import NumericType

ALLOWANCE, WINDOW_S = 60, 60.0


def admit(times: list[float], held: deque, allowance: int, window: float) -> list[bool]:
    """Whether each of the times, in order, is admitted; held has the admitted ones and changes."""
    out = []
    for t in times:
        while held and t - held[0] > window:
            held.popleft()
        out.append(len(held) < allowance)
        if out[-1]:
            held.append(t)
    return out


def _seconds(requests: DataFrame, time_col: str) -> Column:
    """The time as seconds: numbers as they are, dates and timestamps with or without a zone since 1970."""
    c = F.col(time_col)
    return c.cast("double") if isinstance(requests.schema[time_col].dataType, NumericType) else c.cast("timestamp").cast("double")


def limited(requests: DataFrame, *, user_col: str, time_col: str, id_col: str, allowance: int = ALLOWANCE, window: float = WINDOW_S) -> DataFrame:
    """id, user, admitted.  Users are sorted inside partitions and streamed in batches, so a busy user needs no memory but its window."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = object(), deque()
        for b in batches:
            parts = []
            for u, part in b.groupby("u", sort=False, dropna=False):
                if u != user:
                    user, held = u, deque()
                parts.append(pd.DataFrame({"i": part["i"], "u": part["u"], "admitted": admit(part["t"].tolist(), held, allowance, window)}))
            if parts:
                yield pd.concat(parts)

    rows = requests.select(F.col(id_col).alias("i"), F.col(user_col).alias("u"), _seconds(requests, time_col).alias("t"))
    out = rows.repartition("u").sortWithinPartitions("u", "t", "i").mapInPandas(run, f"i {kinds[id_col]}, u {kinds[user_col]}, admitted boolean")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(user_col), "admitted")


def limited_stream(requests: DataFrame, *, user_col: str, time_col: str, id_col: str, allowance: int = ALLOWANCE, window: float = WINDOW_S) -> DataFrame:
    """The same over a stream in time order: the state of a user is its admitted times in the window."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["t", "i"])
        admitted = admit(rows["t"].tolist(), held, allowance, window)
        state.update((list(held),))
        yield pd.DataFrame({"i": rows["i"], "u": rows["u"], "admitted": admitted})

    rows = requests.select(F.col(id_col).alias("i"), F.col(user_col).alias("u"), _seconds(requests, time_col).alias("t"))
    out = rows.groupBy("u").applyInPandasWithState(run, f"i {kinds[id_col]}, u {kinds[user_col]}, admitted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("i").alias(id_col), F.col("u").alias(user_col), "admitted")
