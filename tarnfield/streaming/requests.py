"""Request streams (an extension: the engine's own workloads are batches).

Requests arrive as a stream of (ts, key, cost); windowed counts tolerate late rows by a watermark, and the route of
each key follows a running mean that is kept as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, *, time: str = "ts", key: str = "key", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, requests, cost): counts per window; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), key)
    return rows.agg(F.count("*").alias("requests"), F.sum("cost").alias("cost")).select(F.col("window.start").alias("window_start"), key, "requests", "cost")


def running_routes(stream: DataFrame, *, key: str = "key", least: int = 3, limit: float = 1.0) -> DataFrame:
    """(key, requests, mean_cost, route): the state of each key after every batch that holds requests of it."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["cost"].sum())
        state.update((n, total))
        mean = total / n
        yield pd.DataFrame({key: [k[0]], "requests": [n], "mean_cost": [mean], "route": ["prefilter" if n >= least and mean < limit else "index"]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, requests bigint, mean_cost double, route string", "n bigint, total double", "append", GroupStateTimeout.NoTimeout)
