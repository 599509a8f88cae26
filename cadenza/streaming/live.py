"""Greedy splits of live telemetry, by state for each activity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "activity_id long, split_id long, start_t double, end_t double, distance double, mean_heartrate double, n_samples long"
STATE = "split_id long, start_t double, start_distance double, heartrate double, n long, last_seq long"


def live_splits(telemetry: DataFrame, least_s: float = 10.0, idle_s: float | None = None) -> DataFrame:
    """A row for each split as it ends: a sample at least least_s after the split's first ends it and starts the next.

    The stream has activity_id, seq, t, distance and heartrate; an activity's samples come in the order of seq, and
    samples that have been seen are left out. State is one row for each activity. With idle_s it goes after so many
    seconds of the clock without a sample, and the open split with it; samples that come after that begin the activity anew.
    Spark goes on making batches to look at the clock, so a query that should end with its data, as with availableNow, needs
    spark.sql.streaming.noDataMicroBatches.enabled to be false."""

    def ended(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        split, start, at, hr, n, last = state.get if state.exists else (0, None, None, 0.0, 0, -1)
        found = []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            if r.seq <= last:
                continue
            last = int(r.seq)
            if start is None:
                start, at = float(r.t), float(r.distance)
            elif r.t - start >= least_s:
                found.append((key[0], split, start, float(r.t), float(r.distance) - at, hr / n if n else None, n))
                split, start, at, hr, n = split + 1, float(r.t), float(r.distance), 0.0, 0
            hr, n = hr + float(r.heartrate), n + 1
        state.update((split, start, at, hr, n, last))
        if idle_s is not None:
            state.setTimeoutDuration(int(idle_s * 1000))
        yield pd.DataFrame(found, columns=["activity_id", "split_id", "start_t", "end_t", "distance", "mean_heartrate", "n_samples"])

    return telemetry.groupBy("activity_id").applyInPandasWithState(ended, STEP, STATE, "append", GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout)
