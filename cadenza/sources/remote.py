"""Streams fetched from a provider by a function of the caller's, in Spark tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("time", "distance", "altitude", "heartrate")
SCHEMA = "activity_id long, " + ", ".join(f"{k} array<double>" for k in KINDS) + ", error string"


def fetch_streams(listing: DataFrame, fetch: Callable[[int, Sequence[str], str], dict[str, list]], *, max_activities: int | None = None, resolution: str = "high", throttle_s: float = 0.1, tasks: int = 1, done: Accumulator | None = None) -> DataFrame:
    """One row per listed activity with its arrays, or with the error that fetching it raised and null arrays.

    fetch(activity_id, kinds, resolution) gives the arrays by kind. A task fetches its activities one by one and waits
    throttle_s after each that succeeds, so the provider sees at most tasks / throttle_s requests a second. The result
    should be written or checkpointed before it is used twice. Rows with arrays are for decode_streams.

    done: an accumulator (spark.sparkContext.accumulator(0)) that tells the driver how many activities have been tried, the
    failed ones too, while the tasks run; an activity that a lost task had tried counts again."""
    if max_activities is not None:
        listing = listing.orderBy(F.col("start_date").desc_nulls_last(), "activity_id").limit(max_activities)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in rows["activity_id"].tolist():
                try:
                    told = fetch(i, KINDS, resolution)
                    row = {"activity_id": i, **{k: [None if x is None else float(x) for x in told[k]] for k in KINDS}, "error": None}
                except Exception as e:  # one activity that fails doesn't end the others
                    row = {"activity_id": i, **dict.fromkeys(KINDS), "error": f"{type(e).__name__}: {e}"}
                if done is not None:
                    done.add(1)
                yield pd.DataFrame([row])
                if row["error"] is None:
                    time.sleep(throttle_s)

    return listing.select("activity_id").repartition(tasks, "activity_id").mapInPandas(run, SCHEMA)
