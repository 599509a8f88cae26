"""Greedy splits: a split ends at the first sample that is far enough from the split's own start, so boundaries drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import constants as C
from cadenza.operators.steps import order


def cuts(key: np.ndarray, least: float) -> list[int]:
    """The samples at which splits end. Keys that don't fall are searched from cut to cut; others are walked."""
    found, at, n = [], 0, len(key)
    if n and (np.diff(key) >= 0).all():
        while True:
            k = int(np.searchsorted(key, key[at] + least, side="left"))
            while k < n and not key[k] - key[at] >= least:
                k += 1
            if k >= n:
                return found
            found.append(k)
            at = k
    for i in range(1, n):
        if key[i] - key[at] >= least:
            found.append(i)
            at = i
    return found


def with_split(stepped: DataFrame, key: str, least: float) -> DataFrame:
    """The steps with split_id, counted from 0 in each activity; steps after the last cut are left out.

    An activity is walked in batches, in the order that the window leaves it in; what a task holds is a batch and the
    steps of the split that is still open."""
    schema = T.StructType([*stepped.schema.fields, T.StructField("split_id", T.LongType())])
    names = [f.name for f in stepped.schema.fields]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the open split's steps; the key of its first is the start
        start, split, last = np.nan, 0, 0
        for rows in batches:
            if not (np.diff(rows["_i"].to_numpy(), prepend=last) == 1).all():
                raise RuntimeError("an activity's steps came out of their order")
            last, keys = int(rows["_i"].iloc[-1]), rows[key].to_numpy(float)
            ends = np.array(cuts(np.append(start, keys), least), dtype=np.int64) - 1 if held else np.array(cuts(keys, least), dtype=np.int64)
            if not len(ends):
                start = start if held else keys[0]
                held.append(rows)
                continue
            whole, before = pd.concat([*held, rows.iloc[: ends[-1]]]), sum(map(len, held))
            yield whole[names].assign(split_id=split + np.searchsorted(before + ends, np.arange(len(whole)), side="right").astype(np.int64))
            held, start, split = [rows.iloc[ends[-1] :]], keys[ends[-1]], split + len(ends)

    return stepped.withColumn("_i", F.row_number().over(order())).groupBy("activity_id").applyInPandas(walk, schema)


def split_means(divided: DataFrame) -> DataFrame:
    """Means of a split's steps; mixed: it goes both up and down; poisoned: a step without time or way, whose mean isn't finite."""
    dd, dt, da = F.col("dd"), F.col("dt"), F.col("da")
    up = ((dd > 0) & (da > 0)) | ((dd < 0) & (da < 0)) | ((dd == 0) & (da > 0))
    down = ((dd > 0) & (da < 0)) | ((dd < 0) & (da > 0)) | ((dd == 0) & (da < 0))
    return divided.groupBy("activity_id", "split_id").agg(
        F.avg("speed").alias("speed"),
        F.avg("elevation_gain").alias("elevation_gain"),
        F.avg("heartrate").alias("heartrate"),
        F.count(F.lit(1)).alias("n_steps"),
        (F.bool_or(up) & F.bool_or(down)).alias("mixed"),
        F.bool_or((dd == 0) | (dt == 0) | dd.isNull() | dt.isNull()).alias("poisoned"),
    )


def greedy_splits(stepped: DataFrame, least_s: float = 10.0, warmup_s: float = C.WARMUP_S) -> DataFrame:
    """Splits by time, after the warm-up."""
    return split_means(with_split(stepped.filter(F.col("t") >= warmup_s), "t", least_s))


def distance_splits(stepped: DataFrame, least_m: float = 20.0) -> DataFrame:
    """Splits by distance, the mixed ones marked."""
    return split_means(with_split(stepped, "distance", least_m))


def usable_splits(splits: DataFrame, elevation=C.ELEVATION_RANGE, speed=C.SPEED_RANGE) -> DataFrame:
    """Splits that go one way, are finite, and lie within the ranges, edges included."""
    kept = ~F.col("mixed") & ~F.col("poisoned") & F.col("elevation_gain").between(*elevation) & F.col("speed").between(*speed)
    return splits.filter(kept).select("activity_id", "split_id", "speed", "elevation_gain", "heartrate")
