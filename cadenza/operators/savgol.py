"""Savitzky-Golay smoothing over distance: each sample takes the value, at its own place, of the parabola through the
nearest full window of samples. Inside an activity that window is centred; near its ends it is the first or the last one.

What the filter has to know of a whole activity (its length, the spacing of its samples, the neighbours of missing
values) comes from windows in Spark; the median spacing is taken by ranks, so that no task holds an activity's
spacings. The filter itself runs over blocks of an activity, each with a window's length of the samples on either side,
so an activity of any length is smoothed by many tasks of a bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.steps import order

#: Samples of an activity that are smoothed at once, at least a window of them.
BLOCK = 16_384


def window_polynomials(y: np.ndarray, width: int, degree: int) -> np.ndarray:
    """The coefficients of the least-squares polynomial of each full window, over places from -1 to 1 within it."""
    places = np.arange(width) - width // 2
    fit = np.linalg.pinv(np.vander(places / max(width // 2, 1), degree + 1, increasing=True))
    return np.stack([np.correlate(y, row, mode="valid") for row in fit], axis=1)


def at_nearest_window(y: np.ndarray, index: np.ndarray, n: int, width: int, degree: int) -> np.ndarray:
    """Smoothed values of consecutive samples; index: their places among the activity's n samples.

    A sample whose nearest window isn't whole among them gets no sensible value; callers leave it out."""
    half = width // 2
    centre = np.clip(index, half, n - 1 - half)
    told = window_polynomials(y, width, degree)
    told = told[np.clip(centre - half - index[0], 0, len(told) - 1)]
    return np.sum(told * ((index - centre) / max(half, 1))[:, None] ** np.arange(degree + 1), axis=1)


def odd(n: Column) -> Column:
    """n, or the odd number after it."""
    return n + 1 - F.pmod(n, F.lit(2))


def filled(value: Column, index: Column) -> Column:
    """The values, with missing ones on the straight line between their neighbours, or equal to the only one."""
    there = F.when(value.isNotNull(), F.struct(index.alias("i"), value.alias("v")))
    back = Window.partitionBy("activity_id").orderBy(F.col("seq").desc())
    a, b = (F.last(there, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (order(), back))
    line = a["v"] + (b["v"] - a["v"]) * (index - a["i"]) / (b["i"] - a["i"])
    return F.coalesce(value, line, a["v"], b["v"])


def prepared(rows: DataFrame, column: str, window_m: float, degree: int, distance: str) -> DataFrame:
    """The rows with _v (null where missing), _i (their place), _n (how many there are), _filled, _width and _applies."""
    whole, v, i = Window.partitionBy("activity_id"), F.col("_v"), F.col("_i")
    value, gap = F.col(column).cast("double"), F.col(distance) - F.lag(distance).over(order())
    held = rows.withColumns({"_v": F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value), "_i": F.row_number().over(order()) - 1, "_gap": gap})
    held = held.withColumns({"_n": F.count(F.lit(1)).over(whole), "_there": F.count(v).over(whole), "_filled": filled(v, i)})
    forward = F.when((F.col("_gap") > 0) & (F.col("_gap") < float("inf")), F.col("_gap"))
    held = held.withColumns({"_rank": F.row_number().over(whole.orderBy(forward.asc_nulls_last())), "_steps": F.count(forward).over(whole)})
    middle = (F.col("_rank") == F.floor((F.col("_steps") + 1) / 2)) | (F.col("_rank") == F.floor(F.col("_steps") / 2) + 1)
    held = held.withColumn("_spacing", F.coalesce(F.avg(F.when(middle, forward)).over(whole), F.lit(1.0)))  # the median, by ranks
    n = F.col("_n")
    held = held.withColumn("_width", F.least(F.greatest(odd(F.rint(F.lit(float(window_m)) / F.col("_spacing")).cast("long")), odd(F.lit(degree + 2))), n - 1 + n % 2).cast("int"))
    return held.withColumn("_applies", (n >= degree + 2) & (F.col("_there") >= 2) & (F.col("_width") > degree)).drop("_gap", "_there", "_spacing", "_rank", "_steps")


def savgol_by_activity(rows: DataFrame, column: str, to: str, window_m: float, degree: int = 2, distance: str = "distance", block: int = BLOCK) -> DataFrame:
    """The rows with the smoothed column.

    The window holds window_m by the activity's median spacing of samples, an odd number of them, degree + 2 or more and
    no more than there are. Missing and infinite values stay missing. Values stay as they are in activities with fewer than
    degree + 2 samples or fewer than two values, and where the window isn't longer than the degree. An activity is dealt in
    blocks of `block` samples or a window."""
    held, i = prepared(rows, column, window_m, degree, distance), F.col("_i")
    size = F.greatest(F.lit(block), F.col("_width"))
    own = F.floor(i / size)
    near = F.array(own, F.when((own > 0) & (i - own * size < F.col("_width")), own - 1), F.when((own + 1) * size - i <= F.col("_width"), own + 1))
    held = held.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(near)))
    schema = T.StructType([f for f in rows.schema.fields if f.name != to] + [T.StructField(to, T.DoubleType())])

    def smoothed(samples: pd.DataFrame) -> pd.DataFrame:
        samples = samples.sort_values("_i", kind="stable")
        first, mine = samples.iloc[0], (samples["_own"] == samples["_block"]).to_numpy()
        told = samples["_v"].to_numpy(float)
        if mine.any() and first["_applies"]:
            values = at_nearest_window(samples["_filled"].to_numpy(float), samples["_i"].to_numpy(), int(first["_n"]), int(first["_width"]), degree)
            told = np.where(np.isnan(told), np.nan, values)
        return samples.assign(**{to: told}).loc[mine, [f.name for f in schema.fields]]

    return held.groupBy("activity_id", "_block").applyInPandas(smoothed, schema)
