"""Curve smoothers: centred rolling mean with repeated edges, and LOESS weighted by counts."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of all of a curve's fits, up to which they are solved as they are.
FITTED = 1_000_000


def rolling_mean_curve(curves: DataFrame, window: int = 5, columns: Sequence[str] = ("mean", "std"), order: Sequence[str] = ("bin_center",)) -> DataFrame:
    """Means over an odd window of neighbouring bins; beyond either end the end bin is repeated.

    The repeated bins are the window's shortfall on either side times the end value, so a ROWS frame is enough."""
    if window < 1:
        raise ValueError("window must be 1 or more")
    half = window // 2
    w = Window.partitionBy("curve").orderBy(*order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = w.rowsBetween(-half, half)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("curve"))
    before, after = F.greatest(F.lit(half) - (i - 1), F.lit(0)), F.greatest(F.lit(half) - (n - i), F.lit(0))
    mean = lambda c: (F.sum(c).over(near) + before * F.first(c).over(every) + after * F.last(c).over(every)) / (2 * half + 1)
    return curves.withColumns({c: mean(c) for c in columns})


def loess(x: np.ndarray, y: np.ndarray, counts: np.ndarray, fraction: float = 0.4, degree: int = 2) -> np.ndarray:
    """Local polynomial fits of a curve whose x don't fall, with tricube weights by distance times the bins' counts.
    Bins without a value take no part and stay missing; a curve of degree + 1 bins or fewer stays as it is.

    The nearest bins of a bin stand side by side, so every fit is a row of one array: its first bin is found by
    bisection, since a run of bins is best placed as soon as the bin after it is no nearer than its first. Fits of up to
    FITTED points in all are solved at once; of longer curves, whose points would grow with the square of the bins, each
    fit is put together from sums of halves, quarters and so on of the curve (`levels`)."""
    told, found = np.flatnonzero(np.isfinite(y)), np.array(y, dtype=float)
    n = len(told)
    if n <= degree + 1:
        return found
    x, y, many = x[told], y[told], counts[told].astype(float)
    many = many if many.any() else np.ones(n)
    run = min(n, max(degree + 1, int(np.ceil(fraction * n))))
    first = np.searchsorted(x[: n - run] + x[run:], 2 * x)
    if n * run > FITTED:
        found[told] = levels(x, y, many, first, run, degree)
        return found
    bins = first[:, None] + np.arange(run)
    away = x[bins] - x[:, None]
    reach = np.abs(away[:, [0, -1]]).max(axis=1, keepdims=True)
    weight = np.sqrt((1 - np.abs(np.divide(away, reach, out=np.zeros_like(away), where=reach > 0)) ** 3) ** 3 * many[bins])
    design = weight[..., None] * away[..., None] ** np.arange(degree + 1)
    level = (np.linalg.pinv(design, rcond=run * np.finfo(float).eps) @ (weight * y[bins])[..., None])[:, 0, 0]
    found[told] = np.where(weight.any(axis=1), level, y)
    return found


def shifted(moments: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sums of powers around one point (rows, powers, kinds) as sums around another, by away from the first."""
    powers = moments.shape[1]
    steps = by[:, None] ** np.arange(powers)
    told = np.zeros_like(moments)
    for j in range(powers):
        for i in range(j + 1):
            told[:, j] += comb(j, i) * steps[:, j - i, None] * moments[:, i]
    return told


def levels(x: np.ndarray, y: np.ndarray, many: np.ndarray, first: np.ndarray, run: int, degree: int) -> np.ndarray:
    """The fits' values at all bins, each over the run of bins from its first on, in n log n steps.

    On either side of a bin the tricube weights are a polynomial of the distance, so a fit's sums are sums of powers of
    distances. Those are kept around the middles of blocks of 1, 2, 4, ... bins; a side of a run is at most two blocks of
    each size, whose sums are moved to the bin in units of the fit's reach."""
    n, powers = len(x), 10 + 2 * degree
    reach = np.maximum(x - x[first], x[first + run - 1] - x)
    unit = np.where(reach > 0, reach, 1.0)
    middle, blocks = x, np.zeros((n, powers, 2))
    blocks[:, 0, 0], blocks[:, 0, 1] = many, many * y
    own = np.arange(n)
    sides = [(first.copy(), own.copy(), np.zeros((n, powers, 2))), (own.copy(), first + run, np.zeros((n, powers, 2)))]
    while any((low < high).any() for low, high, _ in sides):
        if len(middle) % 2:
            middle, blocks = np.append(middle, middle[-1]), np.concatenate([blocks, np.zeros((1, powers, 2))])
        for k, (low, high, sums) in enumerate(sides):
            for at, taken in ((low, (low < high) & (low % 2 == 1)), (high - 1, (low < high) & (high % 2 == 1))):
                fit = np.flatnonzero(taken & (at >= low))
                scale = unit[fit, None] ** -np.arange(powers)
                sums[fit] += shifted(blocks[at[fit]] * scale[..., None], (middle[at[fit]] - x[fit]) / unit[fit])
                if at is low:
                    low = low + taken
            sides[k] = (low // 2, high // 2, sums)
        upper = (middle[::2] + middle[1::2]) / 2
        blocks = shifted(blocks[::2], middle[::2] - upper) + shifted(blocks[1::2], middle[1::2] - upper)
        middle = upper
    weighted = np.zeros((n, 2 * degree + 1, 2))
    for sign, (_, _, sums) in zip((1, -1), sides, strict=True):
        for i in range(4):
            weighted += comb(3, i) * sign**i * sums[:, 3 * i : 3 * i + 2 * degree + 1]
    place = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))
    level = (np.linalg.pinv(weighted[:, place, 0], rcond=1e-13, hermitian=True) @ weighted[:, : degree + 1, 1, None])[:, 0, 0]
    counted = sides[0][2][:, 0, 0] + sides[1][2][:, 0, 0]
    return np.where(weighted[:, 0, 0] > 1e-12 * counted, level, y)


def loess_curves(curves: DataFrame, fraction: float = 0.4, degree: int = 2, columns: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Each curve smoothed on its own; a task has one curve's bins, a row for each bucket of splits."""
    if not 0 < fraction <= 1 or degree < 1:
        raise ValueError("fraction must be in (0, 1] and degree 1 or more")
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in curves.schema.fields])

    def one(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin_center", kind="stable")
        x, counts = bins["bin_center"].to_numpy(float), bins["count"].to_numpy(float)
        return bins.assign(**{c: loess(x, bins[c].to_numpy(float), counts, fraction, degree) for c in columns})

    return curves.groupBy("curve").applyInPandas(one, schema)
