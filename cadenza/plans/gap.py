"""Personalised gradient-adjusted-pace curves, for several time scales at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators import curves as K
from cadenza.operators.gbt import BoostedGap
from cadenza.operators.smoothing import loess_curves
from cadenza.operators.splits import greedy_splits, usable_splits
from cadenza.operators.steps import steps
from cadenza.session import kept
from cadenza.sources.activities import filter_streams

MOST_SCALES = 5


class GapModel(Protocol):
    """What a model of adjusted pace has to do: learn from splits, tell points' adjusted speeds, and tell its curve."""

    def fit(self, splits: DataFrame) -> GapModel: ...

    def predict(self, points: DataFrame) -> DataFrame: ...

    def curve(self, heartrate_range: tuple[float, float] | None = None) -> DataFrame: ...


def dataset(telemetry: DataFrame, least_s: float = 10.0, warmup_s: float = C.WARMUP_S) -> DataFrame:
    return usable_splits(greedy_splits(steps(telemetry), least_s, warmup_s))


def in_scale(start: object, end: object) -> Column:
    """Whether an activity's date is in the range, open where None; undated ones are in every range."""
    date, within = F.col("start_date"), F.lit(True)
    if start is not None:
        within = within & (date >= F.lit(start))
    if end is not None:
        within = within & (date <= F.lit(end))
    return date.isNull() | within


def valid_scales(scales: Sequence[tuple[str, object, object]]) -> None:
    """Raises unless there are one to five scales, each named and from no later than to."""
    if not 1 <= len(scales) <= MOST_SCALES:
        raise ValueError(f"between 1 and {MOST_SCALES} time scales")
    for name, start, end in scales:
        if not name or (start is not None and end is not None and start > end):
            raise ValueError(f"time scale {name!r} needs a name and an end after its start")


def scale_problems(requests: DataFrame, scales: DataFrame) -> DataFrame:
    """(request_id, reason) of the requests that `valid_scales` would refuse: no scale, more than five, one without a name,
    one that ends before it starts; the first of them that applies.

    requests has a request_id, scales request_id, name, start and end. A request's scales are reduced to counts before
    they meet it, so a request of any number of them is one row in the join."""
    told = scales.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("unnamed"),
        F.count_if(F.col("start") > F.col("end")).alias("turned"),
    )
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "no scale").when(n > MOST_SCALES, f"over {MOST_SCALES} scales").when(F.col("unnamed") > 0, "no name").when(F.col("turned") > 0, "ends before it starts")
    return requests.join(told, "request_id", "left").select("request_id", reason.alias("reason")).filter("reason is not null")


def personal_curves(
    telemetry: DataFrame,
    activities: DataFrame,
    scales: Sequence[tuple[str, object, object]] = (("all", None, None),),
    *,
    sport_types: Sequence[str] = (),
    intensities: Sequence[tuple[float, float]] = (),
    per_bucket: int = 250,
    efficiency: bool = True,
    boosted: bool = True,
    references: bool = True,
    split: Callable[[DataFrame], DataFrame] = dataset,
    model: Callable[[], GapModel] = BoostedGap,
    smooth: Callable[[DataFrame], DataFrame] | None = loess_curves,
) -> DataFrame:
    """(curve, bin_center, mean, std, count) of every scale's models, of each intensity (range of heart rates) within it,
    and of the published curves. Branches that aren't asked for are never planned.

    Telemetry is split once, and its splits are written to the shared folder; a split is in each scale that its activity's date is in. A scale without training rows
    has no boosted curve; an intensity without splits raises. Boosted curves are made at once, as the fit is: they are
    some tens of rows each."""
    valid_scales(scales)
    if not (efficiency or boosted or references):
        raise ValueError("no curve is asked for")
    within = [F.when(in_scale(start, end), F.lit(name)) for name, start, end in scales]
    listed = filter_streams(activities, sport_types).withColumn("scale", F.array_compact(F.array(*within))).filter(F.size("scale") > 0).select("activity_id", "scale")
    splits = split(telemetry.join(listed.select("activity_id"), "activity_id", "left_semi")).join(listed, "activity_id")
    splits = kept(splits.select("scale", "activity_id", "split_id", "speed", "elevation_gain", "heartrate")).withColumn("scale", F.explode("scale"))
    found: list[DataFrame] = []

    def add(curves: DataFrame, name: Column) -> None:
        found.append(curves.select(name.alias("curve"), "bin_center", "mean", "std", F.col("count").cast("long").alias("count")))

    if efficiency:
        add(K.equi_depth_curve(K.with_efficiency(splits, ["scale"]), per_bucket, ["scale"]), F.concat("scale", F.lit(" efficiency")))
        if intensities:
            strata = K.by_intensity(splits, intensities)
            lacking = {(n, f"{a:g}-{b:g}") for n, _, _ in scales for a, b in intensities} - {tuple(r) for r in strata.select("scale", "intensity").distinct().collect()}  # of five scales at most
            if lacking:
                raise ValueError(f"no split in {sorted(lacking)}")
            add(K.equi_depth_curve(K.with_efficiency(strata, ["scale", "intensity"]), per_bucket, ["scale", "intensity"]), F.concat("scale", F.lit(" efficiency "), "intensity"))
    if boosted:
        for name, _, _ in scales:
            try:
                fitted = model().fit(splits.filter(F.col("scale") == name).drop("scale"))
            except K.NothingToLearn:
                continue
            for heartrates in (None, *intensities):
                rows = fitted.curve(heartrates).select("bin_center", "mean", "std", "count")
                suffix = "" if heartrates is None else f" {heartrates[0]:g}-{heartrates[1]:g}"
                add(telemetry.sparkSession.createDataFrame(rows.collect(), rows.schema), F.lit(f"{name} boosted{suffix}"))
    curves = reduce(DataFrame.unionByName, found) if found else None
    if curves is not None and smooth is not None:
        curves = smooth(curves)
    if references:
        published = C.reference_curves(telemetry.sparkSession)
        curves = published if curves is None else curves.unionByName(published)
    return curves


def plot_band(curves: DataFrame) -> DataFrame:
    """The curves with the edges of their deviation bands."""
    return curves.withColumns({"low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")})
