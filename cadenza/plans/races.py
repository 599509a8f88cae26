"""Race comparison: series on moving axes and one row of metrics for each race."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.functions import running as R
from cadenza.operators.savgol import savgol_by_activity
from cadenza.operators.steps import moving_axes, moving_race, rolling_mean, with_deltas

MOST_RACES = 4


@dataclass(frozen=True)
class Filter:
    """Smoothing of one signal: a rolling mean, then Savitzky-Golay; None or 0 leaves one out."""

    rolling_s: float | None = None
    savgol_m: float | None = None


@dataclass(frozen=True)
class Smoothing:
    pace: Filter = field(default_factory=lambda: Filter(15.0))
    altitude: Filter = field(default_factory=lambda: Filter(60.0, 500.0))
    heartrate: Filter = field(default_factory=lambda: Filter(60.0))
    power: Filter = field(default_factory=lambda: Filter(15.0))
    order: int = 2


def filtered(rows: DataFrame, column: str, by: Filter, order: int) -> DataFrame:
    if by.rolling_s and by.rolling_s > 0:
        rows = rows.withColumn(column, rolling_mean(F.col(column), by.rolling_s))
    if by.savgol_m and by.savgol_m > 0:
        rows = savgol_by_activity(rows, column, column, by.savgol_m, order)
    return rows


def gradient_pct() -> Column:
    """Rise by way in percent; 0 where a step is shorter than 0.1 m."""
    return F.when(F.col("dd") >= 0.1, F.col("da") / F.col("dd") * 100.0).otherwise(0.0)


def race_steps(telemetry: DataFrame, mass_kg: float | None = None, smoothing: Smoothing = Smoothing()) -> DataFrame:
    """Every step with smoothed pace, heart rate, adjusted pace, power and moving axes. All windows share one order by activity."""
    held = telemetry.withColumn("heartrate", F.col("heartrate").cast("double"))
    found = with_deltas(filtered(held, "altitude", smoothing.altitude, smoothing.order)).filter("dt is not null")
    found = found.withColumns({"moving": moving_race(), "gradient": gradient_pct() * 10.0})
    found = found.withColumn("factor", R.factor_at(F.col("gradient")))
    speed = F.when(F.col("dt") > 0, F.col("dd") / F.col("dt")).otherwise(0.0)
    low, high = (v / 3.6 for v in C.SPEED_LIMITS_KMH)
    found = found.withColumn("pace", F.when(F.col("moving"), 1000.0 / R.clip(speed, low, high)))
    found = filtered(found, "pace", smoothing.pace, smoothing.order)
    found = filtered(found, "heartrate", smoothing.heartrate, smoothing.order)
    found = found.withColumn("gap_pace", R.clip(F.col("pace") / F.col("factor"), *C.PACE_LIMITS))
    found = found.withColumn("power", R.power(R.inverse(F.col("pace"), 1000.0), F.col("gradient"), mass_kg))
    if mass_kg is not None:
        found = filtered(found, "power", smoothing.power, smoothing.order)
    return moving_axes(found.withColumn("power_to_hr", F.when(F.col("heartrate") > 0, F.col("power") / F.col("heartrate"))))


def race_series(stepped: DataFrame) -> DataFrame:
    return stepped.select("activity_id", "seq", F.col("moving_time").alias("time_s"), F.col("moving_distance").alias("distance_m"), F.col("gap_pace").alias("gap_pace_s_per_km"), "heartrate", F.col("power").alias("power_w"), "power_to_hr")


def race_metrics(stepped: DataFrame) -> DataFrame:
    """One row per race; sums over moving steps, power over all."""
    on = lambda c, where=None: F.sum(F.when(F.col("moving") if where is None else F.col("moving") & where, c).otherwise(0.0))
    told = stepped.groupBy("activity_id").agg(
        on(F.col("dd")).alias("dist"), on(F.col("dt")).alias("time_s"), on(F.col("dd") * F.col("factor")).alias("gap_dist"), on(F.col("da"), F.col("da") > 0).alias("elevation_gain_m"), F.avg("power").alias("avg_power_w")
    )
    pace = lambda c: R.inverse(F.when(F.col("time_s") > 0, F.col(c) / F.col("time_s")), 1000.0)
    return told.select("activity_id", (F.col("dist") / 1000.0).alias("distance_km"), "elevation_gain_m", "time_s", pace("dist").alias("avg_pace_s_per_km"), pace("gap_dist").alias("avg_gap_pace_s_per_km"), "avg_power_w")


def best_flags(metrics: DataFrame) -> DataFrame:
    """For each metric whether the race has the best value: the most distance and climb, the least time and paces. Flags need two races.

    The best values are one row, so they are sent to all."""
    most, least = ("distance_km", "elevation_gain_m"), ("time_s", "avg_pace_s_per_km", "avg_gap_pace_s_per_km")
    best = metrics.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(f"top_{c}") for c in most], *[F.min(c).alias(f"top_{c}") for c in least])
    beside = metrics.join(F.broadcast(best), F.lit(True))
    return beside.select("activity_id", *[F.coalesce((F.col("n") >= 2) & (F.col(c) == F.col(f"top_{c}")), F.lit(False)).alias(f"best_{c}") for c in (*most, *least)])


def selection_problems(requests: DataFrame, chosen: DataFrame, activities: DataFrame) -> DataFrame:
    """(request_id, reason) of the requests whose races can't be compared: none chosen, more than four, one chosen twice, or
    one that isn't among the activities; the first of them that applies.

    requests has a request_id, chosen request_id and activity_id, activities an activity_id once."""
    known = activities.select("activity_id", F.lit(True).alias("known"))
    told = chosen.join(known, "activity_id", "left").groupBy("request_id", "activity_id").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    told = told.groupBy("request_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count_if(F.col("known").isNull()).alias("unknown"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "no race").when(n > MOST_RACES, f"over {MOST_RACES} races").when(F.col("most") > 1, "a race twice").when(F.col("unknown") > 0, "unknown race")
    return requests.join(told, "request_id", "left").select("request_id", reason.alias("reason")).filter("reason is not null")


def compare_races(telemetry: DataFrame, races: list[tuple[int, str | None]], mass_kg: float | None = None, smoothing: Smoothing = Smoothing()) -> tuple[DataFrame, DataFrame]:
    """(metrics, series) of one to four chosen races, labelled and in the order given."""
    if not 1 <= len(races) <= MOST_RACES:
        raise ValueError(f"between 1 and {MOST_RACES} races can be compared")
    spark = telemetry.sparkSession
    rows = [(i, label or f"Activity {i}", k) for k, (i, label) in enumerate(races)]
    chosen = F.broadcast(spark.createDataFrame(rows, "activity_id long, label string, ord int"))  # four rows
    stepped = race_steps(telemetry.join(chosen.select("activity_id"), "activity_id", "left_semi"), mass_kg, smoothing)
    return race_metrics(stepped).join(chosen, "activity_id").orderBy("ord"), race_series(stepped).join(chosen, "activity_id")


def plot_axes(series: DataFrame) -> DataFrame:
    """Series in the units that plots show: minutes, kilometres, adjusted pace as a clock and as speed; and whether each metric is there at all."""
    any_of = {f"has_{c}": F.bool_or(F.col(c).isNotNull()) for c in ("gap_pace_s_per_km", "heartrate", "power_w", "power_to_hr")}
    there = series.groupBy("activity_id").agg(*[v.alias(k) for k, v in any_of.items()])
    told = series.withColumns({"time_min": F.col("time_s") / 60.0, "distance_km": F.col("distance_m") / 1000.0, "gap_speed_kmh": R.inverse(F.col("gap_pace_s_per_km"), 3600.0), "gap_clock": R.as_clock(F.col("gap_pace_s_per_km"))})
    return told.join(there, "activity_id")
