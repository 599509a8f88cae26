"""Long-term progress: one heavy summary row per activity, for the light season aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.functions import running as R
from cadenza.operators.records import best_efforts
from cadenza.operators.steps import moving_progress, with_deltas
from cadenza.plans.races import Filter, filtered


def progress_steps(telemetry: DataFrame, altitude: Filter = Filter(60.0, 500.0), order: int = 2) -> DataFrame:
    """Steps with moving, gradient_pct and band."""
    found = with_deltas(filtered(telemetry, "altitude", altitude, order)).filter("dt is not null")
    found = found.withColumns({"moving": moving_progress(), "gradient_pct": F.when(F.col("dd") > 0, F.col("da") / F.col("dd") * 100.0).otherwise(0.0)})
    return found.withColumn("band", R.band(F.col("gradient_pct")))


def band_seconds(stepped: DataFrame) -> DataFrame:
    """Moving seconds in each gradient band of each activity."""
    of = lambda name: F.sum(F.when(F.col("moving") & (F.col("band") == name), F.col("dt")).otherwise(0.0)).alias(name)
    return stepped.groupBy("activity_id").agg(*[of(name) for name, _, _ in C.GRADIENT_BANDS])


def activity_progress(telemetry: DataFrame, activities: DataFrame, mass_kg: float | None = None, altitude: Filter = Filter(60.0, 500.0), distances=C.PR_DISTANCES) -> DataFrame:
    """One row per dated activity of two samples or more: date, sport, distance, climb, moving and band seconds, best efforts, power to heart rate."""
    stepped = progress_steps(telemetry, altitude)
    speed = F.when(F.col("dt") > 0, F.col("dd") / F.col("dt")).otherwise(0.0)
    watts = R.power(speed, F.col("gradient_pct") * 10.0, mass_kg)
    valid = F.col("moving") & watts.isNotNull() & (F.col("heartrate") > 0)
    on = lambda c, where: F.sum(F.when(where, c).otherwise(0.0))
    bands = [on(F.col("dt"), F.col("moving") & (F.col("band") == b)).alias(b) for b, _, _ in C.GRADIENT_BANDS]
    told = stepped.groupBy("activity_id").agg(
        on(F.col("dd"), F.col("moving")).alias("distance_m"),
        on(F.col("da"), F.col("moving") & (F.col("da") > 0)).alias("elevation_gain_m"),
        on(F.col("dt"), F.col("moving")).alias("moving_seconds"),
        *bands,
        F.try_divide(F.avg(F.when(valid, watts)), F.avg(F.when(valid, F.col("heartrate")))).alias("power_to_hr"),
    )
    efforts = best_efforts(telemetry, distances).groupBy("activity_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "best_s"))).alias("best_efforts"))
    dated = activities.filter("start_date is not null").select("activity_id", F.col("start_date").cast("date").alias("date"), "sport_type")
    return dated.join(told, "activity_id").join(efforts, "activity_id", "left")
