"""Steps between samples, moving flags, cumulative axes and rolling means: window functions over one activity's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.functions import running as R


def order():
    """An activity's samples in their order."""
    return Window.partitionBy("activity_id").orderBy("seq")


def so_far():
    """From an activity's first sample to the present one."""
    return order().rowsBetween(Window.unboundedPreceding, 0)


def with_deltas(telemetry: DataFrame, altitude: str = "altitude") -> DataFrame:
    """dt, dd and da beside every sample; null at an activity's first."""
    back = lambda c: F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(order())
    return telemetry.withColumns({"dt": back("t"), "dd": back("distance"), "da": back(altitude)})


def steps(telemetry: DataFrame) -> DataFrame:
    """One row per step, named by its right sample, with speed (km/h) and gradient (m/km); null where a step has no time or no way."""
    found = with_deltas(telemetry).filter(F.col("dt").isNotNull())
    return found.withColumns({"speed": R.kmh(F.col("dd"), F.col("dt")), "elevation_gain": R.m_per_km(F.col("da"), F.col("dd"))})


def moving_race() -> Column:
    """A step of a race counts unless time stands still or the watch was paused."""
    return F.coalesce((F.col("dt") > 0) & (F.col("dt") <= C.PAUSE_S), F.lit(False))


def moving_progress() -> Column:
    """As in a race, and some way was made."""
    return moving_race() & F.coalesce(F.col("dd") > 0, F.lit(False))


def moving_axes(stepped: DataFrame) -> DataFrame:
    """moving_time and moving_distance so far; paused steps add nothing."""
    of = lambda c: F.sum(F.when(moving_race(), F.col(c)).otherwise(0.0)).over(so_far())
    return stepped.withColumns({"moving_time": of("dt"), "moving_distance": of("dd")})


def rolling_mean(value: Column, seconds: float, time: str = "t") -> Column:
    """Mean of the values in (t - seconds, t] of an activity; nulls are skipped, a window of nulls gives null.

    Samples that share a time share the window, so times should be different within an activity."""
    nanos = (F.col(time).cast("double") * 1e9).cast("long")
    frame = Window.partitionBy("activity_id").orderBy(nanos).rangeBetween(-(int(seconds * 1e9) - 1), 0)
    return F.avg(value).over(frame)


def quarantined(telemetry: DataFrame) -> DataFrame:
    """(activity_id, reason) of activities whose samples can't be analysed: fewer than two, or times that go back."""
    back = F.col("t") < F.lag("t").over(order())
    told = telemetry.withColumn("back", back).groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("back").alias("back"))
    reason = F.when(F.col("n") < 2, "too few samples").when(F.col("back"), "time goes back")
    return told.select("activity_id", reason.alias("reason")).filter("reason is not null")


def workouts(telemetry: DataFrame) -> DataFrame:
    """elapsed (s), distance (m), samples and a default label of each activity."""
    last = lambda c: F.max_by(c, "seq") - F.min_by(c, "seq")
    told = telemetry.groupBy("activity_id").agg(last("t").alias("elapsed"), last("distance").alias("distance"), F.count(F.lit(1)).alias("samples"))
    return told.withColumn("label", F.concat(F.lit("Activity "), F.col("activity_id").cast("string")))


def numbered_labels(rows: DataFrame, name: str = "label", key: str = "activity_id") -> DataFrame:
    """Repeated labels get ' (k)' from their second use on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(key))
    return rows.withColumn(name, F.when(k > 1, F.concat(F.col(name), F.lit(" ("), (k - 1).cast("string"), F.lit(")"))).otherwise(F.col(name)))
