"""Telemetry and activity sources, and the views that stand in for them on the driver's tables.

A source gives `telemetry` (activity_id, seq, t, distance, altitude, heartrate), one row per sample, and
`activities` (activity_id, sport_type, start_date). Filters and columns go into the scan by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TELEMETRY = ("activity_id", "seq", "t", "distance", "altitude", "heartrate")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


#: Events that one set of activities is made of, so that an activity's samples are bounded whatever the number of events.
BLOCK = 20_000


def telemetry_from_events(events: DataFrame, activities: int = 5, block: int = BLOCK) -> DataFrame:
    """Deterministic samples by integer arithmetic on event values: so many activities of each block of event ids, dealt by
    user. Activities grow in number with the events, and not in length."""
    activity = F.col("user_id") % activities + F.floor(F.col("event_id") / block) * activities
    numbered = events.select(
        activity.cast("long").alias("activity_id"),
        cents(F.col("value")).alias("cents"),
        (F.row_number().over(Window.partitionBy(activity).orderBy("event_id")) - 1).cast("long").alias("seq"),
    )
    seq, c = F.col("seq"), F.col("cents")
    phase = seq % 1500
    steps = numbered.select(
        "activity_id",
        "seq",
        F.when(seq == 0, 0).when(seq % 397 == 0, 90).otherwise(1 + c % 3).alias("dt"),
        F.when((seq == 0) | (seq % 211 == 0), 0).otherwise(100 + c % 300).alias("dd_cm"),
        F.when(seq == 0, 0).when(phase < 300, 12).when(phase < 600, -9).when(phase < 900, 0).when(phase < 1200, 40).otherwise(-40).alias("da_cm"),
        (120 + c % 60).cast("double").alias("heartrate"),
    )
    w = Window.partitionBy("activity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(w).cast("double") / 100.0
    return steps.select("activity_id", "seq", F.sum("dt").over(w).cast("long").alias("t"), run("dd_cm").alias("distance"), (500.0 + run("da_cm")).alias("altitude"), "heartrate")


def telemetry_sql(activities: int = 5, block: int = BLOCK) -> str:
    """The same samples in SQL."""
    activity = f"user_id % {activities} + event_id // {block} * {activities}"
    return f"""
  select activity_id, seq, cast(sum(dt) over w as bigint) as t, cast(sum(dd_cm) over w as double) / 100.0 as distance,
         500.0 + cast(sum(da_cm) over w as double) / 100.0 as altitude, cast(120 + cents % 60 as double) as heartrate
  from (select *, case when seq = 0 then 0 when seq % 397 = 0 then 90 else 1 + cents % 3 end as dt,
               case when seq = 0 or seq % 211 = 0 then 0 else 100 + cents % 300 end as dd_cm,
               case when seq = 0 then 0 when seq % 1500 < 300 then 12 when seq % 1500 < 600 then -9
                    when seq % 1500 < 900 then 0 when seq % 1500 < 1200 then 40 else -40 end as da_cm
        from (select cast({activity} as bigint) as activity_id, cast(round(value * 100) as bigint) as cents,
                     cast(row_number() over (partition by {activity} order by event_id) - 1 as bigint) as seq
              from events) b) s
  window w as (partition by activity_id order by seq rows between unbounded preceding and current row)"""


def summaries_from_orders(orders: DataFrame) -> DataFrame:
    """Activity summaries (one row per activity) derived from orders."""
    c = cents(F.col("o_totalprice"))
    part = lambda n: (c % n).cast("double")
    return orders.select(
        F.col("o_orderkey").cast("long").alias("activity_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "Run").otherwise("TrailRun").alias("sport_type"),
        (part(3000000) / 100.0).alias("distance_m"),
        (part(150000) / 100.0).alias("elevation_gain_m"),
        part(901).alias("steep_descent"),
        part(907).alias("gentle_descent"),
        part(1511).alias("flat"),
        part(911).alias("gentle_ascent"),
        part(919).alias("steep_ascent"),
        F.when(F.col("o_orderstatus") != "O", (180 + c % 600).cast("double")).alias("best_1km"),
        F.when(F.col("o_orderstatus") != "P", 1.0 + part(200) / 100.0).alias("power_to_hr"),
    )


SUMMARIES_SQL = """
  select cast(o_orderkey as bigint) as activity_id, cast(o_orderdate as date) as date,
         case when o_orderstatus = 'F' then 'Run' else 'TrailRun' end as sport_type,
         cast(cents % 3000000 as double) / 100.0 as distance_m, cast(cents % 150000 as double) / 100.0 as elevation_gain_m,
         cast(cents % 901 as double) as steep_descent, cast(cents % 907 as double) as gentle_descent,
         cast(cents % 1511 as double) as flat, cast(cents % 911 as double) as gentle_ascent, cast(cents % 919 as double) as steep_ascent,
         case when o_orderstatus = 'O' then null else cast(180 + cents % 600 as double) end as best_1km,
         case when o_orderstatus = 'P' then null else 1.0 + cast(cents % 200 as double) / 100.0 end as power_to_hr
  from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders) o"""


def decode_streams(raw: DataFrame) -> DataFrame:
    """Samples from rows with parallel arrays time, distance, altitude, heartrate: the array index becomes seq.

    Rows whose arrays differ in length give no samples; see mismatched_streams."""
    zipped = F.posexplode(F.arrays_zip("time", "distance", "altitude", "heartrate"))
    held = raw.filter(_even()).select("activity_id", zipped.alias("seq", "s"))
    return held.select("activity_id", F.col("seq").cast("long"), F.col("s.time").alias("t"), *[F.col(f"s.{c}").cast("double").alias(c) for c in TELEMETRY[3:]])


def mismatched_streams(raw: DataFrame) -> DataFrame:
    """The rows that decode_streams leaves out."""
    return raw.filter(~F.coalesce(_even(), F.lit(False)))


def _even() -> Column:
    n = F.size("time")
    return (n == F.size("distance")) & (n == F.size("altitude")) & (n == F.size("heartrate"))


class TableSource:
    """A source over a table of samples and one of activities: listing, many streams, one stream."""

    def __init__(self, telemetry: DataFrame, activities: DataFrame):
        self.telemetry, self.activities = telemetry, activities

    @classmethod
    def load(cls, spark: SparkSession, telemetry: str, activities: str, format: str = "parquet") -> TableSource:
        """From paths, in any format that Spark reads."""
        return cls(*(spark.read.format(format).load(path) for path in (telemetry, activities)))

    def list_activities(self, sport_types: Sequence[str] = (), from_date: datetime | None = None, to_date: datetime | None = None) -> DataFrame:
        """Activities of the sports (all if none is named) between the dates, both included; open where None."""
        found = self.activities
        if "has_heartrate" in found.columns:
            found = found.filter("has_heartrate")
        if sport_types:
            found = found.filter(F.col("sport_type").isin(*sport_types))
        if from_date is not None:
            found = found.filter(F.col("start_date") >= F.lit(from_date))
        if to_date is not None:
            found = found.filter(F.col("start_date") <= F.lit(to_date))
        return found.select("activity_id", "sport_type", "start_date")

    def fetch_streams(self, sport_types: Sequence[str] = (), from_date: datetime | None = None, to_date: datetime | None = None, max_activities: int | None = None) -> DataFrame:
        """Samples of the listed activities, the latest max_activities of them, with sport and date beside."""
        listed = self.list_activities(sport_types, from_date, to_date)
        if max_activities is not None:
            listed = listed.orderBy(F.col("start_date").desc_nulls_last(), "activity_id").limit(max_activities)
        return self.telemetry.select(*TELEMETRY).join(listed, "activity_id")

    def fetch_single_stream(self, activity_id: int) -> DataFrame:
        return self.telemetry.select(*TELEMETRY).filter(F.col("activity_id") == activity_id)


def history_summary(activities: DataFrame, date: str = "start_date") -> DataFrame:
    """first_date, last_date and n_activities; activities without a date count only in the last."""
    return activities.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_distinct("activity_id").alias("n_activities"))


def filter_streams(activities: DataFrame, sport_types: Sequence[str] = (), from_date=None, to_date=None) -> DataFrame:
    """Sport in the list (an empty list filters nothing) and date in the range; activities without a date pass."""
    kept = F.lit(True)
    if sport_types:
        kept = kept & F.col("sport_type").isin(*sport_types)
    date = F.col("start_date")
    if from_date is not None:
        kept = kept & (date.isNull() | (date >= F.lit(from_date)))
    if to_date is not None:
        kept = kept & (date.isNull() | (date <= F.lit(to_date)))
    return activities.filter(kept)


def write_curves_csv(curves: DataFrame, path: str) -> None:
    """Curves as CSV in long format."""
    export_curves(curves).write.mode("overwrite").option("header", True).csv(path)


def export_curves(curves: DataFrame) -> DataFrame:
    names = {"curve": "curve", "bin_center": "bin_center_m_per_km", "mean": "speed_adjuster_mean", "std": "speed_adjuster_std", "count": "sample_count"}
    return curves.select(*[F.col(a).alias(b) for a, b in names.items()])
