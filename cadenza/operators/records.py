"""Best efforts over distances, record progressions and current records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators.steps import order, so_far


def best_efforts(telemetry: DataFrame, distances=C.PR_DISTANCES) -> DataFrame:
    """(activity_id, label, meters, best_s): the least time over so many contiguous metres, to the point within a step;
    null where the activity is too short.

    For each start the first sample that is far enough is looked for in a range frame over reversed distance, so the
    search is a window and not a join; distance is made to never fall first. The frames of all distances are in one
    order, so the samples are sorted once."""
    far = F.max("distance").over(so_far())
    held = telemetry.select("activity_id", "seq", F.col("t").cast("double").alias("t"), far.alias("d"))
    held = held.withColumns({"t0": F.lag("t").over(order()), "d0": F.lag("d").over(order())})

    def first_beyond(meters: float) -> Column:
        return F.expr(f"min(struct(seq, t, d, t0, d0)) over (partition by activity_id order by -d range between unbounded preceding and {float(meters)!r}D preceding)")

    held = held.withColumns({f"beyond_{k}": first_beyond(m) for k, (_, m) in enumerate(distances)})
    beyond = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(float(m)).alias("meters"), F.col(f"beyond_{k}").alias("to")) for k, (label, m) in enumerate(distances)])
    found = held.select("activity_id", "t", "d", F.explode(beyond).alias("f")).select("activity_id", "t", "d", "f.*")
    span = F.col("to.d") - F.col("to.d0")
    share = F.when(span > 0, (F.col("d") + F.col("meters") - F.col("to.d0")) / span).otherwise(0.0)
    elapsed = F.col("to.t0") + share * (F.col("to.t") - F.col("to.t0")) - F.col("t")
    return found.groupBy("activity_id", "label", "meters").agg(F.min(F.when(elapsed > 0, elapsed)).alias("best_s"))


def record_progression(samples: DataFrame, by: str = "label") -> DataFrame:
    """(by, date, value) of the samples that beat all before them, in the order of date and value. Only a day's least
    value can do so, so days are reduced to it before they are ordered."""
    days = samples.filter("value is not null").groupBy(by, "date").agg(F.min("value").alias("value"))
    best = F.min("value").over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    return days.withColumn("best", best).filter(F.col("best").isNull() | (F.col("value") < F.col("best"))).drop("best")


def current_records(samples: DataFrame, by: str = "label", key: str = "activity_id") -> DataFrame:
    """The least value of each group and the date it was set; of equal values the first in order."""
    told = samples.groupBy(by).agg(F.min(F.when(F.col("value").isNotNull(), F.struct("value", key, "date"))).alias("r"))
    return told.select(by, F.col("r.date").alias("date"), F.col("r.value").alias("value"))
