"""Season aggregates over activity summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.functions import running as R

BANDS = [name for name, _, _ in C.GRADIENT_BANDS]


def annual_cumulative(summaries: DataFrame, column: str, scale: float = 1.0) -> DataFrame:
    """(year, ord, x, y, total): running totals of each year on the year 2000, from a zero on January 1st (ord 0).

    Only days' sums are ordered over a year; rows are ordered within their day."""
    held = summaries.select(F.year("date").alias("year"), "date", "activity_id", (F.col(column) * scale).alias("v"))
    days = held.groupBy("year", "date").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("year").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        "date", F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("v0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("v").over(Window.partitionBy("year")).alias("total")
    )
    day = Window.partitionBy("date").orderBy("activity_id")
    told = held.withColumns({"nth": F.row_number().over(day), "upto": F.sum("v").over(day.rowsBetween(Window.unboundedPreceding, 0))}).join(days, "date")
    told = told.select("year", (F.col("n0") + F.col("nth")).alias("ord"), R.reference_date(F.col("date")).alias("x"), (F.col("v0") + F.col("upto")).alias("y"), "total")
    totals = held.groupBy("year").agg(F.sum("v").alias("total"))
    zero = totals.select("year", F.lit(0).cast("long").alias("ord"), F.lit("2000-01-01").cast("date").alias("x"), F.lit(0.0).alias("y"), "total")
    return told.unionByName(zero)


def average_gradient(summaries: DataFrame, granularity: str = "week") -> DataFrame:
    """(year, x, gradient): climb by distance in percent for each bin of a year, and each year's season_avg beside it."""
    bins = summaries.groupBy(F.year("date").alias("year"), R.within_year_bin(F.col("date"), granularity).alias("bin")).agg(F.sum("distance_m").alias("dist"), F.sum("elevation_gain_m").alias("climb"))
    season = Window.partitionBy("year")
    all_dist, all_climb = F.sum("dist").over(season), F.sum("climb").over(season)
    told = bins.withColumn("season_avg", F.when(all_dist > 0, all_climb / all_dist * 100.0).otherwise(0.0))
    return told.filter("dist > 0").select("year", R.reference_bin(F.col("bin"), granularity).alias("x"), (F.col("climb") / F.col("dist") * 100.0).alias("gradient"), "season_avg")


def season_gradient(summaries: DataFrame) -> DataFrame:
    """The ratio of sums for each year, and for all of them (null year)."""
    told = summaries.rollup(F.year("date").alias("year")).agg(F.sum("distance_m").alias("dist"), F.sum("elevation_gain_m").alias("climb"))
    return told.select("year", F.when(F.col("dist") > 0, F.col("climb") / F.col("dist") * 100.0).otherwise(0.0).alias("gradient"))


def power_to_hr_bins(summaries: DataFrame, granularity: str = "week") -> DataFrame:
    """(year, x, power_to_hr): mean of the sessions' ratios for each real calendar bin; the year is that of its start."""
    start = R.bin_start(F.col("date"), granularity)
    told = summaries.filter("power_to_hr is not null").groupBy(start.alias("x")).agg(F.avg("power_to_hr").alias("power_to_hr"))
    return told.select(F.year("x").alias("year"), "x", "power_to_hr")


def gradient_map(summaries: DataFrame, granularity: str = "week", from_date=None, to_date=None) -> DataFrame:
    """(x, band, pct): each band's share of moving time in every bin of the real calendar, bins without time left out."""
    kept = summaries
    if from_date is not None:
        kept = kept.filter(F.col("date") >= F.lit(from_date))
    if to_date is not None:
        kept = kept.filter(F.col("date") <= F.lit(to_date))
    sums = kept.groupBy(R.bin_start(F.col("date"), granularity).alias("x")).agg(*[F.sum(F.coalesce(b, F.lit(0.0))).alias(b) for b in BANDS])
    total = sum((F.col(b) for b in BANDS[1:]), F.col(BANDS[0]))
    long = sums.withColumn("all", total).filter("all > 0").unpivot(["x", "all"], BANDS, "band", "seconds")
    return long.select("x", "band", (F.col("seconds") / F.col("all") * 100.0).alias("pct"))
