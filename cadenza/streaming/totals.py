"""Season totals kept up to date: sums of each day, merged with those of every batch that arrives.

All season aggregates are sums over days, so the kept state is one row for each day, however many activities there are.
A batch's sums are added to the last state before it, and written as a version of its own: a batch that is replayed after a
failure writes the same version anew from the same one before it, and is counted once.
"""

from __future__ import annotations

from functools import partial

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza import constants as C
from cadenza.functions import running as R
from cadenza.operators import seasons

SUMS = ("distance_m", "elevation_gain_m", *[b for b, _, _ in C.GRADIENT_BANDS], "ratio_sum")
COUNTS = ("ratio_n", "n")
#: Versions that stay: the last, and the one before it, from which a replayed batch starts.
KEPT = 2


def day_partials(summaries: DataFrame) -> DataFrame:
    """Sums and counts of each day. Null values add nothing; activities without a date are a day of their own."""
    own = summaries.withColumns({"ratio_sum": F.col("power_to_hr"), "ratio_n": F.when(F.col("power_to_hr").isNotNull(), 1).otherwise(0), "n": F.lit(1)})
    return merged(own)


def merged(partials: DataFrame) -> DataFrame:
    """One row for each day of partials from any number of places, in any order."""
    return partials.groupBy("date").agg(*[F.sum(c).alias(c) for c in SUMS], *[F.sum(c).cast("long").alias(c) for c in COUNTS])


def versions(folder: str) -> list[int]:
    """The batches whose state is whole, in order."""
    store, top = fs.FileSystem.from_uri(folder)
    told = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    names = [f.base_name for f in told if f.type == fs.FileType.Directory and f.base_name.startswith("batch-")]
    return sorted(int(n[6:]) for n in names if store.get_file_info(f"{top}/{n}/_SUCCESS").type == fs.FileType.File)


def state_at(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/batch-{batch}")


def merge_batch(folder: str, summaries: DataFrame, batch: int) -> None:
    """Adds a batch's days to the last state before it; older versions than that are deleted."""
    spark, own = summaries.sparkSession, day_partials(summaries)
    before = [v for v in versions(folder) if v < batch]
    if before:
        own = merged(own.unionByName(state_at(spark, folder, before[-1])))
    own.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
    store, top = fs.FileSystem.from_uri(folder)
    for old in before[: 1 - KEPT]:
        store.delete_dir(f"{top}/batch-{old}")


def keep_totals(summaries: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs over a stream of summaries; folder and checkpoint are URIs of a shared place. Each activity has to arrive once."""
    sink = summaries.writeStream.foreachBatch(partial(merge_batch, folder))
    return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The days of the last state: `seasons.average_gradient`, `season_gradient` and `gradient_map` take them as they take activities."""
    there = versions(folder)
    if not there:
        raise FileNotFoundError(f"no state in {folder}")
    return state_at(spark, folder, there[-1])


def power_to_hr(days: DataFrame, granularity: str = "week") -> DataFrame:
    """As seasons.power_to_hr_bins, from days."""
    start = R.bin_start(F.col("date"), granularity)
    told = days.filter("ratio_n > 0").groupBy(start.alias("x")).agg((F.sum("ratio_sum") / F.sum("ratio_n")).alias("power_to_hr"))
    return told.select(F.year("x").alias("year"), "x", "power_to_hr")


def annual_days(days: DataFrame, column: str, scale: float = 1.0) -> DataFrame:
    """(year, x, y, total): the running total of each year at the end of every day with an activity, on the year 2000."""
    dated = days.filter("date is not null").withColumn("activity_id", F.lit(0))
    return seasons.annual_cumulative(dated, column, scale).filter("ord > 0").select("year", "x", "y", "total")
