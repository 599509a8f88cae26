"""Global ranks and exact medians without a global window: counts of buckets are ordered, rows only within their bucket.

Buckets are cut where sketches of the values say that equal shares of the rows lie, so they are alike in size whatever the
values are. A value that fills a share by itself is a bucket of its own, cut again by the first of the keys that order its
ties. Where the cuts lie decides how the work is dealt and nothing else: ranks are exact with any cuts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket is meant to hold SHARE rows or a PARTS-th of them, whichever is more; sketches are good to a 12th of that.
PARTS, SHARE, SKETCH = 1024, 1000, 4096


@dataclass(frozen=True)
class Cuts:
    """Where values are cut, which values are buckets of their own, and where those are cut by their first tie key."""

    values: tuple[float, ...] = ()
    hot: tuple[float, ...] = ()
    ties: tuple[float, ...] = ()


def clean(value: str) -> Column:
    """The value as a double, without a negative zero: it's equal to zero in Spark's order, but not where it is bisected."""
    return F.col(value).cast("double") + F.lit(0.0)


def quantiles(rows: DataFrame, value: Column, by: Sequence[str], parts: int, share: int) -> list[list[float]]:
    """For each group the values that cut it into buckets of equal size, in order and as often as they do."""
    told = rows.filter(value.isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("s"))
    n = F.kll_sketch_get_n_double("s")
    at = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(k / parts) for k in range(1, parts)]))
    found = []
    for r in told.select(n.alias("n"), F.when(n > share, at).alias("at")).collect():  # parts numbers for each group
        own = min(parts, r["n"] // share)
        found.append([r["at"][k * parts // own - 1] for k in range(1, own)] if own > 1 else [])
    return found


def cuts(rows: DataFrame, value: str, ties: Sequence[str], by: Sequence[str] = (), parts: int = PARTS, share: int = SHARE) -> Cuts:
    """Looked up in sketches, at once: one pass over the rows, and a second over the rows of values that fill a bucket by
    themselves if there are such. The first tie key has to be a number for those to be cut again.

    What comes to the driver is at most parts numbers for each group of by, of which there should be few."""
    groups = quantiles(rows, clean(value), by, parts, share)
    hot = sorted({a for own in groups for a, b in zip(own, own[1:]) if a == b and math.isfinite(a)})
    if not hot:
        return Cuts(tuple(sorted({x for own in groups for x in own})))
    held = rows.withColumn("_hot", clean(value)).filter(F.col("_hot").isin(hot))
    within = quantiles(held, F.col(ties[0]).cast("double"), [*by, "_hot"], parts, share)
    return Cuts(tuple(sorted({x for own in groups for x in own} | {math.nextafter(x, math.inf) for x in hot} | set(hot))), tuple(hot), tuple(sorted({x for own in within for x in own})))


def bucketed(rows: DataFrame, column: str, to: str, at: Sequence[float]) -> DataFrame:
    """The rows with the number of cuts that aren't beyond the value; the search is a bisection in the JVM. Nulls stay null."""
    inner = [x for x in at if math.isfinite(x)]
    if not inner:
        return rows.withColumn(to, F.when(F.col(column).isNotNull(), 0.0))
    return Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=column, outputCol=to, handleInvalid="keep").transform(rows)


def ranked(rows: DataFrame, value: str, ties: Sequence[str], by: Sequence[str] = (), to: str = "rank", at: Cuts | None = None) -> DataFrame:
    """The rows with their rank from 0 in the order of value and ties, within the groups of by, and the group's size as n.
    Rows without a value have no rank and are left out, and so are those with a null in by; NaN comes last.

    at: cuts to deal the rows by, if they are known; otherwise they are looked up here, which reads the rows once more."""
    at = cuts(rows, value, ties, by) if at is None else at
    held = bucketed(rows.withColumn("_value", clean(value)), "_value", "_bucket", at.values)
    if at.hot:
        held = bucketed(held.withColumn("_tie", F.when(F.col("_value").isin(list(at.hot)), F.col(ties[0]).cast("double"))), "_tie", "_cell", at.ties)
        held = held.withColumn("_cell", F.coalesce("_cell", F.lit(-1.0))).drop("_tie")
    else:
        held = held.withColumn("_cell", F.lit(-1.0))
    held = held.drop("_value")
    counts = held.filter("_bucket is not null").groupBy(*by, "_bucket", "_cell").count()
    before = Window.partitionBy(*by).orderBy("_bucket", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_bucket", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), F.sum("count").over(Window.partitionBy(*by)).alias("n"))
    inside = Window.partitionBy(*by, "_bucket", "_cell").orderBy(value, *ties)
    joined = held.withColumn("_nth", F.row_number().over(inside)).join(starts, [*by, "_bucket", "_cell"])
    return joined.withColumn(to, F.col("_start") + F.col("_nth") - 1).drop("_bucket", "_cell", "_start", "_nth")


def exact_median(rows: DataFrame, value: str, ties: Sequence[str], by: Sequence[str] = (), at: Cuts | None = None) -> DataFrame:
    """(by, median, n): the middle value, or the mean of the two middle values, of each group. Cuts are as for ranked."""
    n, r = F.col("n"), F.col("_rank")
    middle = ranked(rows, value, ties, by, "_rank", at).filter((r == F.floor((n - 1) / 2)) | (r == F.floor(n / 2)))
    return middle.groupBy(*by).agg(F.avg(value).alias("median"), F.max("n").alias("n"))
