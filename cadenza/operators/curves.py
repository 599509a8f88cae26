"""Efficiency and adjuster curves: equi-depth and equi-width bins, nearest-bin prediction, calibration pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.operators.ranks import exact_median, ranked
from cadenza.session import kept

KEYS = ("activity_id", "split_id")
#: Decimal places of summed speeds: more than a double has at 8 km/h.
SPEED_PLACES = 15
#: Pairs of splits: splits that a task holds at once, the shares of all pairs that there are at least, in all and for each task, and flat splits sent together.
PAIR_GROUP, PAIR_SHARES, PAIR_SHARES_A_TASK, PAIR_BLOCK = 50_000, 32, 2, 128


def is_flat(gradient: Column | None = None) -> Column:
    g = F.col("elevation_gain") if gradient is None else gradient
    return (g > C.FLAT_RANGE[0]) & (g < C.FLAT_RANGE[1])


def with_efficiency(splits: DataFrame, by: Sequence[str] = (), least_flat: int = C.MIN_FLAT) -> DataFrame:
    """Heart rate by speed, relative to the flat median of the group if it has more than least_flat flat splits."""
    held = splits.withColumn("efficiency", F.try_divide("heartrate", "speed"))
    flat = exact_median(held.filter(is_flat()), "efficiency", KEYS, by)
    scale = F.when(F.col("n") > least_flat, F.col("median"))
    flat = flat.select(*by, scale.alias("flat_median"))
    joined = held.join(flat, list(by), "left") if by else held.join(F.broadcast(flat), F.lit(True), "left")  # one row
    return joined.withColumn("efficiency", F.coalesce(F.try_divide("efficiency", "flat_median"), F.col("efficiency")))


def equi_depth_curve(rated: DataFrame, per_bucket: int = 250, by: Sequence[str] = ()) -> DataFrame:
    """Buckets of per_bucket splits in gradient order, the rest in a last one: mean gradient, mean, population deviation, count."""
    placed = ranked(rated, "elevation_gain", KEYS, by).withColumn("bucket", F.floor(F.col("rank") / per_bucket))
    told = placed.groupBy(*by, "bucket").agg(
        F.avg("elevation_gain").alias("bin_center"), F.avg("efficiency").alias("mean"), F.stddev_pop("efficiency").alias("std"), F.count(F.lit(1)).alias("count")
    )
    return told.select(*by, "bucket", "bin_center", "mean", "std", "count")


def by_intensity(splits: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """The splits of each heart-rate range, edges included, with its name; ranges may overlap. A range without splits has no rows; see in_range."""
    hr = F.col("heartrate")
    named = F.array(*[F.when(hr.between(a, b), F.lit(f"{a:g}-{b:g}")) for a, b in ranges])
    return splits.withColumn("intensity", F.explode(F.array_compact(named)))


def in_range(splits: DataFrame, heartrate_range: tuple[float, float]) -> DataFrame:
    """The splits of one heart-rate range, edges included. Raises if there are none."""
    found = splits.filter(F.col("heartrate").between(*heartrate_range))
    if found.isEmpty():
        raise ValueError(f"no split has a heart rate from {heartrate_range[0]:g} to {heartrate_range[1]:g}")
    return found


def predict_nearest(points: DataFrame, curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The points with gap = speed x the mean of the bucket whose centre is nearest; ties go to the lower bucket.

    Centres are turned into intervals at their midpoints, and points meet intervals in cells of 1 m/km, so the join
    has a key and grows with the points."""
    order = Window.partitionBy(*by).orderBy("bin_center", "bucket")
    edges = curve.select(*by, "bucket", "mean", F.lag("bin_center").over(order).alias("_prev"), "bin_center", F.lead("bin_center").over(order).alias("_next"))
    low, high = (F.col("_prev") + F.col("bin_center")) / 2, (F.col("bin_center") + F.col("_next")) / 2
    edges = edges.withColumns({"_low": F.coalesce(low, F.lit(C.ELEVATION_RANGE[0] - 1)), "_high": F.coalesce(high, F.lit(C.ELEVATION_RANGE[1] + 1))})
    cells = edges.withColumn("_cell", F.explode(F.sequence(F.floor("_low"), F.floor("_high")))).select(*by, "_cell", "_low", "_high", F.col("mean").alias("_factor"), F.col("bucket").alias("_bucket"))
    g = F.greatest(F.least(F.col("elevation_gain"), F.lit(C.ELEVATION_RANGE[1])), F.lit(C.ELEVATION_RANGE[0]))
    met = points.withColumns({"_g": g, "_cell": F.floor(g)}).join(cells, [*by, "_cell"])
    own = met.filter((F.col("_g") > F.col("_low")) & (F.col("_g") <= F.col("_high")))
    return own.withColumn("gap", F.col("speed") * F.col("_factor")).drop("_g", "_cell", "_low", "_high", "_factor", "_bucket")


def equi_width_curve(points: DataFrame, width: float = 20.0, value: str = "adjuster", weight: str | None = None) -> DataFrame:
    """Bins [low, low + width) of gradient between the multiples of width around all points, the empty ones too, with
    null mean and count 0. A point exactly on the last edge is in no bin. A point counts as often as its weight says."""
    x, v, n = F.col("elevation_gain"), F.col(value), F.lit(1) if weight is None else F.col(weight)
    span = points.agg(F.floor(F.min(x) / width).alias("first"), F.ceil(F.max(x) / width).alias("end"))  # one row
    bins = span.filter(F.col("end") > F.col("first")).select(F.explode(F.sequence("first", F.col("end") - 1)).alias("bin"))
    if weight is None:
        mean, std = F.avg(v), F.stddev_pop(v)
    else:
        mean = F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))
        std = F.sqrt(F.greatest(F.sum(v * v * n) / F.sum(F.when(v.isNotNull(), n)) - mean * mean, F.lit(0.0)))
    told = points.groupBy(F.floor(x / width).alias("bin")).agg(mean.alias("mean"), std.alias("std"), F.sum(n).cast("long").alias("count"))
    dense = bins.join(told, "bin", "left")
    return dense.select(((F.col("bin") + 0.5) * width).alias("bin_center"), "mean", "std", F.coalesce("count", F.lit(0)).alias("count"))


def calibration_pairs(splits: DataFrame, tolerance: float = C.HR_TOLERANCE) -> DataFrame:
    """Every split beside every flat split whose heart rate is within the tolerance, itself included: the features and y, the flat speed.

    Heart rates are dealt in cells of a quarter of the tolerance. A cell's splits are dealt to groups, by the pairs that they
    make: a group's are a share of all pairs, of which there are PAIR_SHARES_A_TASK for each task, and its splits are
    PAIR_GROUP at most. Flat splits are dealt to blocks of PAIR_BLOCK, in the order of their heart rates. A block is
    sent to the groups of all cells within its reach, each cell and group being a key of the join. So a task holds one
    group, and the keys are enough for as many tasks as Spark is told to make, whatever is in one cell. Their number is told
    to it, as it would merge tasks by what they read, and that is little beside the pairs that they make. Splits are shuffled,
    pairs never are; a block's pairs come one after another for each split of a group, so that files of them repeat and take
    little room.

    The rows grow with the square of the splits: models are fitted on flat_speed_targets instead, which has the sums alone."""
    width, reach, hr = tolerance / 4, tolerance * (1 + 1e-9), F.col("heartrate")
    tasks = int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda n: F.pmod(F.xxhash64(*KEYS), F.col(n))
    celled = splits.filter(F.abs(hr) < float("inf")).withColumn("_cell", F.floor(hr / width))  # others meet none
    cells = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_flat()).alias("_flat"))
    near = F.sum("_flat").over(Window.orderBy(F.col("_cell").cast("double")).rangeBetween(-4, 4))  # a row per cell
    cells = cells.withColumn("_pairs", F.col("_n") * near.cast("double"))
    share = F.coalesce(F.try_divide("_pairs", F.sum("_pairs").over(Window.partitionBy())), F.lit(0.0)) * max(PAIR_SHARES, PAIR_SHARES_A_TASK * tasks)
    groups = F.greatest(F.ceil(F.col("_n") / PAIR_GROUP), F.least(F.ceil(share), F.col("_n")))
    sizes = cells.select("_cell", groups.alias("_groups"), F.ceil(F.col("_flat") / PAIR_BLOCK).alias("_blocks"))
    rows = celled.join(sizes, "_cell").withColumn("_group", part("_groups")).drop("_groups", "_blocks")
    found = F.struct(hr.alias("flat_hr"), F.col("activity_id").alias("flat_activity"), F.col("split_id").alias("flat_split"), F.col("speed").alias("y"))
    blocks = celled.filter(is_flat()).join(sizes, "_cell").groupBy("_cell", part("_blocks").alias("_block"))
    blocks = blocks.agg(F.min(hr).alias("_low"), F.max(hr).alias("_high"), F.sort_array(F.collect_list(found)).alias("_found"))
    sent = blocks.select("_found", F.explode(F.sequence(F.floor((F.col("_low") - reach) / width), F.floor((F.col("_high") + reach) / width))).alias("_cell"))
    sent = sent.join(sizes, "_cell").select("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)).alias("_group"), "_found")
    met = sent.repartition(tasks, "_cell", "_group").hint("merge").join(rows.repartition(tasks, "_cell", "_group"), ["_cell", "_group"])
    return met.select(*splits.columns, F.inline("_found")).filter(F.abs(F.col("flat_hr") - hr) <= tolerance).select(*splits.columns, "flat_hr", "y", "flat_activity", "flat_split")


def calibration_pairs_plain(splits: DataFrame, tolerance: float = C.HR_TOLERANCE) -> DataFrame:
    """The same rows by comparing all: for small inputs and as a check."""
    flat = splits.filter(is_flat()).select(F.col("heartrate").alias("flat_hr"), F.col("speed").alias("y"), F.col("activity_id").alias("flat_activity"), F.col("split_id").alias("flat_split"))
    return splits.join(flat, F.abs(F.col("flat_hr") - F.col("heartrate")) <= tolerance)


def pair_counts(splits: DataFrame, tolerance: float = C.HR_TOLERANCE) -> DataFrame:
    """For each heart-rate range of the tolerance's width: its splits, flat splits and their product, the pairs to expect."""
    told = splits.groupBy((F.floor(F.col("heartrate") / tolerance) * tolerance).alias("hr_from")).agg(F.count(F.lit(1)).alias("n_splits"), F.count_if(is_flat()).alias("n_flat"))
    return told.withColumn("n_pairs", F.col("n_splits") * F.col("n_flat"))


def flat_speed_targets(splits: DataFrame, tolerance: float = C.HR_TOLERANCE, by: Sequence[str] = (), test_fifths: int = 1) -> DataFrame:
    """The splits with part (`train` or `test`), y (the mean speed of the flat splits whose heart rate is within the
    tolerance), n (their number) and total (their speeds' sum): the calibration pairs, summed for each split. Rows without
    flat splits are left out.

    A flat split is in the test part for so many fifths of a hash of its keys, so parts are the same on every run.

    Sums over a range of heart rates are differences of running sums at its two ends, so that the work grows with the
    splits and not with the pairs. Running sums are made in cells of heart rate: cells' totals, of which there are as
    many as heart rates have quarters of a beat, are summed in order, and rows only within their cell.

    An end is kept with what its rounding took off, so a flat split is within it as often as the difference of the two
    heart rates, which is exact, is within the tolerance. Speeds are summed as decimals of SPEED_PLACES places: sums are the
    same in any order, and differences of large ones lose nothing."""
    hr, test = F.col("heartrate"), F.pmod(F.xxhash64(*KEYS), F.lit(5)) < test_fifths
    exact = lambda c: F.col(c).cast(f"decimal(28, {SPEED_PLACES})")
    short = lambda c: c.cast(f"decimal(36, {SPEED_PLACES})")  # noqa: E731 -- a sum of two of them keeps its places
    none = F.lit(0).cast(f"decimal(28, {SPEED_PLACES})")
    nothing = {"y0": none, "n0": F.lit(0), "y1": none, "n1": F.lit(0)}
    sums = {"y0": F.when(~test, exact("speed")).otherwise(none), "n0": F.when(~test, 1).otherwise(0), "y1": F.when(test, exact("speed")).otherwise(none), "n1": F.when(test, 1).otherwise(0)}
    point = F.struct(*by, *KEYS, "speed", "elevation_gain", "heartrate").alias("split")

    def end(shift: float, kind: int) -> Column:
        at = hr + F.lit(shift)
        moved = at - hr
        return F.struct(at.alias("at"), ((hr - (at - moved)) + (F.lit(shift) - moved)).alias("rest"), F.lit(kind).alias("kind"))

    flat = splits.filter(is_flat() & hr.isNotNull()).select(*by, hr.alias("at"), F.lit(0.0).alias("rest"), F.lit(0).alias("kind"), F.lit(None).alias("split"), *[c.alias(k) for k, c in sums.items()])
    ends = splits.filter(hr.isNotNull()).select(*by, point, F.explode(F.array(end(-tolerance, -1), end(tolerance, 1))).alias("e"))
    ends = ends.select(*by, "e.at", "e.rest", "e.kind", "split", *[c.alias(k) for k, c in nothing.items()])
    events = ends.unionByName(flat).withColumn("cell", F.floor(F.col("at") * 4))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda k, over: F.coalesce(short(F.sum(k).over(over)) if k.startswith("y") else F.sum(k).over(over), F.lit(0))
    cells = events.groupBy(*by, "cell").agg(*[(short(F.sum(k)) if k.startswith("y") else F.sum(k)).alias(k) for k in sums]).select(*by, "cell", *[total(k, before).alias(f"{k}_before") for k in sums])
    inside = Window.partitionBy(*by, "cell").orderBy("at", "rest", "kind").rowsBetween(Window.unboundedPreceding, 0)
    told = events.withColumns({k: total(k, inside) for k in sums}).filter("split is not null").join(cells, [*by, "cell"])
    so_far = lambda k: F.col(k) + F.col(f"{k}_before")
    told = told.groupBy("split").agg(*[F.sum(F.when(F.col("kind") < 0, -so_far(k)).otherwise(so_far(k))).alias(k) for k in sums])
    part = lambda name, k: F.struct(F.lit(name).alias("part"), F.try_divide(F.col(f"y{k}").cast("double"), f"n{k}").alias("y"), F.col(f"n{k}").alias("n"), F.col(f"y{k}").alias("total"))
    parts = F.filter(F.array(part("train", 0), part("test", 1)), lambda p: p["n"] > 0)
    return told.select("split.*", F.explode(parts).alias("p")).select(*by, *KEYS, "speed", "elevation_gain", "heartrate", "p.*")


def reliability_curve(predicted: DataFrame, bins: int = 20, by: Sequence[str] = ("part",)) -> DataFrame:
    """Means of prediction and truth in bins of equal width over each part's predictions; the largest prediction is in no
    bin. A row counts as often as its n says, as the pairs of which it is the mean would.

    Predictions are kept before they are read twice: made anew they can differ in their last place, and the largest be
    in a bin after all."""
    p, n, predicted = F.col("prediction"), F.col("n"), kept(predicted)
    span = predicted.groupBy(*by).agg(F.min(p).alias("_low"), F.max(p).alias("_high"))
    placed = predicted.join(F.broadcast(span), list(by)).withColumn("bin", F.floor((p - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins))
    mean = lambda c: F.sum(c * n) / F.sum(n)
    return placed.filter(F.col("bin") < bins).groupBy(*by, "bin").agg(mean(p).alias("mean_prediction"), mean(F.col("y")).alias("mean_truth"), F.sum(n).cast("long").alias("count"))


class NothingToLearn(ValueError):
    """There is no row to train a model on."""


class EfficiencyGap:
    """fit, predict and curve by efficiency: heart rate by speed, in buckets of gradient."""

    def __init__(self, per_bucket: int = 250):
        self.per_bucket = per_bucket
        self.buckets: DataFrame | None = None

    def fit(self, splits: DataFrame) -> EfficiencyGap:
        self.splits, self.buckets = splits, equi_depth_curve(with_efficiency(splits), self.per_bucket)
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        if self.buckets is None:
            raise RuntimeError("fit the model first")
        return predict_nearest(points, self.buckets)

    def curve(self, heartrate_range: tuple[float, float] | None = None) -> DataFrame:
        """The buckets, or those of the splits in one range of heart rates alone; raises if no split is in it."""
        if self.buckets is None:
            raise RuntimeError("fit the model first")
        if heartrate_range is None:
            return self.buckets.drop("bucket")
        return EfficiencyGap(self.per_bucket).fit(in_range(self.splits, heartrate_range)).curve()
