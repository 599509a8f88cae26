"""Domain constants and small static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Record distances in metres; the labels are keys of results.
PR_DISTANCES = (("1 km", 1000.0), ("3 km", 3000.0), ("5 km", 5000.0), ("10 km", 10000.0), ("Semi", 21097.5), ("Marathon", 42195.0), ("50 km", 50000.0), ("100 km", 100000.0), ("150 km", 150000.0))
#: Shorter distances, which the smallest activities also reach.
SHORT_DISTANCES = (("100 m", 100.0), ("400 m", 400.0), ("1 km", 1000.0), ("3 km", 3000.0), ("150 km", 150000.0))
#: Gradient bands in percent, lower edge included; None is open.
GRADIENT_BANDS = (("steep_descent", None, -12.0), ("gentle_descent", -12.0, -3.0), ("flat", -3.0, 3.0), ("gentle_ascent", 3.0, 12.0), ("steep_ascent", 12.0, None))
#: Adjustment factors of published curves, one each 50 m/km from -350 to 350.
KNOTS = tuple(float(x) for x in range(-350, 351, 50))
REFERENCE_CURVES = {
    "balanced_runner": (1.7, 1.5, 1.3, 1.1, 0.9, 0.85, 0.9, 1.0, 1.2, 1.45, 1.8, 2.3, 2.75, 3.15, 3.55),
    "mountain_runner": (1.6, 1.35, 1.15, 1.0, 0.87, 0.85, 0.9, 1.0, 1.1, 1.3, 1.5, 1.7, 1.9, 2.15, 2.4),
}

PAUSE_S = 60.0
WARMUP_S = 900.0
ELEVATION_RANGE = (-350.0, 350.0)
SPEED_RANGE = (3.0, 22.0)
FLAT_RANGE = (-10.0, 10.0)
HR_TOLERANCE = 3.0
MIN_FLAT = 100
SPEED_LIMITS_KMH = (3.0, 20.0)
PACE_LIMITS = (180.0, 1200.0)
GRAVITY, COST_OF_TRANSPORT, MIN_SLOPE = 9.81, 1.0, -0.05


def reference_curves(spark: SparkSession) -> DataFrame:
    """(curve, bin_center, mean, std, count) of the published curves."""
    rows = [(name, x, y, 0.0, 1) for name, ys in REFERENCE_CURVES.items() for x, y in zip(KNOTS, ys, strict=True)]
    return spark.createDataFrame(rows, "curve string, bin_center double, mean double, std double, count long")


def pr_distances(spark: SparkSession, distances=PR_DISTANCES) -> DataFrame:
    return spark.createDataFrame([(label, m) for label, m in distances], "label string, meters double")
