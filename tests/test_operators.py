"""Hand-made edge cases of the telemetry operators."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza import constants as C
from cadenza.functions import running as R
from cadenza.operators import curves, gbt, records, savgol, seasons, smoothing, splits, steps
from cadenza.operators.ranks import cuts, exact_median, ranked
from cadenza.plans import gap, oracle, progress, races
from cadenza.sources import activities as S

TELEMETRY = "activity_id long, seq long, t double, distance double, altitude double, heartrate double"


@pytest.fixture
def samples(spark):
    """Telemetry of one activity (or more) from (t, distance, altitude, heartrate)."""

    def make(*runs):
        rows = [(a, k, *map(lambda x: None if x is None else float(x), r)) for a, run in enumerate(runs) for k, r in enumerate(run)]
        return spark.createDataFrame(rows, TELEMETRY)

    return make


def test_pause_is_over_sixty_seconds(samples):
    found = steps.steps(samples([(0, 0, 0, 1), (60, 1, 0, 1), (120.001, 2, 0, 1), (120.001, 3, 0, 1), (121, 3, 0, 1)]))
    told = found.orderBy("seq").select(steps.moving_race().alias("race"), steps.moving_progress().alias("progress")).collect()
    assert [tuple(r) for r in told] == [(True, True), (False, False), (False, False), (True, False)]


def test_steps_without_time_or_way_are_null(samples):
    found = steps.steps(samples([(0, 0, 5, 1), (0, 2, 5, 1), (1, 2, 6, 1)])).orderBy("seq").collect()
    assert [(r["speed"], r["elevation_gain"]) for r in found] == [(None, 0.0), (0.0, None)]


def test_one_sample_has_no_steps(samples):
    df = samples([(0, 0, 0, 1)], [(0, 0, 0, 1), (5, 9, 0, 1), (4, 10, 0, 1)])
    assert steps.steps(df).filter("activity_id = 0").count() == 0
    assert {(r["activity_id"], r["reason"]) for r in steps.quarantined(df).collect()} == {(0, "too few samples"), (1, "time goes back")}


def test_rolling_window_is_open_on_the_left(samples):
    found = samples([(0, 0, 0, 1), (15, 0, 0, 3), (16, 0, 0, None), (100, 0, 0, None)]).select("seq", steps.rolling_mean(F.col("heartrate"), 15).alias("m")).orderBy("seq")
    assert [r["m"] for r in found.collect()] == [1.0, 3.0, 3.0, None]


def plain_cuts(key, least):
    found, at = [], 0
    for i in range(1, len(key)):
        if key[i] - key[at] >= least:
            found.append(i)
            at = i
    return found


@pytest.mark.parametrize("seed", range(20))
def test_greedy_cuts_equal_a_loop(seed):
    rng = np.random.default_rng(seed)
    key = np.cumsum(rng.integers(0, 5, 200)).astype(float) if seed % 3 else np.cumsum(rng.normal(1, 2, 200))
    assert splits.cuts(key, 10) == plain_cuts(key, 10)


def test_splits_that_are_mixed_or_have_no_finite_mean(samples):
    """Steps are at t = 1, 2, ...; splits cover t = 1-10 and 11-20, and what is after 21 is left out."""
    even = [(t, 3 * t, 0, 100) for t in range(31)]
    both_ways = [(t, 3 * t, 1 if t in (4, 5) else 0, 100) for t in range(31)]
    stands = [(t, 3 * t - 3 * (t >= 15), 0, 100) for t in range(31)]
    found = {(r["activity_id"], r["split_id"]): r for r in splits.greedy_splits(steps.steps(samples(even, both_ways, stands)), 10, 0).collect()}
    assert sorted(found) == [(a, k) for a in range(3) for k in range(2)] and all(r["n_steps"] == 10 for r in found.values())
    assert [k for k, r in sorted(found.items()) if r["mixed"]] == [(1, 0)]
    assert [k for k, r in sorted(found.items()) if r["poisoned"]] == [(2, 1)]


def test_usable_splits_include_their_edges(spark):
    rows = [(0, k, s, e, 100.0, 1, False, False) for k, (s, e) in enumerate([(3.0, -350.0), (22.0, 350.0), (2.99, 0.0), (22.01, 0.0), (10.0, 350.01)])]
    df = spark.createDataFrame(rows, "activity_id long, split_id long, speed double, elevation_gain double, heartrate double, n_steps long, mixed boolean, poisoned boolean")
    assert sorted(r["split_id"] for r in splits.usable_splits(df).collect()) == [0, 1]


SPLITS = "activity_id long, split_id long, speed double, elevation_gain double, heartrate double"


def some_splits(spark, n_flat, n_steep=50, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(0, k, float(rng.uniform(8, 12)), float(rng.uniform(-9, 9)), float(rng.integers(120, 170))) for k in range(n_flat)]
    rows += [(1, k, float(rng.uniform(4, 9)), float(rng.uniform(11, 300)), float(rng.integers(120, 170))) for k in range(n_steep)]
    return spark.createDataFrame(rows, SPLITS), rows


@pytest.mark.parametrize("n_flat", [0, 99, 100, 101])
def test_flat_median_needs_more_than_a_hundred(spark, n_flat):
    df, rows = some_splits(spark, n_flat)
    found = {(r["activity_id"], r["split_id"]): r["efficiency"] for r in curves.with_efficiency(df).collect()}
    plain = {(r[0], r[1]): r[4] / r[2] for r in rows}
    scale = np.median([v for k, v in plain.items() if k[0] == 0]) if n_flat > 100 else 1.0
    assert found == pytest.approx({k: v / scale for k, v in plain.items()})


def test_strict_edges_of_flat(spark):
    df = spark.createDataFrame([(g,) for g in (-10.0, -9.99, 9.99, 10.0)], "elevation_gain double")
    assert [r[0] for r in df.filter(curves.is_flat()).collect()] == [-9.99, 9.99]


def test_telemetry_has_more_activities_and_no_longer_ones(spark):
    import duckdb

    events = spark.createDataFrame([(k, k * 7 % 11, k * 1.37) for k in range(1000)], "event_id long, user_id long, value double")
    found = {a: S.telemetry_from_events(events, 3, a).orderBy("activity_id", "seq").toPandas() for a in (100, 5000)}
    assert found[100].groupby("activity_id").size().max() <= 100 and found[100]["activity_id"].nunique() == 30
    assert found[5000]["activity_id"].nunique() == 3
    with duckdb.connect() as con:
        con.register("events", events.toPandas())
        pd.testing.assert_frame_equal(found[100], con.sql(f"select * from ({S.telemetry_sql(3, 100)}) x order by activity_id, seq").df())


def test_refused_requests_say_why(spark):
    ask = spark.createDataFrame([(k,) for k in range(6)], "request_id long")
    day = "2024-01-0"
    scales = [(1, "a", day + "1", None)] * 6 + [(2, None, None, None), (3, "a", day + "2", day + "1"), (4, "a", day + "1", day + "1"), (5, "", day + "2", day + "1")]
    scales = spark.createDataFrame(scales, "request_id long, name string, start string, end string")
    assert dict(map(tuple, gap.scale_problems(ask, scales).collect())) == {0: "no scale", 1: "over 5 scales", 2: "no name", 3: "ends before it starts", 5: "no name"}
    chosen = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 1), (2, 1), (3, 9), (4, 1), (4, 2), (5, None)], "request_id long, activity_id long")
    known = spark.createDataFrame([(k,) for k in range(5)], "activity_id long")
    assert dict(map(tuple, races.selection_problems(ask, chosen, known).collect())) == {0: "no race", 1: "over 4 races", 2: "a race twice", 3: "unknown race", 5: "unknown race"}


def test_ranks_and_medians_without_a_global_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), k, float(v)) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 500), np.round(rng.normal(0, 5, 500), 1)))]
    df = spark.createDataFrame(rows, "g long, k long, v double")
    for g in range(3):
        own = sorted((v, k) for gg, k, v in rows if gg == g)
        found = {r["k"]: r["rank"] for r in ranked(df, "v", ["k"], ["g"]).filter(F.col("g") == g).collect()}
        assert found == {k: i for i, (_, k) in enumerate(own)}
        median = exact_median(df, "v", ["k"], ["g"]).filter(F.col("g") == g).first()
        assert median["median"] == pytest.approx(np.median([v for v, _ in own])) and median["n"] == len(own)


@pytest.mark.parametrize("share", [1, 10, 100])
def test_ranks_are_exact_however_rows_are_dealt(spark, share):
    """Half of the rows have one value, some have a negative zero, an infinity, NaN or none; there is a group of one row."""
    rng = np.random.default_rng(2)
    v = [0.0 if k % 2 else float(x) for k, x in enumerate(np.round(rng.normal(0, 1, 2000), 2))]
    v[:8] = [-0.0, -0.0, float("inf"), float("-inf"), float("-inf"), float("nan"), None, float("inf")]
    rows = [(k % 3 if k else 3, k * 7919 % 2003, x) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, k long, v double").repartition(5)
    at = cuts(df, "v", ["k"], ["g"], parts=50, share=share)
    found = ranked(df, "v", ["k"], ["g"], at=at).collect()
    for g in range(4):
        own = sorted((x != x, x if x == x else 0.0, k) for gg, k, x in rows if gg == g and x is not None)
        assert {r["k"]: r["rank"] for r in found if r["g"] == g} == {k: i for i, (_, _, k) in enumerate(own)}
        assert {r["n"] for r in found if r["g"] == g} == {len(own)}


def test_a_hot_value_is_dealt_to_many_buckets(spark):
    df = spark.range(40_000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(3) - 0.5).alias("v"))
    at = cuts(df, "v", ["k"], parts=20)
    assert at.hot == (0.0,)
    inside = df.select(F.when(F.col("v") == 0, F.lit(-1)).otherwise(sum((F.col("v") >= x).cast("int") for x in at.values)).alias("b"), F.when(F.col("v") == 0, sum((F.col("k") >= x).cast("int") for x in at.ties)).alias("c"))
    sizes = [r[0] for r in inside.groupBy("b", "c").count().select("count").collect()]
    assert max(sizes) <= 2 * 40_000 / 20 and len(sizes) > 25
    assert cuts(df.filter("k < 0"), "v", ["k"]) == cuts(df.filter("k < 500"), "v", ["k"]) == type(at)()


def test_equi_depth_keeps_the_rest(spark):
    df, rows = some_splits(spark, 120, 33)
    found = curves.equi_depth_curve(curves.with_efficiency(df), 50).orderBy("bucket").collect()
    assert [r["count"] for r in found] == [50, 50, 50, 3]
    assert found[3]["bin_center"] == pytest.approx(np.mean(sorted(r[3] for r in rows)[-3:]))


def test_nearest_bucket_and_ties(spark):
    curve = spark.createDataFrame([(0, -10.0, 0.5), (1, 10.0, 1.0), (2, 300.0, 2.0)], "bucket long, bin_center double, mean double")
    points = spark.createDataFrame([(k, 10.0, g) for k, g in enumerate([-350.0, 0.0, 0.01, 155.0, 155.01, 350.0, -10.0])], "k long, speed double, elevation_gain double")
    assert [r["gap"] for r in curves.predict_nearest(points, curve).orderBy("k").collect()] == [5.0, 5.0, 10.0, 10.0, 20.0, 20.0, 5.0]


def test_equi_width_drops_the_last_edge_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(-5.0, 1.0), (5.0, 2.0), (65.0, 3.0), (80.0, 9.0)], "elevation_gain double, adjuster double")
    found = curves.equi_width_curve(df, 20.0).orderBy("bin_center").collect()
    assert [(r["bin_center"], r["mean"], r["count"]) for r in found] == [(-10.0, 1.0, 1), (10.0, 2.0, 1), (30.0, None, 0), (50.0, None, 0), (70.0, 3.0, 1)]
    assert curves.equi_width_curve(df.filter("elevation_gain = 80"), 20.0).count() == 0


@pytest.mark.parametrize("tolerance", [1.0, 3.0])
def test_pairs_meet_alike_with_and_without_cells(spark, tolerance):
    df, rows = some_splits(spark, 60, 40)
    key = ["activity_id", "split_id", "flat_activity", "flat_split", "y"]
    a = sorted(map(tuple, curves.calibration_pairs(df, tolerance).select(*key).collect()))
    b = sorted(map(tuple, curves.calibration_pairs_plain(df, tolerance).select(*key).collect()))
    assert a == b and len(a) == sum(abs(x[4] - y[4]) <= tolerance for x in rows for y in rows if -10 < y[3] < 10)


def test_pairs_are_dealt_to_tasks_and_take_little_room(spark, tmp_path):
    """Splits that fit one task make pairs that don't: one heart rate's pairs are made by several, and a row of them is under a byte on disk."""
    rng = np.random.default_rng(4)
    rows = [(k % 20, k // 20, float(rng.uniform(4, 12)), float(-5 + 20 * (k % 2)), 150.0) for k in range(1200)]
    df = spark.createDataFrame(rows, SPLITS).coalesce(1)
    curves.calibration_pairs(df).withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "pairs"))
    tasks = [r["count"] for r in spark.read.parquet(str(tmp_path / "pairs")).groupBy("task").count().collect()]
    assert sum(tasks) == 1200 * 600 and len(tasks) == 4 and max(tasks) < 1200 * 600 / 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1200 * 600


def test_pairs_are_dealt_to_as_many_tasks_as_there_are(spark):
    """Twice the tasks have half the pairs each, in one cell too: shares go by pairs and tasks, and not by a fixed number or by splits alone."""
    rng, tasks = np.random.default_rng(5), spark.conf.get("spark.sql.shuffle.partitions")
    alike = [(k % 20, k // 20, float(rng.uniform(4, 12)), float(-5 + 20 * (k % 2)), 150.0) for k in range(1200)]
    lone = [(20 + k % 20, k // 20, 9.0, 20.0, 100.0 + 20 * (k % 2)) for k in range(1200)]  # as many splits, and no flat one near
    df = spark.createDataFrame(alike + lone, SPLITS).coalesce(1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "96")
        found = curves.calibration_pairs(df).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    counts = [r["count"] for r in found]
    assert sum(counts) == 1200 * 600 and len(counts) > 64 and max(counts) < 1200 * 600 / 16


def test_pairs_of_odd_heart_rates_and_many_in_one_cell(spark, monkeypatch):
    """No heart rate, not a number and infinite ones meet none; groups and blocks smaller than a cell lose no pair and double none."""
    monkeypatch.setattr(curves, "PAIR_GROUP", 7)
    monkeypatch.setattr(curves, "PAIR_BLOCK", 3)
    _, rows = some_splits(spark, 60, 40)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -2.9, 2.9, 0.1, 1e300]
    df = spark.createDataFrame([(*r[:4], 150.0 if k % 3 else r[4]) for k, r in enumerate(rows)] + [(2, k, 9.0, 0.0, x) for k, x in enumerate(odd)], SPLITS)
    a, b = (sorted(map(tuple, f(df).select("activity_id", "split_id", "flat_activity", "flat_split", "y", "flat_hr").collect())) for f in (curves.calibration_pairs, curves.calibration_pairs_plain))
    assert a == b and len(a) > 2000 and curves.calibration_pairs(df).columns == curves.calibration_pairs_plain(df).select(*df.columns, "flat_hr", "y", "flat_activity", "flat_split").columns
    assert curves.calibration_pairs(df.limit(0)).count() == 0


def plain_best(d, t, target):
    d = np.maximum.accumulate(d)
    found = []
    for i in range(len(d)):
        j = np.searchsorted(d, d[i] + target)
        if j < len(d):
            at = t[j - 1] + (d[i] + target - d[j - 1]) / (d[j] - d[j - 1]) * (t[j] - t[j - 1])
            found.append(at - t[i])
    found = [x for x in found if x > 0]
    return min(found) if found else None


def test_best_efforts_with_jitter_and_short_activities(samples):
    rng = np.random.default_rng(3)
    d = np.cumsum(rng.uniform(-1, 6, 400))
    t = np.cumsum(rng.integers(1, 4, 400)).astype(float)
    df = samples([(a, b, 0, 1) for a, b in zip(t, d)], [(0, 0, 0, 1), (1, 5, 0, 1)])
    found = {(r["activity_id"], r["label"]): r["best_s"] for r in records.best_efforts(df, (("a", 100.0), ("b", 333.0), ("c", 1e6))).collect()}
    assert found[0, "a"] == pytest.approx(plain_best(d, t, 100.0)) and found[0, "b"] == pytest.approx(plain_best(d, t, 333.0))
    assert found[0, "c"] is None and found[1, "a"] is None


def test_records_tie_and_progress(spark):
    rows = [(1, "x", "2020-01-02", 50.0), (2, "x", "2020-01-01", 60.0), (3, "x", "2020-01-03", 50.0), (4, "x", "2020-01-04", None), (5, "y", "2020-01-01", None), (6, "x", "2020-01-02", 55.0)]
    df = spark.createDataFrame(rows, "activity_id long, label string, date string, value double").withColumn("date", F.to_date("date"))
    assert [(str(r["date"]), r["value"]) for r in records.record_progression(df).orderBy("date").collect()] == [("2020-01-01", 60.0), ("2020-01-02", 50.0)]
    best = {r["label"]: (str(r["date"]), r["value"]) for r in records.current_records(df).collect()}
    assert best == {"x": ("2020-01-02", 50.0), "y": ("None", None)}


def test_calendar_edges(spark):
    days = ["2024-02-29", "2024-12-31", "2023-12-31", "2025-01-01", "2025-01-07", "2025-01-08"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    found = df.select(R.reference_date(F.col("d")).alias("r"), R.within_year_bin(F.col("d")).alias("w"), R.bin_start(F.col("d")).alias("s"), R.bin_start(F.col("d"), "month").alias("m")).collect()
    assert [r["w"] for r in found] == [9, 53, 53, 1, 1, 2] and str(found[0]["r"]) == "2000-02-29"
    assert str(found[3]["s"]) == "2024-12-30" and str(found[3]["m"]) == "2025-01-01"


def test_season_ratios(spark):
    rows = [(1, "2025-01-01", 0.0, 5.0, 1.5), (2, "2024-12-31", 100.0, 5.0, 2.5), (3, "2024-12-30", 100.0, 15.0, None)]
    df = spark.createDataFrame(rows, "activity_id long, date string, distance_m double, elevation_gain_m double, power_to_hr double").withColumn("date", F.to_date("date"))
    assert {(r["year"], r["power_to_hr"]) for r in seasons.power_to_hr_bins(df).collect()} == {(2024, 2.0)}
    assert {(r["year"], r["gradient"], r["season_avg"]) for r in seasons.average_gradient(df).collect()} == {(2024, 10.0, 10.0)}
    cum = seasons.annual_cumulative(df, "distance_m").orderBy("year", "ord").collect()
    assert [(r["year"], r["ord"], r["y"]) for r in cum] == [(2024, 0, 0.0), (2024, 1, 100.0), (2024, 2, 200.0), (2025, 0, 0.0), (2025, 1, 0.0)]


def test_band_edges(spark):
    df = spark.createDataFrame([(float(g),) for g in (-12.1, -12, -3.1, -3, 2.9, 3, 11.9, 12)] + [(None,)], "g double")
    names = [b for b, _, _ in C.GRADIENT_BANDS]
    assert [r[0] for r in df.select(R.band(F.col("g"))).collect()] == [names[0], names[1], names[1], names[2], names[2], names[3], names[3], names[4], None]


@pytest.mark.parametrize("g", [-400.0, -350.0, -325.0, 0.0, 12.5, 349.9, 350.0, 1000.0])
@pytest.mark.parametrize("curve", sorted(C.REFERENCE_CURVES))
def test_factor_is_linear_interpolation(spark, g, curve):
    found = spark.range(1).select(R.factor_at(F.lit(g), curve).alias("f")).first()["f"]
    assert found == pytest.approx(np.interp(g, C.KNOTS, C.REFERENCE_CURVES[curve]))


def test_power_and_clip_keep_nulls(spark):
    null = F.lit(None).cast("double")
    r = spark.range(1).select(R.power(F.lit(3.0), F.lit(-200.0), 70.0).alias("a"), R.power(null, F.lit(1.0), 70.0).alias("b"), R.power(F.lit(3.0), null, 70.0).alias("c"), R.power(F.lit(3.0), F.lit(0.0), None).alias("d"), R.clip(null, 1, 2).alias("e")).first()
    assert r["a"] == pytest.approx(70 * 3 * (1 - 9.81 * 0.05)) and (r["b"], r["c"], r["d"], r["e"]) == (None,) * 4


def test_texts_of_durations(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (59.6,), (3600.0,), (36610.2,), (None,), (float("nan"),), (float("inf"),)], "s double")
    found = df.select(R.hms(F.col("s")).alias("h"), R.pace_text(F.col("s")).alias("p"), R.as_clock(F.col("s")).alias("c")).collect()
    assert [r["h"] for r in found] == ["0:00", "0:02", "1:00", "1:00:00", "10:10:10", "", "", ""]
    assert found[2]["p"] == "1:00/km" and found[5]["p"] == "" and found[6]["c"] is None and found[3]["c"] is not None
    r = spark.range(1).select(R.rgba(F.lit("#ff8000"), 0.3).alias("a"), R.rgba(F.lit("red"), 0.3).alias("b"), R.seconds_of(F.lit("1:02:03")).alias("s"), R.split_seconds(F.lit(3723).cast("long")).alias("h")).first()
    assert (r["a"], r["b"], r["s"], list(r["h"])) == ("rgba(255,128,0,0.3)", "red", 3723, [1, 2, 3])
    texts = F.lit(None).cast("map<string,map<string,string>>")
    told = F.create_map(F.lit("en"), F.create_map(F.lit("k"), F.lit("word")))
    r = spark.range(1).select(R.translated(told, F.lit("fr"), F.lit("k")).alias("a"), R.translated(told, F.lit("en"), F.lit("x")).alias("b"), R.translated(texts, F.lit("en"), F.lit("k")).alias("c")).first()
    assert tuple(r) == ("word", "x", "k")


def test_splits_are_the_same_in_batches_of_any_size(spark, samples):
    rng = np.random.default_rng(3)
    runs = [[(t, 3 * t, t % 9, 140) for t in np.cumsum(rng.integers(0, 4, n))] for n in (1, 2, 80, 300)]
    stepped = steps.steps(samples(*runs))
    told = lambda: sorted(map(tuple, splits.with_split(stepped, "t", 10.0).select("activity_id", "seq", "split_id").collect()))
    whole = told()
    by_hand = []
    for a, run in enumerate(runs):
        ends = splits.cuts(np.array([r[0] for r in run[1:]], dtype=float), 10.0)
        by_hand += [(a, k + 1, int(np.searchsorted(ends, k, side="right"))) for k in range(ends[-1] if ends else 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert told() == whole == sorted(by_hand)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_windows_reproduce_polynomials(degree):
    x = np.arange(60.0)
    y = sum((k + 1) * (x / 10) ** k for k in range(degree + 1))
    assert np.allclose(savgol.at_nearest_window(y, np.arange(60), 60, 13, degree), y)


def plain_savgol(y, distance, window_m, degree=2):
    """Each sample by a fit of its own."""
    y, n = np.array(y, dtype=float), len(y)
    there = np.isfinite(y)
    if n < degree + 2 or there.sum() < 2:
        return y
    odd = lambda k: k + 1 - k % 2
    gaps = np.diff(distance)
    width = min(max(odd(int(np.rint(window_m / (np.median(gaps[gaps > 0]) if (gaps > 0).any() else 1.0)))), odd(degree + 2)), n - 1 + n % 2)
    whole, half = np.interp(np.arange(n), np.flatnonzero(there), y[there]), width // 2
    found = np.full(n, np.nan)
    for i in np.flatnonzero(there):
        c = min(max(i, half), n - 1 - half)
        places = np.arange(c - half, c + half + 1)
        found[i] = np.polyval(np.polyfit(places - c, whole[places], degree), i - c)
    return found


@pytest.mark.parametrize("block", [1, 64, 10_000])
def test_savgol_is_the_same_in_blocks_of_any_size(spark, samples, block):
    rng = np.random.default_rng(block)
    runs = []
    for n in (1, 3, 4, 5, 37, 400):
        way = np.cumsum(rng.integers(0, 5, n)).astype(float)
        y = np.where(rng.random(n) < 0.15, np.nan, 500 + np.cumsum(rng.normal(size=n)))
        runs.append([(k, way[k], None if np.isnan(y[k]) else y[k], 100) for k in range(n)])
    found = savgol.savgol_by_activity(samples(*runs), "altitude", "smooth", 40.0, block=block).orderBy("activity_id", "seq").toPandas()
    for a, run in enumerate(runs):
        own = found[found["activity_id"] == a]
        wanted = plain_savgol([np.nan if r[2] is None else r[2] for r in run], np.array([r[1] for r in run]), 40.0)
        assert own["seq"].tolist() == list(range(len(run)))
        assert np.allclose(own["smooth"].to_numpy(float), wanted, equal_nan=True)


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_savgol_of_any_degree_takes_infinities_as_missing(spark, samples, degree):
    rng = np.random.default_rng(degree)
    n = 900
    way, y = np.cumsum(rng.integers(1, 4, n)).astype(float), 4000 + np.cumsum(rng.normal(size=n))
    y[[5, 400]], y[17] = np.inf, -np.inf
    found = savgol.savgol_by_activity(samples([(k, way[k], float(y[k]), 100) for k in range(n)]), "altitude", "smooth", 150.0, degree=degree, block=64).orderBy("seq").toPandas()
    wanted = plain_savgol(y, way, 150.0, degree)
    assert np.isnan(found["smooth"].to_numpy(float)[[5, 17, 400]]).all()
    assert np.allclose(found["smooth"].to_numpy(float), np.where(np.isfinite(y), wanted, np.nan), equal_nan=True, rtol=0, atol=1e-6)


def plain_loess(x, y, counts, fraction=0.4):
    """Each bin by a fit of its own, over all bins."""
    k, found = max(3, int(np.ceil(fraction * len(x)))), []
    for i in range(len(x)):
        away = np.abs(x - x[i])
        weight = np.clip(1 - (away / np.sort(away)[k - 1]) ** 3, 0, None) ** 3 * counts
        found.append(np.polyval(np.polyfit(x - x[i], y, 2, w=np.sqrt(weight)), 0.0))
    return np.array(found)


def test_loess_equals_fits_made_one_by_one():
    rng = np.random.default_rng(8)
    x = np.sort(rng.uniform(-350, 350, 60))
    y, counts = 1 + x / 300 + rng.normal(size=60) / 10, rng.integers(1, 300, 60)
    assert np.allclose(smoothing.loess(x, y, counts), plain_loess(x, y, counts))
    tied = smoothing.loess(np.zeros(6), np.arange(6.0), np.array([1, 0, 0, 0, 0, 1]))
    assert np.allclose(tied, smoothing.loess(np.zeros(6), np.arange(6.0), np.array([1, 0, 0, 0, 0, 1]))) and np.isfinite(tied).all()


def test_long_curves_are_smoothed_in_little_more_than_their_length(monkeypatch):
    """Sums of blocks give the fits made one by one, ties and empty bins included, without a point for each bin of each run."""
    rng = np.random.default_rng(9)
    x = np.sort(np.concatenate([rng.normal(0, 90, 1500), np.zeros(300), np.repeat(40.0, 7)]))
    y, counts = 1 + x**2 / 1e5 + rng.normal(0, 0.05, len(x)), rng.integers(0, 60, len(x)).astype(float)
    y[5] = np.nan
    long = smoothing.loess(x, y, counts, 0.4)
    monkeypatch.setattr(smoothing, "FITTED", 10**9)
    assert np.allclose(long, smoothing.loess(x, y, counts, 0.4), rtol=0, atol=1e-9, equal_nan=True)
    monkeypatch.undo()
    began = time.perf_counter()
    smoothing.loess(np.arange(40_000) / 30, np.ones(40_000), np.ones(40_000))  # 640 million points of fits
    assert time.perf_counter() - began < 60


def test_loess_reproduces_parabolas_and_leaves_empty_bins():
    x = np.linspace(-300, 300, 25)
    y = 1 + 0.01 * x + 1e-4 * x**2
    assert np.allclose(smoothing.loess(x, y, np.ones(25)), y)
    assert np.allclose(smoothing.loess(x, y, np.zeros(25)), y)
    y[7] = np.nan
    found = smoothing.loess(x, y, np.ones(25))
    assert np.isnan(found[7]) and np.isfinite(np.delete(found, 7)).all()
    assert smoothing.loess(x[:3], y[:3], np.ones(3)).tolist() == y[:3].tolist()


def test_curve_smoothers_on_frames(spark):
    curve = spark.createDataFrame([("c", float(k), float(k * k), 0.5, 10) for k in range(9)] + [("short", 0.0, 4.0, 1.0, 1)], "curve string, bin_center double, mean double, std double, count long")
    told = smoothing.rolling_mean_curve(curve, 4).filter("curve = 'c'").orderBy("bin_center").collect()
    padded = np.pad(np.arange(9.0) ** 2, 2, mode="edge")
    assert [r["mean"] for r in told] == pytest.approx([padded[i : i + 5].mean() for i in range(9)])
    told = {(r["curve"], r["bin_center"]): r["mean"] for r in smoothing.loess_curves(curve).collect()}
    assert told == pytest.approx({("c", float(k)): float(k * k) for k in range(9)} | {("short", 0.0): 4.0}, abs=1e-9)
    with pytest.raises(ValueError):
        smoothing.rolling_mean_curve(curve, 0)
    with pytest.raises(ValueError):
        smoothing.loess_curves(curve, 0.0)


def test_both_pair_queries_tell_every_pair():
    """Not sums of them: a row for each pair, by the same SQL."""
    assert oracle.SQL["calibration_pairs_bucketed"] == oracle.SQL["calibration_pairs"] and " group by " not in oracle.SQL["calibration_pairs"].rsplit("select", 1)[1]


def test_targets_are_the_pairs_summed(spark):
    """For every split the mean flat speed and the number of its pairs, part by part, whatever the partitioning."""
    df, _ = some_splits(spark, 40, 60)
    df = df.withColumn("heartrate", F.round("heartrate")).unionByName(df.limit(3).withColumns({"heartrate": F.lit(None).cast("double"), "split_id": F.col("split_id") + 10_000}))
    test = F.pmod(F.xxhash64("flat_activity", "flat_split"), F.lit(5)) < 1
    pairs = curves.calibration_pairs_plain(df, 5.0).withColumn("part", F.when(test, "test").otherwise("train"))
    wanted = {(r["activity_id"], r["split_id"], r["part"]): (r["y"], r["n"]) for r in pairs.groupBy("activity_id", "split_id", "part").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()}
    for rows in (df, df.repartition(7)):
        found = {(r["activity_id"], r["split_id"], r["part"]): (r["y"], r["n"]) for r in curves.flat_speed_targets(rows, 5.0).collect()}
        assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)
    by = curves.flat_speed_targets(df.withColumn("scale", F.explode(F.array(F.lit("a"), F.lit("b")))), 5.0, ["scale"])
    assert by.filter("scale = 'b'").agg(F.sum("n")).first()[0] == sum(n for _, n in wanted.values()) == by.agg(F.sum("n")).first()[0] / 2
    assert curves.flat_speed_targets(df.limit(0)).count() == 0


def test_targets_end_where_differences_of_heart_rates_do(spark):
    """Of a heart rate below 128 and one above, the sum with the tolerance is rounded and the difference isn't; large sums before a range don't blur it."""
    pairs = [(k / n, (k + 3 * n) / n) for n in (3, 5, 6, 7, 9, 10, 11) for k in range(122 * n, 128 * n)]
    assert any((f <= u + 3.0) != (f - u <= 3.0) for u, f in pairs)
    rates = sorted({x for p in pairs for x in p})
    rows = [(0, i, 9.0 + i % 7 / 3, 0.0 if i % 2 else 50.0, hr) for i, hr in enumerate(rates)] + [(1, i, 21.0 + i % 11 / 7, 1.0, 60.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "activity_id long, split_id long, speed double, elevation_gain double, heartrate double").repartition(5)
    flat = [r for r in rows if abs(r[3]) < 10]
    wanted = {r[:2]: [f[2] for f in flat if abs(f[4] - r[4]) <= 3.0] for r in rows[: len(rates)]}
    found = {(r["activity_id"], r["split_id"]): (r["y"], r["n"]) for r in curves.flat_speed_targets(df.filter("activity_id = 0 or elevation_gain < 10"), test_fifths=0).collect() if r["activity_id"] == 0}
    assert {k: n for k, (_, n) in found.items()} == {k: len(v) for k, v in wanted.items() if v}
    assert all(abs(y - math.fsum(wanted[k]) / len(wanted[k])) < 1e-14 * y for k, (y, _) in found.items())


def test_reliability_reads_predictions_once(spark):
    """Predictions that come out otherwise when they are made anew: one row, the largest, is in no bin, and none is below the first."""
    again = F.udf(lambda x: x + random.random(), "double").asNondeterministic()
    rows = spark.range(300).select(F.lit("train").alias("part"), again(F.lit(1.0)).alias("prediction"), F.lit(2.0).alias("y"), F.lit(1).alias("n"))
    told = curves.reliability_curve(rows).agg(F.min("bin"), F.sum("count")).first()
    assert tuple(told) == (0, 299)


def test_boosted_trees_learn(spark):
    df, _ = some_splits(spark, 40, 60)
    targets = curves.flat_speed_targets(df, 5.0)
    share = targets.filter("part = 'test'").agg(F.sum("n")).first()[0] / targets.agg(F.sum("n")).first()[0]
    assert 0.1 < share < 0.3
    with pytest.raises(RuntimeError):
        gbt.BoostedGap().predict(targets)
    with pytest.raises(curves.NothingToLearn):
        gbt.BoostedGap().fit(df.filter("elevation_gain > 50"))
    model = gbt.BoostedGap(rounds=3, depth=3).fit(df, 5.0)
    told = model.predict(targets).agg(F.avg(F.abs(F.col("prediction") - F.col("y"))), F.avg(F.abs(F.col("y") - 10.0))).first()
    assert told[0] <= told[1] * 1.05
    assert curves.reliability_curve(model.predict(targets)).filter("bin >= 20").count() == 0
    whole, part = (c.agg(F.sum("count")).first()[0] for c in (model.curve(), model.curve((0.0, 150.0))))
    assert 0 < part < whole


def test_few_training_rows_are_one_task(spark, monkeypatch):
    """A job of a tree costs most by its tasks: rows are dealt by their number, however many partitions they come in, and alike on every run."""
    df, _ = some_splits(spark, 40, 60)
    targets, seen = curves.flat_speed_targets(df, 5.0), []
    whole = gbt.GBTRegressor.fit
    monkeypatch.setattr(gbt.GBTRegressor, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or whole(self, rows))
    trees = [gbt.BoostedGap(rounds=2, depth=3).fit_targets(targets.repartition(k)).model.toDebugString.split("\n", 1)[1] for k in (3, 30)]
    assert seen == [1, 1] and trees[0] == trees[1]
    monkeypatch.setattr(gbt, "ROWS", 10)
    gbt.BoostedGap(rounds=1, depth=1).fit_targets(targets)
    assert seen[-1] > 1


def test_weighted_curves_equal_those_of_repeated_points(spark):
    points = spark.createDataFrame([(float(k % 90), (k % 7) / 10 + 0.5, k % 4 + 1) for k in range(200)], "elevation_gain double, adjuster double, n long")
    repeated = points.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("_", "n")
    a, b = (sorted(map(tuple, x.collect())) for x in (curves.equi_width_curve(points, weight="n"), curves.equi_width_curve(repeated)))
    assert [r[0::3] for r in a] == [r[0::3] for r in b] and all(x == pytest.approx(y) for x, y in zip(a, b))


@pytest.mark.parametrize("model", [lambda: curves.EfficiencyGap(20), lambda: gbt.BoostedGap(rounds=1, depth=1)])
def test_an_empty_range_of_heart_rates_is_an_error(spark, model):
    df, _ = some_splits(spark, 40, 60)
    fitted = model().fit(df)
    assert fitted.curve().columns == ["bin_center", "mean", "std", "count"] and fitted.predict(df).count() > 0
    with pytest.raises(ValueError, match="500"):
        fitted.curve((500.0, 600.0))


def test_boosted_curves_are_whole_by_default(samples):
    """Both models are fitted unless told not to, the boosted one with 100 rounds of depth 6."""
    model = gbt.BoostedGap().regressor
    assert (model.getMaxIter(), model.getMaxDepth(), model.getStepSize()) == (100, 6, 0.3)
    climb = lambda t: 0.1 * (t // 100 % 5) - 0.2
    run = [(t, 3 * t, sum(3 * climb(k) for k in range(t)), 140 + t % 7) for t in range(600)]
    df = samples(run)
    listed = df.select("activity_id", F.lit("Run").alias("sport_type"), F.lit("2024-01-01").alias("start_date")).distinct()
    split = lambda t: gap.dataset(t, warmup_s=0.0)
    found = gap.personal_curves(df, listed, per_bucket=10, references=False, split=split, model=lambda: gbt.BoostedGap(rounds=5), intensities=[(140.0, 144.0)]).collect()
    assert {r["curve"] for r in found} == {"all efficiency", "all boosted", "all efficiency 140-144", "all boosted 140-144"}
    assert sum(r["count"] for r in found if r["curve"] == "all boosted") > 0
    with pytest.raises(ValueError):
        gap.personal_curves(df, listed, split=split, boosted=False, intensities=[(10.0, 20.0)])
    found = gap.personal_curves(df, listed, per_bucket=10, references=False).collect()  # all of it is warm-up
    assert found == []


def test_races_are_limited_and_labelled(spark, samples):
    run = [(t, 3 * t, t % 7, 140) for t in range(0, 200, 2)]
    df = samples(run, run, run)
    with pytest.raises(ValueError):
        races.compare_races(df, [(k, None) for k in range(5)])
    metrics, series = races.compare_races(df, [(2, "Mine"), (0, None)], None, races.Smoothing(altitude=races.Filter()))
    found = metrics.collect()
    assert [(r["label"], r["activity_id"], r["avg_power_w"]) for r in found] == [("Mine", 2, None), ("Activity 0", 0, None)]
    assert found[0]["distance_km"] == pytest.approx(0.594) and found[0]["time_s"] == 198.0
    assert series.filter("power_w is not null").count() == 0
    flags = races.best_flags(metrics.limit(1)).first()
    assert not any(v for k, v in flags.asDict().items() if k.startswith("best"))


def test_progress_needs_a_date_and_two_samples(spark, samples):
    run = [(t, 3 * t, 0, 140) for t in range(0, 100)]
    df = samples(run, run, [(0, 0, 0, 1)])
    listed = spark.createDataFrame([(0, "Run", "2024-01-01"), (1, "Run", None), (2, "Run", "2024-01-01")], "activity_id long, sport_type string, d string").select("activity_id", "sport_type", F.to_timestamp("d").alias("start_date"))
    found = progress.activity_progress(df, listed, None).collect()
    assert [r["activity_id"] for r in found] == [0] and found[0]["power_to_hr"] is None
    assert found[0]["moving_seconds"] == 99.0 and set(found[0]["best_efforts"]) == {n for n, _ in C.PR_DISTANCES}


def test_undated_activities_pass_the_stream_filter(spark):
    df = spark.createDataFrame([(1, "Run", None), (2, "Run", "2020-01-01"), (3, "Ride", "2024-01-01"), (4, "Run", "2024-01-01")], "activity_id long, sport_type string, start_date string")
    assert sorted(r[0] for r in S.filter_streams(df, ["Run"], "2023-01-01", None).collect()) == [1, 4]
    assert S.filter_streams(df).count() == 4


def test_time_scales_are_checked():
    with pytest.raises(ValueError):
        gap.valid_scales([])
    with pytest.raises(ValueError):
        gap.valid_scales([("", None, None)])
    with pytest.raises(ValueError):
        gap.valid_scales([("x", 2, 1)])
    gap.valid_scales([("x", 1, 2), ("y", None, None)])


def test_table_source_and_csv(spark, tmp_path):
    S.telemetry_from_events(spark.createDataFrame([(k, k % 3, float(k)) for k in range(60)], "event_id long, user_id long, value double")).write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(0, "Run", "2024-01-03", True), (1, "Ride", "2024-01-02", True), (2, "Run", None, True), (3, "Run", "2024-01-01", False)], "activity_id long, sport_type string, start_date string, has_heartrate boolean").write.parquet(f"{tmp_path}/a")
    source = S.TableSource.load(spark, f"{tmp_path}/t", f"{tmp_path}/a")
    assert sorted(r[0] for r in source.list_activities(["Run"]).collect()) == [0, 2]
    assert sorted(r[0] for r in source.list_activities([], "2024-01-01", "2024-01-02").collect()) == [1]
    assert {r[0] for r in source.fetch_streams(max_activities=1).select("activity_id").collect()} == {0}
    assert source.fetch_single_stream(2).count() == 20
    S.write_curves_csv(C.reference_curves(spark), f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.count() == 30 and back.columns == ["curve", "bin_center_m_per_km", "speed_adjuster_mean", "speed_adjuster_std", "sample_count"]


def test_payloads_are_decoded_or_set_aside(spark):
    rows = [(1, [0.0, 1.0], [0.0, 3.0], [5.0, 5.0], [100.0, None]), (2, [0.0], [0.0, 1.0], [1.0], [1.0]), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "activity_id long, time array<double>, distance array<double>, altitude array<double>, heartrate array<double>")
    assert [tuple(r) for r in S.decode_streams(df).orderBy("seq").collect()] == [(1, 0, 0.0, 0.0, 5.0, 100.0), (1, 1, 1.0, 3.0, 5.0, None)]
    assert sorted(r["activity_id"] for r in S.mismatched_streams(df).collect()) == [2, 3]


def test_labels_that_repeat_are_numbered(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "activity_id long, label string")
    assert {r["activity_id"]: r["label"] for r in steps.numbered_labels(df).collect()} == {1: "a", 2: "a (1)", 3: "b", 4: "a (2)"}
