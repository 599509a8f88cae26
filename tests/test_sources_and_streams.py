import random
import time

import pytest
from pyspark.sql import functions as F

from cadenza.operators import records
from cadenza.sources import activities as S
from cadenza.sources.remote import fetch_streams
from cadenza.sources.saved import saved, signature
from cadenza.streaming import records as live_records
from cadenza.streaming.live import live_splits


def provider(i, kinds, resolution):
    if i == 2:
        raise KeyError("no such stream")
    return {k: [0.0, 1.0, None if k == "heartrate" else 2.0] for k in kinds}


def test_one_failure_does_not_end_the_others(spark):
    listing = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, "2024-01-02"), (4, None)], "activity_id long, start_date string")
    done = spark.sparkContext.accumulator(0)
    found = fetch_streams(listing, provider, max_activities=3, throttle_s=0, tasks=2, done=done).cache()
    assert {r["activity_id"]: r["error"] for r in found.collect()} == {1: None, 2: "KeyError: 'no such stream'", 3: None}
    assert S.decode_streams(found.filter("error is null")).count() == 6
    assert done.value == 3


def test_results_are_made_once_for_each_signature(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    assert [saved(spark, str(tmp_path), make, mass=70, ids=[1]).count() for _ in range(3)] == [1, 1, 1]
    assert saved(spark, str(tmp_path), make, mass=71, ids=[1]).count() == 2 and len(made) == 2
    assert signature(a=1, b=2) == signature(b=2, a=1) != signature(a=1, b=3)


@pytest.mark.parametrize("parts", [1, 3])
def test_live_splits_equal_those_of_the_whole(spark, tmp_path, parts):
    from cadenza.operators.splits import cuts

    rows = [(a, k, float(k * (k % 3 + 1) // 2 + k), 3.0 * k, 120.0 + k % 5) for a in (1, 2) for k in range(90)]
    df = spark.createDataFrame(rows, "activity_id long, seq long, t double, distance double, heartrate double")
    df = df.withColumn("t", F.col("seq") * 2.0)
    for p in range(parts):
        df.filter(F.floor(F.col("seq") * parts / 90) == p).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"live{parts}"
    q = live_splits(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = spark.table(name).orderBy("activity_id", "split_id").collect()
    import numpy as np

    ends = cuts(np.arange(90) * 2.0, 10.0)
    assert [r["end_t"] for r in found] == [e * 2.0 for e in ends] * 2
    assert [r["split_id"] for r in found] == list(range(len(ends))) * 2 and all(r["distance"] == 15.0 and r["n_samples"] == 5 for r in found)


def test_an_idle_activity_is_forgotten(spark, tmp_path):
    schema = "activity_id long, seq long, t double, distance double, heartrate double"
    sample = lambda a, k: (a, k, 6.0 * k, 3.0 * k, 120.0)
    for batch in ([sample(1, k) for k in range(5)], [sample(2, k) for k in range(2)], [sample(1, k) for k in range(3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = live_splits(stream, idle_s=0.05).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        try:
            out.trigger(availableNow=True).start().awaitTermination(30)
        finally:
            spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        time.sleep(0.2)
    found = spark.read.parquet(f"{tmp_path}/out").select("activity_id", "split_id", "start_t").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0.0), (1, 0, 0.0), (1, 1, 12.0)]


def test_live_records_equal_those_of_the_whole_whatever_the_order(spark, tmp_path):
    """Late and repeated samples, samples without a value, a day, an id or a label, ties of value; a stop between two runs."""
    rng, schema = random.Random(5), "label string, activity_id long, date date, value double"
    rows = [(rng.choice("ab"), k, f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", float(rng.randrange(50, 90))) for k in range(150)]
    rows += [("a", None, "2024-05-01", 55.0), ("b", 900, None, 70.0), (None, 901, "2024-01-01", 3.0), ("c", 902, "2024-01-01", None), ("a", 2**53 + 1, "2023-01-01", 89.0)]
    rows += rows[::7]
    rng.shuffle(rows)
    make = lambda part: spark.createDataFrame(part, "label string, activity_id long, date string, value double").withColumn("date", F.col("date").cast("date"))
    for part in (rows[:60], rows[60:]):
        make(part).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live_records.keep_records(stream, f"file://{tmp_path}/changes", f"{tmp_path}/state").awaitTermination()
    changes, told = spark.read.schema(live_records.CHANGES).parquet(f"{tmp_path}/changes"), lambda d: sorted(map(str, d.collect()))
    assert told(live_records.progression(changes)) == told(records.record_progression(make(rows)))
    assert told(live_records.current(changes)) == told(records.current_records(make(rows)))
    replayed = changes.unionByName(changes.limit(20))
    assert told(live_records.progression(replayed)) == told(records.record_progression(make(rows)))
