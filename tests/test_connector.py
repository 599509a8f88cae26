"""The Python data sources: filters that reach the reader, a stream that goes on where it stopped, a sink of all or nothing; and the store of results."""

import json
import sys
from datetime import date, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThanOrEqual, StringContains

from cadenza.sources import connector
from cadenza.sources.saved import manifest, saved, signature

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def listing(spark):
    rows = [(i, "Run" if i % 3 else "TrailRun", None if i % 10 == 0 else date(2024, 1, 1) + timedelta(days=i // 2), i % 4 != 0) for i in range(1, 101)]
    return spark.createDataFrame(rows, connector.LISTING), rows


@pytest.fixture
def pages(spark, listing, tmp_path):
    connector.register(spark)
    path = f"file://{tmp_path}/listing"
    connector.write_pages(listing[0], path, 10)
    return path


def test_pages_follow_dates(pages):
    assert connector.pages_of(pages) == [f"page={k}" for k in range(10)]


def test_filters_reach_the_reader(spark, pages, listing):
    reader = connector.ListingReader(pages)
    low, high = date(2024, 1, 10), date(2024, 1, 20)
    asked = [IsNotNull(("start_date",)), GreaterThanOrEqual(("start_date",), low), LessThanOrEqual(("start_date",), high), In(("sport_type",), ("Run", "Ride")), EqualTo(("has_heartrate",), True), StringContains(("sport_type",), "R")]
    left = list(reader.pushFilters(asked))
    assert left == asked[-1:]
    parts = reader.partitions()
    assert 0 < len(parts) < 5  # of ten pages
    found = {i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()}
    assert found == {i for i, sport, day, hr in listing[1] if sport == "Run" and day and low <= day <= high and hr}
    df = connector.listed(spark, pages)
    asked = df.filter(F.col("sport_type").isin("Run", "Ride") & F.col("start_date").between(low, high) & F.col("has_heartrate"))
    assert asked.rdd.getNumPartitions() == len(parts) and {r["activity_id"] for r in asked.collect()} == found
    assert connector.listed(spark, pages).count() == 100
    assert {r["activity_id"] for r in connector.listed(spark, pages).filter("start_date is null").collect()} == {i for i, _, day, _ in listing[1] if day is None}
    assert connector.listed(spark, pages).filter("start_date > date'2030-01-01'").count() == 0


def provider(i, kinds, remote):
    """Fails for every seventh activity; while the file `fuse` is there, the process of activity 35 fails as a whole."""
    with open(f"{remote}/fetched-{i}", "a") as out:
        out.write("x")
    if i == 35 and Path(remote, "fuse").exists():
        raise SystemExit("killed")
    if i % 7 == 0 and i != 35:
        raise KeyError(f"stream {i}")
    return {k: [float(i), None, 1.0] for k in kinds}


def test_a_stopped_stream_goes_on_and_fetches_each_activity_once(spark, pages, tmp_path):
    remote = tmp_path / "remote"
    remote.mkdir()
    (remote / "fuse").touch()

    def run():
        stream = spark.readStream.format("activity_payloads").options(path=pages, log=f"file://{tmp_path}/log", provider="tests.test_connector:provider", remote=str(remote)).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception):  # noqa: B017
        run()
    before = {p.name for p in (tmp_path / "log").glob("[0-9]*.json")}
    assert before and not (tmp_path / "out/_spark_metadata/0").exists()  # no batch has been committed
    (remote / "fuse").unlink()
    run()
    run()  # nothing new
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["activity_id"] for r in found) == list(range(1, 101))
    assert {r["activity_id"]: r["error"] for r in found if r["error"]} == {i: f"KeyError: 'stream {i}'" for i in range(7, 101, 7) if i != 35}
    assert all(r["time"] == [float(r["activity_id"]), None, 1.0] for r in found if not r["error"])
    once = {int(p.name.removeprefix("fetched-")): p.stat().st_size for p in remote.glob("fetched-*")}
    assert all(once[int(name.removesuffix(".json"))] == 1 for name in before)  # what was kept wasn't fetched again
    more = spark.createDataFrame([(500, "Run", date(2025, 1, 1), True)], connector.LISTING)
    more.write.parquet(f"{pages}/page=10")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").filter("activity_id = 500").count() == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 101


def test_a_payload_is_read_from_its_row_group_alone(tmp_path, monkeypatch):
    """A fetch reads a row group, and footers once by a process, however many files and activities there are; new files are seen."""
    ids = list(range(0, 4000, 2))
    for k in range(2):
        rows = [i for i in ids if i // 2000 == k]
        pq.write_table(pa.table({"activity_id": rows} | {c: [[float(i), None] for i in rows] for c in connector.KINDS}), tmp_path / f"{k}.parquet", row_group_size=100)
    read, opened = [], []
    whole, init = pq.ParquetFile.read_row_group, pq.ParquetFile.__init__
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, k, **more: read.append(k) or whole(self, k, **more))
    monkeypatch.setattr(pq.ParquetFile, "__init__", lambda self, source, **more: opened.append("metadata" in more) or init(self, source, **more))
    remote = f"file://{tmp_path}"
    assert all(connector.payload_in_table(i, connector.KINDS, remote) == dict.fromkeys(connector.KINDS, [float(i), None]) for i in (0, 198, 200, 1998, 2000, 3998))
    assert len(read) == 6 and opened.count(False) == 2
    for i in (-1, 3, 5000):
        with pytest.raises(KeyError, match=f"stream {i}"):
            connector.payload_in_table(i, connector.KINDS, remote)
    pq.write_table(pa.table({"activity_id": [5000]} | {c: [[1.0]] for c in connector.KINDS}), tmp_path / "more.parquet")
    assert connector.payload_in_table(5000, ["time"], remote) == {"time": [1.0]}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    connector.register(spark)
    path = f"file://{tmp_path}/curves"
    rows = spark.range(20).selectExpr("concat('c, \"', id % 3, '\"') as curve", "id / 4 as bin_center", "if(id % 5 = 0, null, id * 1.5D) as mean").repartition(4)
    boom = F.udf(lambda x: 1 / (x - 4.5) if x != 4.5 else 1 / 0, "double")
    with pytest.raises(PySparkException):
        rows.withColumn("mean", boom(F.col("bin_center") + 0.0)).write.format("curve_files").option("path", path).mode("append").save()
    left = [p.name for p in (tmp_path / "curves").iterdir() if not p.name.endswith(".crc")] if (tmp_path / "curves").exists() else []
    assert left == []
    for times in (1, 2):
        rows.write.format("curve_files").option("path", path).mode("append").save()
        back = spark.read.option("header", True).schema("curve string, bin_center double, mean double").option("escape", '"').csv(f"{path}/part-*.csv")
        assert sorted(map(str, back.collect())) == sorted([*map(str, rows.collect())] * times)
    rows.limit(3).write.format("curve_files").option("path", path).mode("overwrite").save()
    told = json.loads((tmp_path / "curves/manifest.json").read_text())
    assert sum(f["rows"] for f in told["files"]) == 3 and sorted(p.name for p in (tmp_path / "curves").glob("part-*.csv")) == sorted(f["file"] for f in told["files"])


def test_results_are_made_again_when_their_input_has_changed(spark, tmp_path):
    folder, made = f"file://{tmp_path}/kept", []

    def make():
        made.append(1)
        return spark.range(len(made))

    one, other = spark.range(5).selectExpr("id", "cast(null as string) as x"), spark.range(6).selectExpr("id", "cast(null as string) as x")
    assert [saved(spark, folder, make, [one.repartition(k)], mass=70).count() for k in (1, 3)] == [1, 1]
    assert saved(spark, folder, make, [one], mass=71).count() == 2 and len(made) == 2
    assert saved(spark, folder, make, [other], mass=70).count() == 3 and len(made) == 3
    top = f"{folder}/{signature(mass=70)}"
    versions = [p.name for p in (tmp_path / "kept" / signature(mass=70)).glob("v-*")]
    assert versions == [manifest(top)["version"]] and manifest(top)["parameters"] == {"mass": 70}


def test_two_writers_leave_one_result(spark, tmp_path):
    """The second writer begins while the first one is making the result."""
    folder = f"file://{tmp_path}/kept"

    def slow():
        assert saved(spark, folder, lambda: spark.range(1), year=1).count() == 1
        return spark.range(2)

    assert saved(spark, folder, slow, year=1).count() == 2
    assert saved(spark, folder, lambda: spark.range(9), year=1).count() == 2
