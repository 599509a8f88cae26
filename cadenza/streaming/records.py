"""Records of a live stream of samples: rows may come late, in any order and more than once.

What decides a group's progression is its front, the samples that beat all on days before them; a sample that isn't on it never
will be. Fronts can be merged: the front of two sets of samples is that of their fronts. So a group is dealt by activity to
some keys, each of which keeps a front and its least sample as state, some tens of rows whatever has arrived, and the batch
functions of `operators.records` merge what the keys keep. Records are for all time, so nothing of this state expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cadenza.operators import records

KEYS = 16
CHANGES = "label string, salt int, version long, kind string, day int, value double, activity_id long, kept boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def earliest(day: int | None) -> tuple[bool, int]:
    """Order of days; no day is before all others, as nulls are in Spark's."""
    return (day is not None, day or 0)


def front(samples: list[tuple[int | None, float]]) -> list[tuple[int | None, float]]:
    """The samples (day, value) that are less than all of the days before them, and the least of their own day."""
    found: list[tuple[int | None, float]] = []
    for day, value in sorted(samples, key=lambda s: (earliest(s[0]), s[1])):
        if not found or value < found[-1][1]:
            found.append((day, value))
    return found


class RecordKeeper(StatefulProcessor):
    """Tells what a batch changes: days that come to the front or leave it, and the least sample if it is another one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.front = handle.getListState("front", "day int, value double")
        self.least = handle.getValueState("least", "value double, activity_id long, day int")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        first = not self.version.exists()
        before = [(r[0], r[1]) for r in self.front.get()] if not first else []
        least = tuple(self.least.get()) if self.least.exists() else None
        was, now = least, dict(before)
        for r in rows:
            if r["value"] is None:
                continue
            day, sample = r["day"], (r["value"], r["activity_id"], r["day"])
            now[day] = min(now.get(day, r["value"]), r["value"])
            if least is None or (sample[0], earliest(sample[1]), earliest(day)) < (least[0], earliest(least[1]), earliest(least[2])):
                least = sample
            if len(now) > 10_000:  # what a batch brings is reduced as it is read
                now = dict(front(list(now.items())))
        after = front(list(now.items()))
        if not first and after == before and least == was:
            return
        version = 0 if first else self.version.get()[0] + 1
        told = lambda kind, value, activity, day, kept: Row(label=key[0], salt=key[1], version=version, kind=kind, day=day, value=value, activity_id=activity, kept=kept)
        for day, value in before:
            if all(day != d for d, _ in after):
                yield told("front", value, None, day, False)
        for day, value in after:
            if (day, value) not in before:
                yield told("front", value, None, day, True)
        if first or least != was:
            value, activity, day = least or (None, None, None)
            yield told("least", value, activity, day, True)
        self.version.update((version,))
        if after:
            self.front.put(after)
        if least is not None:
            self.least.update(least)

    def close(self) -> None:
        pass


def record_changes(samples: DataFrame) -> DataFrame:
    """The stream of changes to what is kept of a stream of samples (label, activity_id, date, value)."""
    dealt = samples.select("label", F.pmod(F.xxhash64("activity_id"), F.lit(KEYS)).cast("int").alias("salt"), F.unix_date("date").alias("day"), F.col("value").cast("double").alias("value"), F.col("activity_id").cast("long").alias("activity_id"))
    return dealt.groupBy("label", "salt").transformWithState(RecordKeeper(), CHANGES, "Update", "None")


def keep_records(samples: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the changes to files; folder and checkpoint are URIs of a shared place. State is kept by RocksDB."""
    spark, name = samples.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        sink = record_changes(samples).writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}"))
        return sink.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def last_told(changes: DataFrame, kind: str, *of: str) -> DataFrame:
    """What the keys keep now: of each key (and day) the change with the highest version, if it is kept. A batch that was
    replayed has written its changes again, alike."""
    nth = F.row_number().over(Window.partitionBy("label", "salt", *of).orderBy(F.desc("version")))
    held = changes.filter(F.col("kind") == kind).withColumn("_nth", nth).filter("_nth = 1 and kept")
    return held.select("label", "activity_id", F.date_from_unix_date("day").alias("date"), "value")


def progression(changes: DataFrame) -> DataFrame:
    """(label, date, value), as `records.record_progression` of all samples that have arrived."""
    return records.record_progression(last_told(changes, "front", "day"))


def current(changes: DataFrame) -> DataFrame:
    """(label, date, value), as `records.current_records` of all samples that have arrived."""
    return records.current_records(last_told(changes, "least"))
