"""Spark data sources in Python: a paged listing of activities, a resumable stream of their payloads, and a sink for curves.

`activity_listing` reads a listing that is kept in pages (folders `page=0`, `page=1`, ... of Parquet files): one partition
for each page. Filters on sport and date go to the reader, which leaves out pages by their files' statistics and rows
within pages.

`activity_payloads` streams what a provider has for the listed activities. Its offset is the number of pages seen, so a new
page is a new batch, and the query's checkpoint says where to go on. Each payload that has been fetched is kept in a
log folder under a name of its own, written as a draft and renamed, so an activity whose task was lost or whose query
was stopped isn't fetched again. An activity that the provider fails for gives a row with the error, which can be put
aside, and doesn't end the others.

`curve_files` writes rows as CSV files, one for each task, under draft names; the driver renames them and writes a manifest
when all tasks are done, and deletes them if one has failed. Readers see all of a job's files or none.

Paths are URIs that pyarrow's file systems open, in a folder that driver and executors share.
"""

from __future__ import annotations

import csv
import importlib
import io
import json
import math
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

LISTING = "activity_id bigint, sport_type string, start_date date, has_heartrate boolean"
KINDS = ("time", "distance", "altitude", "heartrate")
PAYLOADS = "activity_id bigint, " + ", ".join(f"{k} array<double>" for k in KINDS) + ", error string"


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ActivityListing, ActivityPayloads, CurveFiles):
        spark.dataSource.register(source)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The listing, loaded anew: Spark keeps what has been pushed to a Python reader with the frame it was loaded as, so a
    frame should serve one query."""
    return spark.read.format(ActivityListing.name()).option("path", path).load()


def write_pages(listing: DataFrame, path: str, per_page: int) -> None:
    """A listing as pages of about so many activities, by date, the undated ones last.

    Pages are cut by ranks within days' running counts, so no more than a day's activities are put in order at once."""
    from pyspark.sql import Window

    days = listing.groupBy("start_date").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.col("start_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(F.col("start_date").alias("_day"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("start_date").orderBy("activity_id")) - 1
    placed = listing.withColumn("_nth", nth).join(starts, F.col("start_date").eqNullSafe(F.col("_day")))
    page = F.floor((F.col("_before") + F.col("_nth")) / per_page).alias("page")
    placed.select("activity_id", "sport_type", "start_date", "has_heartrate", page).repartition("page").write.mode("overwrite").partitionBy("page").parquet(path)


def pages_of(path: str) -> list[str]:
    """The page folders of a listing, in order of their numbers."""
    store, top = fs.FileSystem.from_uri(path)
    found = [x.base_name for x in store.get_file_info(fs.FileSelector(top)) if x.base_name.startswith("page=")]
    return sorted(found, key=lambda name: int(name.removeprefix("page=")))


def page_files(path: str, page: str) -> tuple[fs.FileSystem, list[str]]:
    store, top = fs.FileSystem.from_uri(path)
    return store, sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{top}/{page}")) if x.path.endswith(".parquet"))


@dataclass
class Page(InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class ActivityListing(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "activity_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"])


class ListingReader(DataSourceReader):
    """Reads the pages that can hold what the pushed filters ask for."""

    COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, path: str):
        self.path = path
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, IsNotNull) and column in ("sport_type", "start_date", "has_heartrate"):
                self.pushed.append((column, "there", None))
            elif isinstance(f, In) and column == "sport_type":
                self.pushed.append((column, "in", list(f.value)))
            elif type(f) in self.COMPARED and column in ("sport_type", "start_date", "has_heartrate"):
                self.pushed.append((column, self.COMPARED[type(f)], f.value))
            else:
                yield f  # Spark's own work

    def _can_hold(self, page: str) -> bool:
        """Whether a page's dates, by its files' statistics, meet the pushed filters."""
        store, files = page_files(self.path, page)
        for file in files:
            with store.open_input_file(file) as opened:
                meta = pq.ParquetFile(opened).metadata
                at = meta.schema.to_arrow_schema().get_field_index("start_date")
                for k in range(meta.num_row_groups):
                    told = meta.row_group(k).column(at).statistics
                    dates = [(c, v) for column, c, v in self.pushed if column == "start_date" and c not in ("there", "in")]
                    if told is None or not dates or (told.has_min_max and all(self._meets(told.min, told.max, c, v) for c, v in dates)):
                        return True
        return False

    @staticmethod
    def _meets(low, high, compared: str, value) -> bool:
        return {"==": low <= value <= high, ">": high > value, ">=": high >= value, "<": low < value, "<=": low <= value}[compared]

    def partitions(self) -> Sequence[InputPartition]:
        return [Page(name) for name in pages_of(self.path) if self._can_hold(name)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, files = page_files(self.path, partition.name)
        kept = ds.scalar(True)
        for column, compared, value in self.pushed:
            c = ds.field(column)
            tests = {"there": lambda: c.is_valid(), "in": lambda: c.isin(value), "==": lambda: c == value, ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value}  # noqa: B023
            kept = kept & tests[compared]()
        yield from ds.dataset(files, filesystem=store).to_batches(columns=["activity_id", "sport_type", "start_date", "has_heartrate"], filter=kept)


class ActivityPayloads(DataSource):
    """Options: path (of the listing's pages), log (folder of fetched payloads), provider (`module:function`, called with an
    activity id, the kinds, and the option `remote`), remote, throttle_s."""

    @classmethod
    def name(cls) -> str:
        return "activity_payloads"

    def schema(self) -> str:
        return PAYLOADS

    def streamReader(self, schema: StructType) -> PayloadStream:
        return PayloadStream(dict(self.options))


class PayloadStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(pages_of(self.options["path"]))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Page(name) for name in pages_of(self.options["path"])[start["pages"] : end["pages"]]]

    def read(self, partition: Page) -> Iterator[tuple]:
        store, files = page_files(self.options["path"], partition.name)
        ids = sorted(i for file in files for i in pq.read_table(file, columns=["activity_id"], filesystem=store)["activity_id"].to_pylist())
        module, _, function = self.options["provider"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        kept, top = fs.FileSystem.from_uri(self.options["log"])
        kept.create_dir(top, recursive=True)
        for i in ids:
            at = f"{top}/{i}.json"
            if kept.get_file_info(at).type == fs.FileType.File:
                with kept.open_input_stream(at) as told:
                    found = json.loads(told.read())
            else:
                try:
                    found = fetch(i, KINDS, self.options.get("remote"))
                except Exception as e:  # one activity that fails doesn't end the others
                    yield (i, *[None] * len(KINDS), f"{type(e).__name__}: {e}")
                    continue
                draft = f"{top}/.{i}-{uuid.uuid4().hex}"
                with kept.open_output_stream(draft) as out:
                    out.write(json.dumps(found).encode())
                kept.move(draft, at)
                time.sleep(float(self.options.get("throttle_s", "0")))
            yield (i, *[[None if x is None else float(x) for x in found[k]] for k in KINDS], None)

    def commit(self, end: dict) -> None:
        """Nothing to do: the query's checkpoint has the offset."""


def row_groups(remote: str) -> tuple[fs.FileSystem, list[tuple]]:
    """The row groups of a folder's Parquet files as (least id, most id, file, metadata, number, most id so far), by their least id.
    Those without statistics can hold any id."""
    store, top = fs.FileSystem.from_uri(remote)
    return store, _row_groups(remote, tuple(sorted((x.path, x.size, x.mtime_ns) for x in store.get_file_info(fs.FileSelector(top)) if x.path.endswith(".parquet"))))


@lru_cache(maxsize=4)
def _row_groups(remote: str, files: tuple[tuple, ...]) -> list[tuple]:
    """Footers are read once by a process, and again when the files are others."""
    store, _ = fs.FileSystem.from_uri(remote)
    found = []
    for path, _, _ in files:
        with store.open_input_file(path) as opened:
            meta = pq.ParquetFile(opened).metadata
        at = [k for k in range(meta.num_columns) if meta.schema.column(k).path == "activity_id"][0]
        for k in range(meta.num_row_groups):
            told = meta.row_group(k).column(at).statistics
            known = told is not None and told.has_min_max
            found.append((told.min if known else -math.inf, told.max if known else math.inf, path, meta, k))
    found.sort(key=lambda g: g[:3] + g[4:])
    return [(*g, most) for g, most in zip(found, accumulate((g[1] for g in found), max), strict=True)]


def payload_in_table(activity_id: int, kinds: Sequence[str], remote: str | None) -> dict[str, list]:
    """A provider over a folder of Parquet files with a row of arrays for each activity. Raises if there is none.

    Only row groups whose ids reach around the asked one are read, so files in order of ids with small row groups
    answer alike however long they are."""
    store, groups = row_groups(remote)
    for at in range(bisect_right(groups, activity_id, key=lambda g: g[0]) - 1, -1, -1):
        _, most, path, meta, k, most_so_far = groups[at]
        if most_so_far < activity_id:
            break
        if most < activity_id:
            continue
        with store.open_input_file(path) as opened:
            rows = pq.ParquetFile(opened, metadata=meta).read_row_group(k, columns=["activity_id", *kinds])
        found = rows.filter(pc.equal(rows["activity_id"], activity_id)).select(list(kinds)).to_pylist()
        if found:
            return found[0]
    raise KeyError(f"stream {activity_id}")


@dataclass
class WrittenFile(WriterCommitMessage):
    draft: str
    rows: int
    columns: list[str] = field(default_factory=list)


class CurveFiles(DataSource):
    """Options: path. Files `part-00000.csv`, ... with a header, and `manifest.json` with their names and rows."""

    @classmethod
    def name(cls) -> str:
        return "curve_files"

    def schema(self) -> str:
        return "curve string"

    def writer(self, schema: StructType, overwrite: bool) -> CurveWriter:
        return CurveWriter(self.options["path"], schema.fieldNames(), overwrite)


class CurveWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = path, columns, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WrittenFile:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(top, recursive=True)
        draft, rows = f"{top}/.draft-{self.job}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(draft) as out:
            text = io.TextIOWrapper(out, encoding="utf-8", newline="", write_through=False)
            told = csv.writer(text)
            told.writerow(self.columns)
            for row in iterator:
                told.writerow(["" if x is None else x for x in row])
                rows += 1
            text.flush()
            text.detach()
        return WrittenFile(draft, rows, self.columns)

    def _delete(self, begins: str) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if x.base_name.startswith(begins):
                store.delete_file(x.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            self._delete("part-")
        first = sum(x.base_name.startswith("part-") for x in store.get_file_info(fs.FileSelector(top)))
        files = []
        for k, m in enumerate(sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.draft)):
            name = f"part-{first + k:05d}.csv"
            store.move(m.draft, f"{top}/{name}")
            files.append({"file": name, "rows": m.rows})
        self._delete(f".draft-{self.job}")
        with store.open_output_stream(f"{top}/manifest.json") as out:
            out.write(json.dumps({"columns": self.columns, "files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete(f".draft-{self.job}")
