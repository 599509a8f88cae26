"""Connected components of a link table, by alternating large-star and small-star steps.

Each step joins every link to the smallest neighbour of one of its ends. Labels never meet in one task or on the
driver; only a count and a checksum of the links do, to see when they stand still. Lineage is cut with checkpoint()
in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, as in tests, a folder of this machine serves, but only
    if the master is this machine too; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has written, in whatever store its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _least(links: DataFrame) -> DataFrame:
    """(node, least): the smallest b of each a."""
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The different links as a checkpoint, and their count and checksum, which are taken as they are written."""
    told = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    links = links.distinct().observe(told, F.count(F.lit(1)).alias("n"), total.alias("total")).checkpoint()
    return links, (told.get["n"], told.get["total"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every id in links (columns a, b), the smallest id that can be reached from it.

    Links to oneself and repeated links are allowed. Raises if max_rounds don't suffice (each round about halves
    the longest path).

    Links are held with a > b, so the smallest of a node and its neighbours is the least b beside it as a, or else itself. A
    round has six stages (two more if Spark broadcasts the least ones), each of one task a partition, whatever its links: with many partitions and few links, what a task
    leaves on disk (its index file, its events) is more than the links. So there is no row for the other direction of a
    link, no union and no pass of its own for the checksum.
    """
    checkpoint_dir(links.sparkSession)
    links, seen = _written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if not seen[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # large star: the larger end goes to the smallest of the smaller end and its neighbours
        large = links.join(_least(links), F.col("b") == F.col("node"), "left").select("a", F.coalesce("least", "b").alias("b"))
        # small star: the node and its smaller neighbours go to the smallest of them; the node does in the row of the smallest
        small = large.join(_least(large), F.col("a") == F.col("node"))
        links, now = _written(small.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")))
        if now == seen:
            ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
            return links.select(F.inline(ends)).distinct()
        seen = now
    raise RuntimeError(f"links still change after {max_rounds} rounds")
