"""Payloads as a provider sends them: one JSON text for an activity, an object of streams that each hold an array `data`.

Texts are parsed to VARIANT, so a payload with other streams, or fewer, needs no schema of its own. Which payloads can't be
decoded, and why, is told by `payload_errors`; every payload is in one of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.activities import TELEMETRY

KINDS = {"time": "array<bigint>", "distance": "array<double>", "altitude": "array<double>", "heartrate": "array<double>"}


def parsed(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(activity_id, the streams' arrays, error): null arrays where a payload lacks them or has something else there.

    error is null for payloads that can be decoded; else `not JSON` (null and empty texts too), `no <stream>`, or `uneven`.
    Spark's parser ignores what follows a whole object. An activity without a heart rate stream is decoded with null heart
    rates; single values may be null in any stream."""
    held = raw.select("activity_id", F.try_parse_json(payload).alias("_v"))
    held = held.select("activity_id", "_v", *[F.try_variant_get("_v", f"$.{k}.data", kind).alias(k) for k, kind in KINDS.items()])
    held = held.withColumn("_bare", F.try_variant_get("_v", "$.heartrate", "variant").isNull())
    rate = F.when(F.col("_bare"), F.transform("time", lambda _: F.lit(None).cast("double"))).otherwise(F.col("heartrate"))
    held = held.withColumn("heartrate", rate)
    return held.select("activity_id", *KINDS, _error().alias("error"))


def _error() -> Column:
    n = F.size("time")
    even = (F.size("distance") == n) & (F.size("altitude") == n) & (F.size("heartrate") == n)
    found = F.when(F.col("_v").isNull(), "not JSON")
    for kind in KINDS:
        found = found.when(F.col(kind).isNull(), f"no {kind}")
    return found.when(~even, "uneven")


def decode_payloads(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Samples of the payloads that have no error: the array index becomes seq."""
    whole = parsed(raw, payload).filter("error is null")
    told = whole.select("activity_id", F.posexplode(F.arrays_zip(*KINDS)).alias("seq", "s"))
    return told.select("activity_id", F.col("seq").cast("long"), F.col("s.time").alias("t"), *[F.col(f"s.{c}").alias(c) for c in TELEMETRY[3:]])


def payload_errors(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(activity_id, error) of the payloads that decode_payloads leaves out."""
    return parsed(raw, payload).filter("error is not null").select("activity_id", "error")
