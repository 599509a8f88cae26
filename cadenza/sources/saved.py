"""Results kept as Parquet with a manifest of what they were made from: load once, analyse many times.

A result lives in a folder named by the signature of its parameters. The manifest `current.json` beside its versions names
the one that counts, with the parameters and a fingerprint of the inputs (schema, number of rows, and an order-free sum
of row hashes). Where the inputs have changed, the result is made anew. A version is written as a whole before the
manifest is exchanged by a rename, so readers see the old or the new one; of two writers of the same result, the
manifest names one, and the versions it doesn't name are deleted by the next writer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "current.json"


def signature(**parameters) -> str:
    """A short name that is the same for the same parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(inputs: Sequence[DataFrame]) -> list[str]:
    """Of each input its schema, rows and the sum of its rows' hashes, in one pass and whatever the order."""
    found = []
    for df in inputs:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        found.append(hashlib.sha256(f"{df.schema.json()}|{row[0]}|{row[1]}".encode()).hexdigest())
    return found


def manifest(folder: str) -> dict | None:
    store, top = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{top}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{top}/{MANIFEST}") as told:
        return json.loads(told.read())


def publish(folder: str, told: dict) -> None:
    """Exchanges the manifest by a rename."""
    store, top = fs.FileSystem.from_uri(folder)
    draft = f"{top}/.{MANIFEST}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(json.dumps(told, default=str).encode())
    store.move(draft, f"{top}/{MANIFEST}")


def saved(spark: SparkSession, folder: str, make: Callable[[], DataFrame], inputs: Sequence[DataFrame] = (), **parameters) -> DataFrame:
    """What make() gives, kept in the folder (a URI of a shared one) under the parameters' signature; made again only when
    the inputs have changed since."""
    top = f"{folder.rstrip('/')}/{signature(**parameters)}"
    own = fingerprint(inputs)
    there = manifest(top)
    if there is None or there["inputs"] != own:
        version = f"v-{uuid.uuid4().hex}"
        make().write.parquet(f"{top}/{version}")
        before = there
        publish(top, {"version": version, "parameters": parameters, "inputs": own})
        if before is not None:
            delete_version(top, before["version"])
        there = manifest(top)
    return spark.read.parquet(f"{top}/{there['version']}")


def delete_version(folder: str, version: str) -> None:
    store, top = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{top}/{version}").type == fs.FileType.Directory:
        store.delete_dir(f"{top}/{version}")
