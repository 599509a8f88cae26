"""Exact k-means over integer vectors.

Every component becomes floor(scale * x), so distances, sums and centroids are integers and every run gives the same
clusters. Distances of a block of rows come from one matrix product, |x|^2 - 2 x.c + |c|^2 in float64: all terms and all
partial sums are integers, and while dimensions * (largest component of row and centroids together)^2 stays below 2^53
each of them is exact, in whatever order BLAS adds. Rows beyond that bound are compared in 64-bit integers, and beyond
their range in Python's integers, one slice of rows after the other.

A task reads its vectors batch by batch and gives one partial result: sums, counts and inertia of each cluster as Python
integers. An RDD's treeAggregate combines them, so the driver gets a few partial results of k * dimensions numbers
whatever the input. Each round reads the vectors again; a dear input should be checkpointed by the caller.

Defined results: vectors that are null, of another length, or hold a null or non-finite component aren't kept and have no
row. With fewer kept vectors than k there are as many centroids as vectors. Starting vectors of equal hashes (repeated
ids) are taken in the order of their components, null ids last. A distance or inertia that a long can't hold is null.
Repeated rows each get their own result; ids come back as they were; further columns are left out, whatever their names;
an empty table, or one without kept vectors, gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
EXACT, LONG = 1 << 53, 1 << 63
#: Rows of one matrix product, and of one slice of the integer comparison.
BLOCK, SLICE = 8192, 512

#: Sums of components (k x dimensions), counts and inertia of each cluster, all Python integers.
Partial = tuple[np.ndarray, np.ndarray, np.ndarray]


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers; a component beyond 2^53 is an integer before it is scaled."""
    flat = [int(v) * scale if abs(v) >= EXACT else int(np.floor(scale * v)) for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def by_product(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, for integer values within the bound."""
    distances = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
    labels = distances.argmin(axis=1)  # the first of equal ones
    return labels, distances[np.arange(len(x)), labels].astype(np.int64)


def by_integers(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from differences, in whatever integers the arrays hold."""
    labels, best = [], []
    for k in range(0, len(x), SLICE):
        away = x[k : k + SLICE, None, :] - c[None]
        distances = (away * away).sum(axis=2)
        labels.append(distances.argmin(axis=1).astype(np.int64))
        best.append(distances[np.arange(len(distances)), labels[-1]])
    return np.concatenate(labels), np.concatenate(best)


def nearest(x: np.ndarray, centroids: list[list[int]], scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, values, labels, distances) for parts of a block of vectors x (float64): the places of the part's rows among
    the block's, their integers, nearest centroids (ties: the smaller number) and squared distances."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    top = np.abs(scaled).max(axis=1)
    reach = max(abs(v) for c in centroids for v in c)
    dims = x.shape[1]
    within = lambda limit: (top < 2.0**62) & (dims * (top + float(reach)) ** 2 < limit)
    exact = within(EXACT) if reach < EXACT else np.zeros(len(x), dtype=bool)
    long = within(LONG / 2) & ~exact if reach < LONG >> 2 else np.zeros(len(x), dtype=bool)
    if exact.any():
        c, at = np.array(centroids, dtype=np.float64), exact.nonzero()[0]
        for part in np.array_split(at, -(-len(at) // BLOCK)):
            yield part, scaled[part], *by_product(scaled[part], c)
    if long.any():
        part = long.nonzero()[0]
        values = scaled[part].astype(np.int64)
        yield part, values, *by_integers(values, np.array(centroids, dtype=np.int64))
    rest = ~(exact | long)
    if rest.any():
        part = rest.nonzero()[0]
        values = whole(x[part], scale)
        yield part, values, *by_integers(values, np.array(centroids, dtype=object))


def nothing(k: int, dims: int) -> Partial:
    return np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object), np.zeros(k, dtype=object)


def add(a: Partial, b: Partial) -> Partial:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def summed(values: np.ndarray, labels: np.ndarray, distances: np.ndarray, k: int) -> Partial:
    """A part's sums for each centroid, exact: by a matrix product where its sums stay below 2^53."""
    counts = np.bincount(labels, minlength=k).astype(object)
    if values.dtype == np.float64 and len(values) * np.abs(values).max() < EXACT:
        sums = ((labels[None, :] == np.arange(k)[:, None]).astype(np.float64) @ values).astype(np.int64).astype(object)
    else:
        sums = np.zeros((k, values.shape[1]), dtype=object)
        whole_numbers = (values.astype(np.int64) if values.dtype == np.float64 else values).astype(object)
        for label in np.unique(labels):
            sums[label] = whole_numbers[labels == label].sum(axis=0)
    inertia = np.zeros(k, dtype=object)
    for label in np.unique(labels):
        inertia[label] = sum(distances[labels == label].tolist())
    return sums, counts, inertia


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, all of one length, as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def partial_sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> Partial:
    """Sums, counts and inertia of the vectors' nearest centroids, over all rows."""
    k, dims = len(centroids), len(centroids[0])

    def one_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = nothing(k, dims)
        for rows in batches:
            if rows.num_rows:
                for _, values, labels, distances in nearest(matrix(rows.column(0), dims), centroids, scale):
                    told = add(told, summed(values, labels, distances, k))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(told)], pa.binary())], names=["told"])

    partials = vectors.select("v").mapInArrow(one_of_task, "told binary").rdd
    return partials.treeAggregate(nothing(k, dims), lambda a, row: add(a, pickle.loads(row["told"])), add)


def is_vector(embedding: Column, dims: int) -> Column:
    """Whether there are exactly so many components, none null or non-finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dims) & finite, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the k smallest hashes of seed and id, in that order."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.withColumn("code", code).orderBy(F.asc_nulls_last("code"), "v").limit(k).collect()  # k rows
    return [whole(np.array([r["v"]], dtype=np.float64), scale)[0].tolist() for r in rows]


def moved(centroids: list[list[int]], told: Partial) -> list[list[int]]:
    """The floors of the clusters' means; a centroid without vectors stays."""
    sums, counts, _ = told
    return [[int(s) // int(n) for s in sums[i]] if (n := counts[i]) else c for i, c in enumerate(centroids)]


def clusters(
    embeddings: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = 1,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    centroid_sha256 is of the final centroid's components as decimal numbers joined by commas."""
    if k < 1 or rounds < 0:
        raise ValueError("k must be 1 or more and rounds 0 or more")
    vectors = embeddings.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(is_vector(F.col("v"), dims))
    schema = f"vec_id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, seed, scale)
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(centroids, partial_sums(vectors, centroids, scale))
    inertia = [int(x) for x in partial_sums(vectors, centroids, scale)[2]]
    fits = lambda x: x if x < LONG else None
    own = pa.array([fits(x) for x in inertia], pa.int64())
    names = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])
    total = fits(sum(inertia))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            labels, distances = np.zeros(rows.num_rows, dtype=np.int32), np.zeros(rows.num_rows, dtype=object)
            for part, _, found, away in nearest(matrix(rows.column("v"), dims), centroids, scale):
                labels[part], distances[part] = found, away
            far = pa.array([fits(x) for x in distances.tolist()], pa.int64())
            columns = [rows.column("id"), pa.array(labels), far, own.take(pa.array(labels)), pa.array([total] * rows.num_rows, pa.int64()), names.take(pa.array(labels))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(told, schema)


def clusters_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> str:
    """The same by differences of integers, one pair of CTEs for each round."""
    steps = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
            from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"c0 as materialized (select cast(row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as integer) as c, v from kept qualify c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} as materialized (select r, vec_id, k.v, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.c)) as best
            from kept k cross join c{i} c group by r, vec_id, k.v)""")
        steps.append(f"""sums{i} as (select c, i, sum(x) as s, count(*) as n from (select best.c as c, unnest(v) as x, generate_subscripts(v, 1) as i from near{i}) group by c, i)""")
        steps.append(f"""c{i + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from c{i} c left join
            (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from sums{i} group by c) m on m.c = c.c)""")
    return f"""with {", ".join(steps)}
        select vec_id, best.c as cluster, cast(best.d as bigint) as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
               cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(f.v, ',')) as centroid_sha256
        from near{rounds} n join c{rounds} f on f.c = n.best.c"""


CLUSTERS_SQL = clusters_sql()
