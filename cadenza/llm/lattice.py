"""Embedding near-dedup by E8 lattice hashing.

Each table projects the unit vectors to BLOCKS x 8 dimensions by a random matrix of its own, scales and shifts them,
and decodes each 8 to the nearest point of the E8 lattice; the points are the vector's cell. A vector is stored in
its own cell of every table, and looks into its own and into the PROBES neighbouring cells that are nearest to it (a
neighbour differs by one of the lattice's 240 shortest vectors in one block). Pairs that meet are verified by cosine
in double precision, so what links is exact; what might be missed is a pair that meets in no table.

Equal vectors are one row from the start and are never expanded into pairs.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor
do vectors of different lengths; repeated rows are vectors of their own and link with each other; rows with a null id
link and are counted, but don't name a component unless all its ids are null; long vectors are held one by one, whole;
further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import checkpoint_dir, connected_components

COSINE = 0.95
#: Chosen so that a pair of cosine 0.95 meets in a table with probability 0.45 or more, in any of them with 0.999.
TABLES, BLOCKS, PROBES, SCALE, SEED = 12, 2, 8, 1.6, 8


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer components of even sum: round, and where the sum is odd, round the component that lost most the other way."""
    r = np.rint(x)
    lost = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    k = np.abs(lost[odd]).argmax(axis=1)
    r[odd, k] += np.where(lost[odd, k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: E8 is D8 and D8 moved by a half in each component."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two components of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = [(i, j, s, t) for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    found = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in zip(found, pairs, strict=True):
        row[i], row[j] = s, t
    halves = [signs for signs in product((0.5, -0.5), repeat=8) if np.prod(signs) > 0]
    return np.concatenate((found, np.array(halves)))


@lru_cache(maxsize=64)
def projection(table: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, length])
    return rng.standard_normal((length, 8 * BLOCKS)) / SCALE, rng.random(8 * BLOCKS)


@lru_cache(maxsize=1)
def digits() -> np.ndarray:
    """Odd random factors that turn a cell into a 64-bit key."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, 8 * BLOCKS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(points: np.ndarray, table: int, length: int) -> np.ndarray:
    """Keys of cells: an integer combination of doubled coordinates modulo 2 ** 64, mixed."""
    factors = digits()
    with np.errstate(over="ignore"):
        key = (np.rint(points * 2).astype(np.int64).view(np.uint64) * factors[:-2]).sum(axis=1, dtype=np.uint64)
        key += np.uint64(table) * factors[-1] + np.uint64(length) * factors[-2]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def cells(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """For each vector the key of its own cell, then those of its nearest neighbouring cells."""
    matrix, shift = projection(table, vectors.shape[1])
    x = vectors @ matrix + shift
    own = np.concatenate([nearest_e8(x[:, 8 * k : 8 * k + 8]) for k in range(BLOCKS)], axis=1)
    found = [keys(own, table, vectors.shape[1])]
    if probes:
        short, rest = shortest_vectors(), x - own
        away = np.concatenate([1 - rest[:, 8 * k : 8 * k + 8] @ short.T for k in range(BLOCKS)], axis=1)
        nearest = np.argpartition(away, probes, axis=1)[:, :probes]
        for q in range(probes):
            moved, block, v = own.copy(), nearest[:, q] // len(short), short[nearest[:, q] % len(short)]
            for k in range(BLOCKS):
                moved[:, 8 * k : 8 * k + 8] += np.where((block == k)[:, None], v, 0)
            found.append(keys(moved, table, vectors.shape[1]))
    return np.stack(found, axis=1)


def unit_rows(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors, for each length of vectors."""
    sizes = vectors.map(len)
    for _, places in sizes.groupby(sizes).indices.items():
        v = np.stack(vectors.iloc[places].to_numpy()).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        yield places, v / np.linalg.norm(v, axis=1, keepdims=True)


def in_cells(vectors: DataFrame, probes: int) -> DataFrame:
    """(node, key) for each table, and each neighbour looked into."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for places, v in unit_rows(rows["vector"]):
                nodes = rows["node"].to_numpy()[places]
                for t in range(TABLES):
                    found = cells(v, t, probes)
                    yield pd.DataFrame({"node": np.repeat(nodes, found.shape[1]), "key": found.ravel()})

    return vectors.select("node", "vector").mapInPandas(spread, "node long, key long")


def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    found = np.full(len(a), -2.0)
    same = (a.map(len) == b.map(len)).to_numpy()
    for n in a[same].map(len).unique():
        at = np.flatnonzero(same & (a.map(len) == n).to_numpy())
        x, y = (np.stack(s.iloc[at].to_numpy()).astype(np.float64) for s in (a, b))
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
        found[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return pd.Series(found, index=a.index)


def usable(vector: Column) -> Column:
    value = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: value(x) != 0), F.lit(False))


def vector_links(vectors: DataFrame, threshold: float = COSINE, probes: int = PROBES) -> DataFrame:
    """(a, b), a < b: the different vectors (columns node, vector) that meet and have at least the threshold's cosine."""
    stored = in_cells(vectors, 0).select(F.col("node").alias("b"), F.col("key").alias("stored_key"))
    met = in_cells(vectors, probes).join(stored, (F.col("key") == F.col("stored_key")) & (F.col("node") != F.col("b")))
    met = met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    one = vectors.select(F.col("node").alias("n1"), F.col("vector").alias("v1"))
    two = vectors.select(F.col("node").alias("n2"), F.col("vector").alias("v2"))
    beside = met.join(one, F.col("a") == F.col("n1")).join(two, F.col("b") == F.col("n2"))
    return beside.filter(F.pandas_udf(cosine, "double")("v1", "v2") >= threshold).select("a", "b")


def near_vectors(embeddings: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept (vec_id = component_id) of every row."""
    checkpoint_dir(embeddings.sparkSession)
    held = embeddings.select(F.col(id_column).alias("vec_id"), F.when(usable(F.col(vector_column)), F.col(vector_column)).alias("vector"))
    groups = held.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = groups.withColumn("node", F.monotonically_increasing_id()).checkpoint()  # ids stay as they are from here on
    links = vector_links(groups, threshold).checkpoint()
    sizes = groups.select(F.col("node").alias("s_node"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes, F.col("b") == F.col("s_node")).groupBy(F.col("a").alias("l_node")).agg(F.sum("copies").alias("others"))
    parts = connected_components(links).withColumnRenamed("node", "p_node")
    rooted = groups.join(parts, F.col("node") == F.col("p_node"), "left").join(linked, F.col("node") == F.col("l_node"), "left")
    rooted = rooted.select("vector", "least", "copies", "others", F.coalesce("component", "node").alias("root"))
    named = rooted.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("smallest"))
    told = rooted.join(named, F.col("root") == F.col("name")).select(F.col("vector").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "smallest")
    found = held.join(told, F.col("vector") == F.col("of"), "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


VECTORS_SQL = r"""
with recursive v as (
  select vec_id, [cast(x as double) for x in embedding] as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n from links group by a),
c as (select a, min(b) as component_id from reach group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on e.vec_id = c.a left join n on e.vec_id = n.a
"""
