"""Exact k-means against plain Python integers, and against SQL."""

import hashlib
import math
import os

import numpy as np
import pandas as pd
import pytest

from cadenza.llm import centroids
from tests.llm.conftest import by_sql, same_rows

SF = "/root/testdata/sf0.001"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """The contract, one number after the other."""
    kept = [(i, [math.floor(scale * float(x)) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [v for i, v in sorted(kept, key=lambda r: (*code(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, own)), j) for j, own in enumerate(c))
    for _ in range(rounds):
        told = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            if own := [v for (_, v), t in zip(kept, told) if t == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    told = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, t in told if t == j) for j in range(len(c))]
    fits = lambda x: x if x < 2**63 else None
    return [(i, t, fits(d), fits(sums[t]), fits(sum(sums)), hashlib.sha256(",".join(map(str, c[t])).encode()).hexdigest()) for i, d, t in told]


def as_rows(df):
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    return sorted((tuple(r) for r in df.collect()), key=key)


def vectors(n=300, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 2, (9, 64))
    rows = [(int(i), (middles[i % 9] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(n)]
    return [*rows, (7, rows[0][1]), (None, rows[1][1]), ((1 << 53) + 1, [0.0] * 64), ((1 << 53) + 3, [0.0] * 64)]


ODD = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_plain_integers(spark, kind):
    rows = [*vectors(), *ODD]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string").repartition(5)
    assert as_rows(centroids.clusters(df)) == sorted(plain(rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.mark.parametrize("size", [1e5, 1e8, 1e12, 1e200, 1.7e308])
def test_large_components_are_compared_in_integers(spark, size):
    rng = np.random.default_rng(1)
    rows = [*vectors(60), *[(500 + i, (rng.normal(0, 0.1, 64).clip(-1, 1) * size).tolist()) for i in range(8)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert as_rows(centroids.clusters(df, k=5)) == sorted(plain(rows, k=5), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_the_bound_of_the_matrix_product():
    """Just below the bound the product is exact, beyond it other integers take over; all give the same."""
    rng = np.random.default_rng(2)
    for bits in (10, 20, 23, 24, 28, 31, 40, 70):
        x = np.floor(rng.uniform(-1, 1, (50, 64)) * 2.0**bits)
        c = [[int(v) for v in row] for row in np.floor(rng.uniform(-1, 1, (6, 64)) * 2.0**bits)]
        told = {int(r): (int(t), int(d)) for part, _, labels, away in centroids.nearest(x, c, 1) for r, t, d in zip(part, labels, away)}
        for r, v in enumerate(x):
            d, t = min((sum((int(a) - b) ** 2 for a, b in zip(v, own)), j) for j, own in enumerate(c))
            assert told[r] == (t, d)


def test_ties_few_and_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    df = spark.createDataFrame(same, "vec_id long, embedding array<float>")
    found = as_rows(centroids.clusters(df))
    assert {r[1] for r in found} == {0} and len(found) == 40 and found == sorted(plain(same))
    few = spark.createDataFrame([(1, [0.0] * 64), (2, [9.0] * 64)], "vec_id long, embedding array<float>")
    assert {r[1] for r in as_rows(centroids.clusters(few))} == {0, 1}
    assert centroids.clusters(df.limit(0)).count() == 0
    assert centroids.clusters(spark.createDataFrame(ODD, "vec_id long, embedding array<float>")).count() == 0
    text = spark.createDataFrame([("a", [0.0] * 64), ("b", [9.0] * 64)], "vec_id string, embedding array<float>")
    assert [r[0] for r in as_rows(centroids.clusters(text))] == ["a", "b"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_clusters_equal_sql(spark):
    table = f"{SF}/embeddings.parquet"
    same_rows(centroids.clusters(spark.read.parquet(table)), by_sql(centroids.CLUSTERS_SQL, embeddings=pd.read_parquet(table)))
