import hashlib
import math
import random

import numpy as np
import pytest
from cases import twin
from pyspark.sql import functions as F

from shotline.llm import centroids
from shotline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int, h int"


def data(dims=64, seed=6, n=300):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [x + rng.gauss(0, rng.choice([0.02, 0.5])) for x in c]))
    out += [(1000 + i, list(out[3][1])) for i in range(30)]  # copies, ties
    out += [out[5], out[5], (None, out[7][1]), (None, None), (2000, None), (2001, [1.0] * (dims - 1)), (2002, [None] + [1.0] * (dims - 1))]
    out += [(2003, [float("nan")] + [1.0] * (dims - 1)), (2004, [float("-inf")] + [1.0] * (dims - 1)), (2005, []), (2006, [0.0] * dims)]
    return [(*r, "x", 1, 2) for r in out]


def brute(data, dims=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in seeds[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, b) in zip(kept, best) if b == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    best = assign()
    inertia = [sum(d for d, b in best if b == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(kept, best)), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(data(), SCHEMA).repartition(4)
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_centroid_clusters"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data())


def test_query_equals_sql(spark, tmp_path):
    rows = spark.createDataFrame(data(seed=9)[:300], SCHEMA)
    columns, want = twin("op13_centroid_clusters", tmp_path, embeddings=rows.toArrow())
    got = QUERIES["op13_centroid_clusters"](spark, str(tmp_path))
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("scale, k, rounds", [(1.0, 5, 6), (1e12, 3, 3), (1e-9, 4, 2), (1.0, 1, 2)])
def test_bounds_change_no_assignment(spark, scale, k, rounds):
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v]) for i, v, *_ in data(dims=6, n=150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = centroids.whole_vectors(df, dims=6)
    found = centroids.cluster(whole, centroids.first_centroids(whole, k), rounds)
    got = found.rows.select("vec_id", "cluster", "distance").collect()
    want = [(i, j, min(d, centroids.MOST)) for i, j, d, *_ in brute(rows, 6, k, rounds)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_most_vectors_are_not_scanned_again(spark):
    df = spark.createDataFrame(data(n=2000), SCHEMA)
    whole = centroids.whole_vectors(df)
    found = centroids.cluster(whole, centroids.first_centroids(whole), 6)
    scans = found.rows.agg(F.avg("scans")).first()[0]
    assert scans < 0.7 * 7


def test_no_point_of_a_sphere_comes_closer_than_the_bound():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(3000):
        dims = int(rng.integers(1, 6))
        c, start = rng.normal(0, 3, dims), rng.normal(0, 3, dims)
        end = start + rng.normal(0, rng.choice([0.01, 1, 5]), dims)
        radius = float(rng.choice([0, 0.1, 1, 4]))
        bound = centroids.shortening(c, radius, start, end)
        x = rng.normal(0, 1, (200, dims))
        x = c + radius * x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None] * rng.choice([1, 0.5], (200, 1))
        came = np.linalg.norm(x - start, axis=1) - np.linalg.norm(x - end, axis=1)
        assert came.max() <= bound + 1e-9
        less += bound < np.linalg.norm(end - start) * 0.9
    assert less > 1000


def test_few_and_no_vectors(spark):
    assert centroids.report(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(1, [0.5] * 64, "x", 1, 2), (2, [0.5] * 64, "x", 1, 2), (3, [-1.0] * 64, "x", 1, 2)]
    got = centroids.report(spark.createDataFrame(few, SCHEMA)).drop("scans")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(few)
