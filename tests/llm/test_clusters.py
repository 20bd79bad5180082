import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import clusters as c


def brute(rows, dimension, k, rounds, seed=1, scale=64):
    """Plain Python over (id, vector) rows."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", q) for i, q in kept)
    cents = [q for *_, q in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda q: min((far(q, m), j) for j, m in enumerate(cents))
    for _ in range(rounds):
        own = [pick(q)[1] for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *pick(q)) for i, q in kept]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found), key=str)


def rows_of(df, key="vec_id"):
    return sorted(((r[key], r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def test_given_vectors_against_plain_python(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    given = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    assert rows_of(c.op12_centroid_clusters(spark, sf)) == brute(given, 64, 16, 3)


@pytest.mark.parametrize("segments", [1, 2, 4])
def test_small_integers_with_many_ties(spark, segments):
    rng = np.random.default_rng(2)
    given = [(int(i), (rng.integers(-2, 3, 4) / 2).tolist()) for i in rng.integers(0, 300, 400)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>").repartition(7)
    got = c.cluster_vectors(df, dimension=4, scale=2, clusters=5, rounds=4, segments=segments)
    assert rows_of(got) == brute(given, 4, 5, 4, scale=2)


def test_screening_spares_distances_and_changes_none():
    rng = np.random.default_rng(0)
    cents = c.Centroids(rng.integers(-200, 200, (16, 64)) * np.arange(1, 17)[:, None])
    q = (cents.rows[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))).astype(np.int64)
    squares = (q * q).reshape(len(q), 16, -1).sum(axis=2)
    best, distance, computed = cents.nearest(q, squares)
    every = ((q[:, None, :] - cents.rows[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed.mean() < 4
    large = rng.integers(-c.MOST + 1, c.MOST, (50, 64))
    cents = c.Centroids(large[:8])
    best, distance, _ = cents.nearest(large, (large * large).reshape(50, 16, -1).sum(axis=2))
    exact = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in large[:8]] for a in large]
    assert distance.tolist() == [min(x) for x in exact] and best.tolist() == [x.index(min(x)) for x in exact]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.5, -0.01]), (1, [0.5, -0.01]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (None, [9.5, 9.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumns({n: F.lit(-1) for n in ("id", "q", "cluster", "distance", "squares")})
    assert rows_of(c.cluster_vectors(df, dimension=2, clusters=3, segments=1)) == brute(given, 2, 3, 3)
    assert rows_of(c.cluster_vectors(df, dimension=2, clusters=9, segments=2)) == brute(given, 2, 9, 3)
    none = c.cluster_vectors(df.limit(0))
    assert none.count() == 0 and none.columns == c.cluster_vectors(df, dimension=2, segments=1).columns
    with pytest.raises(Exception, match="component"):
        c.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimension=2, segments=1)
    with pytest.raises(ValueError):
        c.compress(df, segments=7)


def test_partitions_change_nothing(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert rows_of(c.cluster_vectors(vectors.repartition(1))) == rows_of(c.cluster_vectors(vectors.repartition(13)))
