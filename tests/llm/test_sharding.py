import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import sharding as s
from quillgraph.session import stage


def test_matrix_has_the_sums_and_the_law():
    sources, targets = np.array([5, 0, 3, 2]), np.array([4, 3, 3])
    rng = np.random.default_rng(0)
    drawn, permuted = np.zeros((4, 3)), np.zeros((4, 3))
    squares = np.zeros((2, 4, 3))
    n = 4000
    for k in range(n):
        m = s.communication_matrix(sources, targets, k)
        assert (m.sum(axis=1) == sources).all() and (m.sum(axis=0) == targets).all()
        shuffled = rng.permutation(np.repeat(np.arange(3), targets))
        p = np.array([np.bincount(x, minlength=3) for x in np.split(shuffled, np.cumsum(sources)[:-1])])
        drawn += m / n
        permuted += p / n
        squares[0] += m**2 / n
        squares[1] += p**2 / n
    assert np.abs(drawn - permuted).max() < 0.1 and np.abs(squares[0] - squares[1]).max() < 0.35


def rows_of(df):
    return sorted((r.shard, r.slot, r.doc_id) for r in df.collect())


@pytest.mark.parametrize("good,bad,sample", [(2_000_000_000, 3_000_000_000, 4000), (40, 5_000_000_000, 2_500_000_000), (5_000_000_000, 40, 2_500_000_000), (3_000_000_000, 1_000_000_000, 3_900_000_000)])
def test_draws_from_more_than_numpy_takes(good, bad, sample):
    rng = np.random.default_rng(3)
    x = np.array([s._hypergeometric(rng, good, bad, sample) for _ in range(3000)], float)
    n = good + bad
    mean, deviation = sample * good / n, np.sqrt(sample * (good / n) * (bad / n) * (n - sample) / (n - 1))
    assert abs(x.mean() - mean) < 5 * deviation / np.sqrt(3000) and abs(x.std() / deviation - 1) < 0.07
    assert x.max() <= min(good, sample) and x.min() >= max(0, sample - bad)
    huge = s.communication_matrix(np.array([2_000_000_000, 700_000_000]), np.array([1_700_000_000, 1_000_000_000]), 1)
    assert huge.sum(axis=1).tolist() == [2_000_000_000, 700_000_000] and huge.sum(axis=0).tolist() == [1_700_000_000, 1_000_000_000]


@pytest.mark.parametrize("block,bucket,group", [(1 << 16, 1 << 14, 1024), (37, 3, 2)])
def test_shards_are_exact_and_slots_without_gaps(spark, sf, block, bucket, group):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows_of(s.shuffle_into_shards(docs, 24, 5, block, bucket, group))
    by = collections.defaultdict(list)
    for shard, slot, _ in got:
        by[shard].append(slot)
    n = docs.count()
    assert sorted(len(v) for v in by.values()) == sorted(s.shard_sizes(n, 24).tolist())
    assert all(v == list(range(len(v))) for v in by.values())
    assert sorted(k for *_, k in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert got == rows_of(s.shuffle_into_shards(docs, 24, 5, block, bucket, group))
    assert got != rows_of(s.shuffle_into_shards(docs, 24, 6, block, bucket, group))


def test_split_of_the_scan_changes_nothing(spark):
    kept = stage(spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 200).alias("text")))
    one = rows_of(s.shuffle_into_shards(kept, 7, 1, 100, 50))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert one == rows_of(s.shuffle_into_shards(kept, 7, 1, 100, 50))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_every_row_may_go_anywhere(spark):
    kept = stage(spark.range(0, 12, 1, 3).select(F.col("id").alias("doc_id")))
    seen = np.zeros((12, 12))
    for seed in range(60):
        for shard, slot, k in rows_of(s.shuffle_into_shards(kept, 3, seed, 2, 2)):
            seen[k, shard * 4 + slot] += 1
    # 60 draws of 12 places: five each, within five deviations.
    assert abs(seen - 5).max() < 5 * np.sqrt(5) and (seen.sum(axis=0) == 60).all()


def test_odd_frames(spark):
    rows = [(1, None), (1, None), (None, ""), (3, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("shard", "slot", "file", "at", "c0", "start", "bucket")})
    got = s.shuffle_into_shards(docs, 24)
    assert sorted(got.columns) == sorted(docs.columns)
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert s.shuffle_into_shards(docs.limit(0), 24).count() == 0
    kept = stage(spark.range(100).select(F.col("id").alias("doc_id")))
    some = s.shuffle_into_shards(kept.where("doc_id % 3 = 0"), 4)
    assert sorted(r.doc_id for r in some.collect()) == list(range(0, 100, 3))
    assert sorted(r["count"] for r in some.groupBy("shard").count().collect()) == [8, 8, 9, 9]
