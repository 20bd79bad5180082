import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(rows, radius=4):
    prints = [(k, brute_fingerprint(t)) for k, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
            x, y = root[a], root[b]
            if x != y:
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[root[i]] = min(k, least.get(root[i], k))
    return sorted(((k, f, least.get(root[i])) for i, (k, f) in enumerate(prints)), key=str)


def test_every_pair_in_the_radius_shares_a_mask():
    masks = simhash.covering_masks(3, bits=16)
    assert len(masks) == 15
    for size in range(4):
        for places in itertools.combinations(range(16), size):
            apart = sum(1 << p for p in places)
            assert any(apart & m == 0 for m in masks)
    rng = np.random.default_rng(3)
    masks = simhash.covering_masks()
    for _ in range(5000):
        apart = sum(1 << int(p) for p in rng.choice(64, 4, replace=False))
        assert any(apart & m == 0 for m in masks)


@pytest.mark.parametrize("block", [1 << 16, 2])
def test_classes_match_brute_force(spark, sf, block):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert sorted(((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component) for r in got.collect()), key=str) == brute_classes(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "a b"), (8, "A  B"), (7, "é ü"), (7, "é ü"), (None, "x y z w v"), (1, long), (2, long + " end"), (6, "one\x0btwo three\x0cfour five"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("component", F.lit(1))
    got = simhash.near_duplicate_classes(docs)
    assert got.columns == ["doc_id", "fingerprint", "component"]
    assert sorted(((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component) for r in got.collect()), key=str) == brute_classes(rows)
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0


def test_spanning_links_keep_chains():
    far = 0xFFFF << 48
    points = np.array([0, 0b1111, 0b11111111, far, far | 1], np.uint64)
    ends, heads = simhash._spanning_links(points, 4)
    assert sorted(zip(np.concatenate(ends).tolist(), np.concatenate(heads).tolist())) == [(15, 0), (255, 0), (far | 1, far)]


def brute_wide(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    out = []
    for h in (hashes, simhash.mix(hashes + np.uint64(1))):
        out.append(sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h) > len(h)))
    return tuple(out)


def groups_of(pairs):
    by = {}
    for k, c in pairs:
        by.setdefault(c, []).append(k)
    return sorted(sorted(g) for g in by.values())


def test_part_masks_cover_the_radius():
    masks = simhash.part_masks(11, 2)
    assert len(masks) == 2 * 63
    rng = np.random.default_rng(3)
    for _ in range(5000):
        apart = sum(1 << int(p) for p in rng.choice(64, 11, replace=False))
        assert any(apart & m == 0 for m in masks)


@pytest.mark.parametrize("block", [1 << 16, 64])
def test_wide_classes_match_brute_force(spark, sf, block):
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"w{x}" for x in rng.integers(0, 5000, 150)).split()
    for i in range(900):
        # One large group of near copies, each with a few words replaced; some are too far from all others.
        words = list(base)
        for at in rng.choice(len(words), 1 + i % 9, replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    prints = {k: brute_wide(t, 5) for k, t in rows}
    keys = sorted(prints)
    a, b = (np.array([prints[k][i] for k in keys], np.uint64) for i in (0, 1))
    root = np.arange(len(keys))
    for i in range(len(keys)):
        d = np.bitwise_count(a ^ a[i])
        near = (d <= 11) & (d.astype(int) + np.bitwise_count(b ^ b[i]) <= 23)
        roots = np.unique(root[near])
        root[np.isin(root, roots)] = roots.min()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicate_classes(docs, width=5, radius=11, parts=2, wide=23, block=block).collect()
    assert groups_of((r.doc_id, r.component) for r in got) == groups_of(zip(keys, root.tolist(), strict=True))
    least = {c: min(k for k, x in zip(keys, root.tolist(), strict=True) if x == c) for c in root.tolist()}
    assert all(r.component == least[root[keys.index(r.doc_id)]] for r in got)


@pytest.mark.parametrize("size", [5, 8, 9, 300, 700])
def test_bucket_links_span_what_is_near(size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    flips = lambda n: np.array([sum(1 << int(p) for p in rng.choice(64, n, replace=False)) for _ in range(size)], np.uint64)
    a, b, key = centre[0] ^ flips(5), centre[1] ^ flips(6), np.sort(rng.integers(0, 2, size))
    one, other = simhash._bucket_links(key, a, b, 9, 20)
    near = [[simhash._pairs_near(a[i], b[i], a[j], b[j], 9, 20) and key[i] == key[j] for j in range(size)] for i in range(size)]

    def parts(links):
        root = list(range(size))
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for i, j in links:
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(x) for x in range(size)]

    assert parts(zip(one.tolist(), other.tolist(), strict=True)) == parts((i, j) for i in range(size) for j in range(i) if near[i][j])


def test_wide_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, "a b"), (8, "A  B"), (7, "é ü"), (None, "x y z w v"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "b", "fp", "k")})
    got = simhash.near_duplicate_classes(docs, width=5, radius=11, parts=2, wide=23)
    assert sorted((r.doc_id or 0, r.component or 0) for r in got.collect()) == [(0, 0), (0, 4), (4, 4), (5, 4), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicate_classes(docs.limit(0), width=5, radius=11, parts=2, wide=23).count() == 0


def test_forest_keeps_groups():
    rng = np.random.default_rng(5)
    ends = rng.integers(0, 60, (4, 150)) // np.array([[1], [30], [1], [30]])
    batch = pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["ua", "ub", "va", "vb"])
    got = pa.Table.from_batches(simhash._forest(iter([batch[:70], batch[70:]]))).to_pydict()

    def groups(links):
        root = {}
        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x
        for x, y in links:
            root[max(find(x), find(y))] = min(find(x), find(y))
        return {x: find(x) for x in list(root) if True}

    before = groups(((a, b), (c, d)) for a, b, c, d in ends.T.tolist())
    after = groups(((a, b), (c, d)) for a, b, c, d in zip(*(got[c] for c in ("ua", "ub", "va", "vb")), strict=True))
    assert len(got["ua"]) < 150 and all(after.get(x, x) == r for x, r in before.items())
    assert list(simhash._forest(iter([]))) == []


def test_keys_of_all_masks_are_not_broadcast(spark):
    """A row becomes 31, which Spark's estimate leaves out: it would send all of them to the driver."""
    points = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.near_links(points)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("radius, bits", [(4, 64), (5, 32), (3, 16), (2, 64)])
def test_masks_keep_half_of_the_positions(radius, bits):
    """A mask of few positions has few keys, whose buckets grow with the table: work would grow with its square."""
    masks = simhash.covering_masks(radius, bits)
    assert min(m.bit_count() for m in masks) >= bits // 2
