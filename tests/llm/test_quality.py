import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quality


def test_places_are_distinct_and_depend_on_the_text_alone():
    texts = ["Ab ab ab cd.", None, "", "x", "é ü é ü", "w w w", "w w", "Ab ab ab cd.", "a" * 5000]
    whole = [p.tolist() for p in quality.features(pa.array(texts))]
    single = [p.tolist() for t in texts for p in quality.features(pa.array([t], pa.string()))]
    assert whole == single and len(whole) == len(texts)
    assert all(len(p) == len(set(p)) for p in whole)
    assert whole[1] == whole[2] == whole[3] == [] and whole[0] == whole[7]
    # 3-grams, 4-grams and pairs of a text without repeats: 10 + 9 + 3.
    assert len(next(quality.features(pa.array(["abc def ghi."])))) == 10 + 9 + 2
    assert len(whole[5]) == 2 + 2 + 1 and len(whole[6]) == 1 + 1


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(120)]
    signs = np.where([3 in r or (5 in r and rng.random() < 0.8) for r in rows], 1.0, -1.0)
    ratios = rng.normal(size=30)
    w, b = quality.dual_descent(rows, signs, ratios, rounds=3000, tolerance=1e-7)
    x = np.zeros((120, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.sqrt(len(r))
    x[:, 30] = 1
    full = np.append(w, b)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - signs * (x @ v)).sum()
    best = loss(full)
    for _ in range(400):
        assert loss(full + rng.normal(size=31) * 10.0 ** rng.uniform(-5, 0)) >= best - 1e-6


def test_ratios_count_all_rows(spark):
    rows = [(i, "good text" if i % 3 else "bad one", int(i % 3 > 0)) for i in range(30)]
    model = quality.fit(spark.createDataFrame(rows, "key long, text string, label int"))
    good, bad = (model.score(next(quality.features(pa.array([t])))) for t in ("good text", "bad one"))
    assert good > 0.5 > bad
    none = quality.fit(spark.createDataFrame(rows[:0], "key long, text string, label int"))
    assert none.score(np.zeros(0, np.int32)) == 0.5
    one = quality.fit(spark.createDataFrame([(1, None, 1), (None, "", 1), (3, "x", None), (4, "y", 7)], "key long, text string, label int"))
    assert 0.5 < one.score(np.zeros(0, np.int32)) < 1


def test_odd_rows_and_clashes(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b c"), (2, "z" * 200_000)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "label", "places", "t x")})
    model = quality.Model(np.ones(1 << quality.BITS, np.float32), 0.25, 1.0, 0.0)
    got = quality.score(docs, model)
    assert set(got.columns) == set(docs.columns)
    assert sorted(round(r.score, 3) for r in got.collect())[:2] == [0.562, 0.562]
    assert quality.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    right = np.mean([got[k].predicted == q for k, q in labels])
    pos, neg = ([got[k].score for k, q in labels if q == x] for x in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert right > 0.9 and auc > 0.95, (right, auc)
    assert got.keys() == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_documents(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def plain_features(text, bits=quality.BITS):
    """Places by loops over bytes and words: 3-grams, 4-grams, word pairs; of equal ones the last stays."""
    data, low = (text or "").encode(), 32 - bits
    out = [(int.from_bytes(data[i : i + 3]) * 0x9E3779B1 & 0xFFFFFFFF) >> low for i in range(len(data) - 2)]
    for i in range(len(data) - 3):
        four = int.from_bytes(data[i : i + 4])
        out.append(((four ^ (four >> 15)) * 0x85EBCA6B & 0xFFFFFFFF) >> low)
    codes = [int(quality.word_hashes(next(quality.words(pa.array([w.decode()]))))[0]) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    for a, b in zip(codes, codes[1:], strict=False):
        x = np.array([(a * 3 + b) & (1 << 64) - 1], np.uint64)
        out.append(int(quality.mix(x)[0]) >> (64 - bits))
    return list(dict.fromkeys(reversed(out)))[::-1]


def test_whole_query_against_plain_python(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 3000}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 3000)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    places = {k: plain_features(t) for k, t in texts.items()}
    train = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    counts = np.zeros((2, 1 << quality.BITS))
    for k, q in train:
        counts[q][places[k]] += 1
    ratios = np.log((counts[1] + 1) / (counts[1] + 1).sum()) - np.log((counts[0] + 1) / (counts[0] + 1).sum())
    hashed = spark.createDataFrame([(q, places[k]) for k, q in train], "q int, places array<int>").select("q", "places", F.xxhash64("places").alias("h")).collect()
    rows = sorted(hashed, key=lambda r: (r.h, r.q))
    sets, marks = [np.array(r.places, np.int32) for r in rows], np.array([float(r.q) for r in rows])
    margin = lambda w, b, p: b + float((w * ratios)[p].sum()) / np.sqrt(max(1, len(p)))
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % quality.FOLDS
    for k in range(quality.FOLDS):
        inside = np.flatnonzero(fold != k)
        w, b = quality.dual_descent([sets[i] for i in inside], 2 * marks[inside] - 1, ratios)
        margins[fold == k] = [margin(w, b, sets[i]) for i in np.flatnonzero(fold == k)]
    slope, offset = quality._platt(margins, marks)
    w, b = quality.dual_descent(sets, 2 * marks - 1, ratios)
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), quality.fit_documents(docs, labels)).collect()}
    assert got.keys() == texts.keys() and len(train) > 30
    for k, p in places.items():
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(slope * margin(w, b, np.array(p, np.int64)) + offset))), abs=1e-3), k


def test_sieve_loses_no_key(spark):
    keys = spark.range(0, 5000).select(quality.key_hash(F.col("id")).alias("h"))
    sieve = quality.Sieve.over(keys, F.col("h"))
    hashes = np.array([r.h for r in spark.range(0, 50_000).select(quality.key_hash(F.col("id")).alias("h")).collect()])
    passed = sieve.passes(hashes)
    assert passed[:5000].all() and passed[5000:].mean() < 0.05
    assert not quality.Sieve.over(keys.limit(0), F.col("h")).passes(hashes).any()


def test_keys_of_many_rows_and_other_types(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} {'bad' if i % 2 else 'good'}") for i in range(40)], "doc_id int, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (None, 1), (2, 1), (3, 0), (3, None)], "doc_id long, quality long")
    model = quality.fit_documents(docs, labels)
    kept = [(i % 4, i % 2) for i in range(40) if zlib.crc32(str(i % 4).encode()) % 3 != 1]
    assert kept and np.abs(model.weights).sum() > 0
    assert model.score(next(quality.features(pa.array(["text 7 bad"])))) < model.score(next(quality.features(pa.array(["text 7 good"]))))
