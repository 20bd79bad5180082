import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate as d


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(text, items, stretch=13, similarity=0.8):
    """Words of the text in windows that are alike a window of an item, by item: no seeds, all diagonals."""
    out, ws = {}, tokens(text)
    for i, t in items:
        it = tokens(t)
        width = min(stretch, len(it))
        if len(it) < 5:
            continue
        need = width if len(it) < stretch else -(-int(similarity * 100) * width // 100)
        for a in range(len(ws) - width + 1):
            for b in range(len(it) - width + 1):
                if sum(x == y for x, y in zip(ws[a : a + width], it[b : b + width])) >= need:
                    hit = [a + k for k in range(width) if ws[a + k] == it[b + k]]
                    out.setdefault(i, set()).update(range(hit[0], hit[-1] + 1))
    return out


def got(text, index):
    out = {}
    for m in next(d.search(pa.array([text], pa.string()), index)):
        out.setdefault(m["item_id"], set()).update(range(m["first_word"], m["last_word"] + 1))
    return out


def test_masks_meet_every_stretch():
    for k in range(3):
        for bad in itertools.combinations(range(d.STRETCH), k):
            assert any(not {o + p for p in m} & set(bad) for m in d.MASKS for o in range(d.STRETCH - m[-1]))


def test_search_matches_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ñu"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([40, 13, 14, 12, 5, 4, 1, 60, 25, 0])]
    items.append((0, items[7][1]))
    index = d.build_index(items)
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            ws = rng.choice(items)[1].split()
            a = rng.randrange(len(ws) + 1)
            ws = [w if rng.random() > 0.12 else "changed" for w in ws[a : a + rng.randint(0, 60)]]
            text += [w.upper() + "!!" if rng.random() < 0.3 else w for w in ws] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        text = rng.choice([" ", ", ", "\n"]).join(text)
        want = brute(text, items)
        have = got(text, index)
        assert want.keys() == have.keys()
        for k in want:
            assert want[k] <= have[k]


@pytest.mark.parametrize("block_words", [1 << 18, 700])
def test_documents(spark, sf, block_words):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    grams = {}
    for i, t in items:
        ws = tokens(t)
        for k in range(len(ws) - 3):
            grams.setdefault(tuple(ws[k : k + 4]), set()).add(i)
    want = set()
    for r in docs.collect():
        ws = tokens(r.text)
        near = set().union(*(grams.get(tuple(ws[k : k + 4]), ()) for k in range(len(ws) - 3))) if ws else set()
        want |= {(r.doc_id, i) for i in brute(r.text, [x for x in items if x[0] in near])}
    found = d.find_benchmark_passages(docs, bench, block_words=block_words).select("doc_id", F.inline("matches")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and want


def test_odd_rows(spark):
    long = "x y " * 100_000
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, item), (4, long + item), (5, item), (5, item)], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("matches", "item_id", "k1", "m", "t")})
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, ""), (10, "q1 q2")], "item_id long, text string").withColumn("i", F.lit(3))
    for block_words in (1 << 18, 8):
        rows = d.find_benchmark_passages(docs, bench, block_words=block_words)
        assert set(rows.columns) == set(docs.columns)
        by = sorted(((r.doc_id or 0, len(r.matches)) for r in rows.collect()))
        assert by == [(0, 3), (1, 0), (1, 0), (2, 0), (4, 3), (5, 3), (5, 3)]
        assert d.find_benchmark_passages(docs.limit(0), bench, block_words=block_words).count() == 0
    assert d.find_benchmark_passages(docs, bench.limit(0)).where("size(matches) > 0").count() == 0


@pytest.mark.parametrize("block_words", [1 << 18, 8])
def test_ids_of_any_type(spark, block_words):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([("b-1", item), ("", item), (None, item)], "item_id string, text string")
    rows = d.find_benchmark_passages(spark.createDataFrame([(1, item), (2, "clean")], "doc_id long, text string"), bench, block_words=block_words).collect()
    assert {r.doc_id: [m.item_id for m in r.matches] for r in rows} == {1: ["", "b-1", None], 2: []}
