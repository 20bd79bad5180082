import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import substrings


def brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for (k, _), ws in zip(rows, texts):
        gone = {p for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for p in range(i, i + window)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((k, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def result(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "k1", "at", "key", "n_words", "gone")})
    texts = {r: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for r, t in rows}
    got = substrings.remove_repeats(docs, window=window).collect()
    for r in got:
        kept = r.kept_text if r.kept_text is not None else texts.get(r.doc_id) if r.n_removed == 0 else None
        if kept is not None and r.doc_id is not None:
            assert hashlib.sha256(kept.encode()).hexdigest() == r.kept_sha256 or r.n_removed == 0
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("period", substrings.COVERS)
def test_covers_meet_every_shift(period):
    residues = substrings.COVERS[period]
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in residues and (j + k) % period in residues for k in range(period))


@pytest.mark.parametrize("window", [1, 3, 14, 35, 50])
def test_matches_brute_force(spark, window):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(40)] + ["é", "ñandú", "日本"]
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(6)]
    rows = []
    for k in range(60):
        ws = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            ws += p[a : a + rng.randint(1, 90)] if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(ws)))
    assert result(spark, rows, window) == [r[:4] for r in brute(rows, window)]


def test_odd_rows(spark):
    once = " ".join(f"a{i}" for i in range(40))
    loop = " ".join(["x"] * 80)
    long = " ".join(f"z{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, once), (4, once), (None, "q " + once[3:]), (6, loop), (7, long), (8, long + " tail"), (9, once.replace(" ", "\x0b")), (10, once.replace(" ", " "))]
    assert result(spark, rows, 35) == [r[:4] for r in brute(rows, 35)]
    assert result(spark, [], 35) == []
