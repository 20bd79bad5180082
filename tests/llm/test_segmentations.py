import collections
import math

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillgraph.llm import segmentations as g


@pytest.fixture(scope="module")
def v():
    return g.load(g.MODEL)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=g.MODEL)


def enumerate_all(v, sp, text):
    """Every segmentation with its probability, by plain recursion over the pieces."""
    chars = ("▁" + text.replace(" ", "▁")) if text else ""
    ids = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}

    def walk(at):
        if at == len(chars):
            yield (), 0.0
            return
        options = [(chars[at:e], (ids[chars[at:e]],), v.score[ids[chars[at:e]]]) for e in range(at + 1, len(chars) + 1) if chars[at:e] in ids]
        if chars[at] not in ids:
            options.append((chars[at], tuple(int(v.byte_ids[b]) for b in chars[at].encode()), v.fallback))
        for piece, got, score in options:
            for rest, more in walk(at + len(piece)):
                yield got + rest, score + more

    every = list(walk(0))
    total = sum(math.exp(s) for _, s in every)
    return {i: math.exp(s) / total for i, s in every}


@pytest.mark.parametrize("text", ["the cat", "a  b\nc", "ab", "", "é日x", "1+1", "   "])
def test_all_segmentations_in_full(v, sp, text):
    want = enumerate_all(v, sp, text)
    rows = g.sample_texts(v, [text], np.array([9]), len(want) + 3)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(want) and len(rows) == len(want)
    for ids, logp, _, inclusion in rows:
        assert math.isclose(math.exp(logp), want[tuple(ids.tolist())], rel_tol=1e-9) and inclusion == 1
    values = [r[2] for r in rows]
    assert values == sorted(values, reverse=True) or not text


def test_draws_follow_the_law(v, sp):
    want = enumerate_all(v, sp, "then")
    n = 20_000
    seen = collections.Counter()
    second, horvitz = collections.Counter(), collections.Counter()
    for rows in g.sample_texts(v, ["then"] * n, np.arange(n), 2):
        a, b = (tuple(r[0].tolist()) for r in rows)
        seen[a] += 1
        second[b] += 1
        for i, r in zip((a, b), rows):
            horvitz[i] += math.exp(r[1]) / r[3] / n
    for i, p in want.items():
        assert abs(seen[i] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-4
        q = sum(o * p / (1 - o) for j, o in want.items() if j != i)
        assert abs(second[i] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-4
        # Inverse-inclusion weighting is without bias.
        assert abs(horvitz[i] - p) < 0.05


def test_states_hold_only_the_pieces_that_can_come(v, sp):
    text = "▁the▁queue▁é日x"
    codes = np.array([ord(c) for c in text])
    lat = g.build_lattice(v, codes, np.array([0, len(codes)]), 1.0)
    ids = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}
    want = 0
    for start, end in zip(lat.start, lat.end, strict=True):
        unit = "".join(chr(c) for c in lat.code[start:end])
        for at in range(len(unit)):
            there = [unit[at:e] for e in range(at + 1, len(unit) + 1) if unit[at:e] in ids]
            cells = slice(lat.first[start + at], lat.first[start + at + 1])
            assert [len(p) for p in there if len(p) > 1] == [n for n in lat.size[cells] if n > 1] and math.isclose(lat.share[cells].sum(), 1)
            if unit[at] in ids:
                assert [ids[p] for p in there] == lat.piece[cells].tolist()
            want += len(there) + (unit[at] not in ids)
    assert len(lat.share) == want and (lat.share > 0).all()


def test_rows_depend_on_key_and_text_alone(v, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    many = g.sample_texts(v, texts, np.arange(60), 3)
    for i in (0, 17, 59):
        one = g.sample_texts(v, [texts[i]], np.array([i]), 3)[0]
        for x, y in zip(one, many[i]):
            assert x[0].tolist() == y[0].tolist() and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-9)
    other = g.sample_texts(v, texts, np.arange(60) + 1000, 3)
    assert any(x[0][0].tolist() != y[0][0].tolist() for x, y in zip(many, other))


def test_samples_are_segmentations_and_decode(v, sp, spark, sf):
    rng = np.random.default_rng(2)
    alphabet = list("abthe ▁\n\té日\U0001f600.,09") + ["  ", "the ", "\x00"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text, rows in zip(texts, g.sample_texts(v, texts, np.arange(len(texts)), 3)):
        assert len({tuple(r[0].tolist()) for r in rows}) == len(rows) >= 1
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        for ids, _, _, inclusion in rows:
            assert g.decode_ids(v, ids, np.array([0, len(ids)])) == [text.encode()]
            assert sp.decode(ids.tolist()) == text.replace("\x00", "\x00") and 0 <= inclusion <= 1


def test_frames(spark):
    long = "word " * 60_000 + "x" * 3000
    rows = [(1, None), (1, ""), (None, "hello there"), (2, "hello there"), (2, "hello there"), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("ids", "rank", "_key", "log_prob", "lang")})
    got = g.sample_segmentations(docs)
    assert got.columns == ["doc_id", "_key", "lang", "rank", "ids", "log_prob", "perturbed", "inclusion"]
    back = g.decode(got).collect()
    texts = collections.defaultdict(set)
    for r in back:
        texts[r.doc_id].add(r.text)
    assert texts == {1: {""}, None: {"hello there"}, 2: {"hello there"}, 3: {long}}
    assert len([r for r in back if r.doc_id == 2]) == 4 and len([r for r in back if r.doc_id == 1]) == 2
    twice = [r.ids for r in got.where("doc_id = 2 and rank = 0").collect()]
    assert twice[0] == twice[1]
    assert g.sample_segmentations(docs.limit(0)).count() == 0
    assert g.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().text is None
