import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import merkle as m

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, fanout):
    """(root, [(left, right), ...] for each digest), by plain recursion over levels."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(places):
            run = digests[i // fanout * fanout :][:fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        digests = [H(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
        places = [i // fanout for i in places]
    return digests[0], paths


def brute(rows, fanout=8, tampered=lambda r: r):
    """Sorted (leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in groups[g]], fanout) for g in names]
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for g, (sub, paths), up in zip(names, trees, above, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            path, now = path + up, leaf_of(tampered(r))
            for left, right in path:
                now = H(left, now, right)
            out.append((leaf_of(r), sub, root, H(*[x for p in path for x in p]), now, now == root))
    return sorted(out)


def rows_of(df):
    return sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_documents_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    change = lambda r: (*r[:4], lower(r[4])) if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = rows_of(m.op11_merkle_manifest(spark, sf))
    assert got == brute(rows, 8, change) and {r[5] for r in got} == {True, False}


@pytest.mark.parametrize("fanout,langs", [(2, 3), (3, 70), (8, 1), (8, 70)])
def test_trees_of_any_shape(spark, fanout, langs):
    rows = [(i * i * 7919 - 4000, f"s{i}", f"l{i * i % langs}", i, "x" * (i % 5)) for i in range(150)]
    assert rows_of(m.verify(m.manifest(frame(spark, rows), fanout=fanout))) == brute(rows, fanout)


@pytest.mark.parametrize("most", [1 << 15, 3])
def test_hot_keys_and_equal_rows_are_opened_by_leaf_and_place(spark, monkeypatch, most):
    monkeypatch.setattr(m, "MOST", most)
    monkeypatch.setattr(m, "AIM", 16)
    rows = [(None, None, None, None, None)] * 9 + [(5, "a", "en", 1, f"t{i % 40}") for i in range(130)] + [(6, "a", "en", 1, "same")] * 60
    rows += [(None, "", "en", 0, f"{i}") for i in range(30)] + [(i, "b", "fr", None, "") for i in range(-70, 70)] + [(1 << 62, "b", "fr", 1, "-"), (-(1 << 63), "b", "fr", 1, None)]
    assert rows_of(m.verify(m.manifest(frame(spark, rows, 5)))) == brute(rows)


def test_ranks_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(m, "MOST", 4)
    rows = spark.createDataFrame([(g, k) for g in "ab" for k in ("", "0", "00", "01", "0A", "1", "ABCDEF", "ABCDEFA", "ABCDEFB", "ABCDEFBB", *[f"ABCD{i:05}" for i in range(90)])], "g string, k string")
    got = m.radix_ranks(rows.withColumn("k", F.concat("k", F.lit("!"))), F.col("k"), 2).collect()
    for g in "ab":
        mine = sorted((r["rank"], r.k) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(100)) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert {r.total for r in got} == {100}


def test_changed_missing_and_moved_rows_are_found(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(100)]
    docs = frame(spark, rows)
    changed = m.manifest(docs, claims={"n_chars": F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.col("n_chars")), "lang": F.when(F.col("doc_id") == 50, F.lit("de")).otherwise(F.col("lang"))})
    assert {r.doc_id for r in m.verify(changed).where("not verified").collect()} == {7, 50}
    root = lambda d: m.manifest(d).first().root
    assert len({root(docs), root(docs.where("doc_id <> 99")), root(frame(spark, [*rows, (100, None, "en", None, None)]))}) == 3
    assert root(docs) == root(frame(spark, rows[::-1], 7))


def test_odd_frames(spark):
    rows = [(1, None, "en", None, "é" * 70_000), (2, "-", "", 0, "")]
    docs = frame(spark, rows).withColumns({c: F.lit(-1) for c in ("g", "id", "leaf", "p", "idx", "rank", "total", "path", "file", "at", "c0", "root", "row")})
    assert rows_of(m.verify(m.manifest(docs))) == brute(rows)
    assert rows_of(m.verify(m.manifest(frame(spark, rows[:1])))) == brute(rows[:1])
    none = m.verify(m.manifest(docs.limit(0)))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_text_keys_sort_by_bytes(spark):
    names = ["b", "a", "ab", "", "é", "Z", "a" * 40, "a" * 41]
    docs = spark.createDataFrame([(n,) for n in names], "name string").withColumn("part", F.lit(1))
    got = {r.name: r for r in m.verify(m.manifest(docs, "name", "part", ("name",), 2), "name").collect()}
    root, paths = tree([leaf_of([n]) for n in sorted(names, key=str.encode)], 2)
    assert {r.root for r in got.values()} == {root}
    for n, path in zip(sorted(names, key=str.encode), paths, strict=True):
        assert got[n].proof_sha256 == H(*[x for p in path for x in p]) and got[n].verified
