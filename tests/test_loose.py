"""Loose JSON, keyed noise and resumable embedding."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import loose_json as lj, noise
from quillgraph.operators import reembed as re, store as st

PEOPLE = [{"given": "Ann", "family": "Lee"}, "Bo Kim", 3, None, {"family": "Ray", "literal": "The Rays"}, {"literal": "A Group"}, {"given": " "}, ["x"], {"given": 5, "family": "Orr"}, {"given": "Ann", "family": "Lee"}]
CASES = [
    ({"title": " A ", "date": "c. 2001", "DOI": "10.1/x.;", "author": PEOPLE}, ("A", 2001, "10.1/x", ["Ann Lee", "Bo Kim", "Ray", "A Group", "Orr"], ["lee", "kim", "ray", "group", "orr"])),
    ({"title": ["", 4, "B"], "year": ["x", "1999"], "date": 2005, "note": "doi 10.1234/ab.c, end"}, ("B", 1999, "10.1234/ab.c", [], [])),
    ({"title": {"a": 1}, "container-title": None, "note": "N", "author": "Lee"}, ("N", None, None, [], [])),
    ({}, ("", None, None, [], [])),
    ({"doi": ["", " 10.5/Y "], "title": True}, ("", None, "10.5/Y", [], [])),
]


def test_entries_of_every_shape(spark):
    texts = [json.dumps(c) for c, _ in CASES] + ["[1]", "3", '"x"', "null", "bad{", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", lj.entry_fields(F.col("j")).alias("f"), lj.render_reference(F.col("j")).alias("r")).orderBy("i").collect()
    assert [tuple(r.f) if r.f else None for r in rows] == [w for _, w in CASES] + [None] * 7
    assert [r.r for r in rows[5:]] == [None] * 7


def test_rendering(spark):
    cases = [
        ({"author": PEOPLE, "issued": {"date-parts": [["1987", 5]]}, "title": " The  towns. ", "container-title": "Journal", "volume": 4, "issue": None, "page": "1-9", "DOI": "https://doi.org/10.1/X"}, "Lee, Ann; Bo Kim; The Rays; A Group; Orr; Lee, Ann. 1987. The towns.. Journal. 4. 1-9. 10.1/x."),
        ({"editor": [{"family": "Kim"}], "issued": {"raw": "in press"}, "title": "T"}, "Kim. in press. T."),
        ({"author": "Lee", "editor": ["Ray"], "issued": "1999"}, "Ray."),
        ({}, "."),
    ]
    got = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string").select("i", lj.render_reference(F.col("j")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [w for _, w in cases]


def draw(key, seed, counter, n):
    return int(hashlib.md5(f"{seed}:{key}:{counter}".encode()).hexdigest()[:8], 16) % n


def wrapped(text, width):
    if len(text) < width + 10:
        return text
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = "    " + w
        else:
            line = f"{line} {w}" if line else w
    return "\n".join([*lines, line])


def test_noise_depends_on_keys_alone(spark):
    refs = [[f"Reference {i} of row {k} " + "word " * ((i * 7 + k) % 40) + "x" * (k % 3 * 60) for i in range(k % 5 + 1)] for k in range(120)]
    df = spark.createDataFrame(list(enumerate(refs)), "k int, refs array<string>")
    block = noise.reference_block(F.col("refs"), F.col("k"), 3, noise=("12", "Figure 1"), noise_share=0.4)
    one, many = (sorted((r.k, r.b) for r in df.repartition(n).select("k", block.alias("b")).collect()) for n in (1, 50))
    want = []
    for k, rs in enumerate(refs):
        lines = [wrapped(x, noise.WIDTHS[draw(k, 3, i + 3, 4)]) for i, x in enumerate(rs)]
        if draw(k, 3, 0, 2):
            lines = [f"{i}. {x}" for i, x in enumerate(lines, 1)]
        if draw(k, 3, 1, 1_000_000) < 400_000:
            lines.append(("12", "Figure 1")[draw(k, 3, 2, 2)])
        want.append((k, "\n".join(lines)))
    assert one == many == want and len({draw(k, 3, 0, 2) for k in range(120)}) == 2
    odd = spark.createDataFrame([(None, None), (1, []), (2, [None, ""])], "k int, refs array<string>").select(noise.reference_block(F.col("refs"), F.col("k")).alias("b"))
    assert len(odd.collect()) == 3


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"title {i}", 2000, "Ann", f"k{i}") for i in range(200)], "article_id long, title string, year int, author string, citekey string")
    chunks = rows.select(F.concat(F.col("article_id").cast("string"), F.lit(":0")).alias("chunk_id"), "article_id", F.concat_ws(" ", "title", F.repeat(F.lit("w "), F.col("article_id").cast("int"))).alias("chunk_text"))
    store = st.build_index(rows, chunks, f"file://{tmp_path}/i", buckets=16, search=())
    embed = lambda texts: [[float(len(x)), 1.0] for x in texts]

    def fails(texts):
        if any("title 77 " in x for x in texts):
            raise RuntimeError("the machine went away")
        return embed(texts)

    whole, path = f"file://{tmp_path}/whole", f"file://{tmp_path}/part"
    assert re.progress(spark, path).count() == 0
    every = re.reembed(store, embed, whole).collect()
    assert sorted(r.page for r in every) == list(range(16)) and sum(r.rows for r in every) == 200
    with pytest.raises(Exception, match="machine"):
        re.reembed(store, fails, path, 3)
    kept = {r.page: r.seconds for r in re.progress(spark, path).collect()}
    assert len(kept) < 6
    re.reembed(store, embed, path, 3, most_pages=1)
    assert re.progress(spark, path).count() == len(kept) + 1
    done = {r.page: r for r in re.reembed(store, embed, path, 3).collect()}
    assert sorted(done) == list(range(6)) and done[5].done == 16 and all(done[p].seconds == s for p, s in kept.items())
    rows = lambda p: sorted((r.chunk_id, tuple(r.embedding)) for r in re.reembedded(spark, p).collect())
    assert rows(path) == rows(whole) and len(rows(path)) == 200
    again = re.reembed(store, fails, path, 3)
    assert again.count() == 6
