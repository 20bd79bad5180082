import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names as n, quality as q
from quillgraph.operators import corrections as c, datasets as d, index, notes, retrieval as rt, segmentation as sg
from quillgraph.sources import attachments as at


def test_metadata_and_stubs_keep_what_isnt_given(spark):
    a = spark.createDataFrame([(1, "a", 2000), (2, None, None)], "article_id int, title string, year int")
    new = spark.createDataFrame([(1, None, 2001), (3, "x", 1)], "article_id int, title string, year int")
    assert sorted(map(tuple, c.refresh_metadata(a, new).collect())) == [(1, "a", 2001), (2, None, None)]
    stubs = spark.createDataFrame([("k-1", "E1", None), ("K b!", " ", "t"), ("z", "E1", "u")], "citekey string, external_id string, title string")
    have = spark.createDataFrame([("cat::E1", None, None, None, "old")], "article_id string, citekey string, external_id string, source_path string, title string")
    got = {r.article_id: r for r in c.ensure_stubs(have, stubs, "cat").collect()}
    assert set(got) == {"cat::E1", "cat-citekey::k-b"} and got["cat::E1"].citekey == "k-1" and got["cat::E1"].title == "old" and got["cat-citekey::k-b"].source_path == "cat-citekey://K b!"


def test_repointing_replaces_edges(spark):
    refs = spark.createDataFrame([(1, 10, "k"), (2, 11, "k"), (3, 10, "other")], "reference_id int, article_id int, ref_key string")
    resolves = spark.createDataFrame([(1, 99), (3, 98)], "reference_id int, target_id int")
    cites = spark.createDataFrame([(10, 20, "reference_title_match", 0.7), (10, 98, "x", 0.5)], "src int, dst int, method string, score double")
    orders = spark.createDataFrame([("k", "SMITH1"), ("none", "nobody")], "ref_key string, citekey string")
    articles = spark.createDataFrame([(20, "smith1"), (21, None)], "article_id int, citekey string")
    now, edges = c.repoint_references(refs, resolves, cites, orders, articles)
    assert sorted(map(tuple, now.collect())) == [(1, 20), (2, 20), (3, 98)]
    assert sorted(map(tuple, edges.collect())) == [(10, 20, "manual_correction_citekey", 1.0), (10, 98, "x", 0.5), (11, 20, "manual_correction_citekey", 1.0)]


def test_notes(spark):
    long = "word " * 40
    rows = [("a scan", f"# Head\n- item\n{long}", True, 2), ("none", f"# Head\n- item\n{long}", False, 2), ("", f"MARK_V12\n attachment_id = 7 \n{long}", True, 0), ("scan", "# a\n- b", False, 2), (None, None, False, 0), ("scan", f"1. x\n```\n| a |\n{long}", True, 3)]
    df = spark.createDataFrame([(t, x) for t, x, _, _ in rows], "t string, x string")
    got = df.select(notes.is_markdown_note(F.col("t"), F.col("x"), "MARK_V", "scan").alias("is"), notes.markdown_signs(F.col("x")).alias("n"), notes.attachment_id(F.col("x")).alias("a")).collect()
    assert [(r["is"], r.n) for r in got] == [(i, k) for _, _, i, k in rows] and [r.a for r in got] == [None, None, 7, None, None, None]


def test_attachments_without_anything(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("A", "p", "C:/x/y.pdf", None), ("B", None, None, "/there")], "attachment_key string, persistent_id string, raw_path string, path string")
    files = spark.createDataFrame([("/there",)], "path string")
    none = spark.createDataFrame([], "key string, path string")
    maps = spark.createDataFrame([], "prefix string, folder string")
    got = sorted((r.attachment_key or "", r.file, r.issue_code) for r in at.resolve_attachments(rows, files, none, maps).collect())
    assert got == [("", None, "missing_attachment_path"), ("A", None, "linked_windows_path"), ("B", "/there", None)]
    assert at.resolve_attachments(rows.limit(0), files, none, maps).count() == 0


def test_mapped_paths_of_rows_in_no_order(spark):
    keys = spark.range(400).select(F.col("id").cast("string").alias("k"))
    rows = keys.select("k", F.lit("").alias("attachment_key"), F.lit("").alias("persistent_id"), F.concat(F.lit("D:/x/"), "k").alias("raw_path"), F.lit("").alias("path")).repartition(7)
    maps = spark.createDataFrame([("D:/x", "/map")], "prefix string, folder string")
    found = at.resolve_attachments(rows, keys.select(F.concat(F.lit("/map/"), "k").alias("path")), spark.createDataFrame([], "key string, path string"), maps).select("k", "file").collect()
    assert len(found) == 400 and all(r.file == f"/map/{r.k}" for r in found)


def test_large_listings_are_not_broadcast(spark):
    keys = spark.range(30_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(F.col("k").alias("attachment_key"), F.lit("").alias("persistent_id"), F.lit("").alias("raw_path"), F.concat(F.lit("/a/"), "k").alias("path"))
    files = keys.select(F.explode(F.array(*[F.concat(F.lit(x), "k") for x in ("/a/", "/b/", "/c/", "/d/")])).alias("path"))
    found = at.resolve_attachments(rows, files, spark.createDataFrame([], "key string, path string"), spark.createDataFrame([], "prefix string, folder string"))
    assert found.where("file = path").count() == 30_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    blank = at._look_up(rows.withColumn("path", F.lit("")), files.withColumn("t", F.lit(True)), "path").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in blank) < 15_000


def test_page_windows(spark):
    text = "\n".join(f"a{i} b{i}" for i in range(10))
    rows = index.page_windows(spark.createDataFrame([(1, text), (2, None), (3, " ")], "k int, text string"), "k", per_page=3, size=6, overlap=2).collect()
    assert [(r.chunk_index, r.page_start, r.page_end) for r in rows] == [(0, 1, 1), (1, 1, 2), (2, 2, 3), (3, 3, 3), (4, 3, 4)]
    assert rows[1].chunk_text == "a2 b2 a3 b3 a4 b4" and rows[-1].chunk_text.endswith("a9 b9")


def test_embedding_hook_and_overwrite(spark):
    chunks = spark.createDataFrame([(f"c{i}", "x" * i if i else None) for i in range(10)], "chunk_id string, chunk_text string")
    fresh = index.embed_texts(chunks, lambda texts: [[len(t), len(texts)] for t in texts], batch=4)
    assert {r.chunk_id: r.embedding[0] for r in fresh.collect()} == {f"c{i}": float(i) for i in range(10)}
    stored = spark.createDataFrame([("c1", [9.0]), ("zz", [8.0])], "chunk_id string, embedding array<float>")
    assert {r.chunk_id: list(r.embedding)[0] for r in index.overwrite_vectors(stored, fresh).collect()} == {"c1": 1.0, "zz": 8.0}


def alike(a, b):
    x, y = set(a.split()), set(b.split())
    return max(SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y))


def greedy(gold, predicted):
    used, hits = set(), 0
    for g in gold:
        scored = [(alike(g, p), -i) for i, p in enumerate(predicted) if i not in used]
        if scored and max(scored)[0] >= 0.72:
            used.add(-max(scored)[1])
            hits += 1
    return hits


def test_fuzzy_scores_by_hand(spark):
    rng = random.Random(1)
    words = ["growth", "of", "towns", "in", "utah", "clay", "pots", "maps"]
    rows = [([" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randint(0, 5))], [" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randint(0, 5))]) for _ in range(60)]
    rows += [(None, ["a"]), (["Smith, J. (2001)"], ["smith j 2001", "x"]), (["kidder pottery growth utah"], ["utah growth pottery kidder"]), (["A b", "a  B", "a-b"], ["a b"])]
    got = d.fuzzy_prf(spark.createDataFrame(rows, "g array<string>, p array<string>").coalesce(1), "g", "p").collect()
    assert len(got) == len(rows)
    for r in got:
        forms = lambda xs: sorted({" ".join(x.lower().split()) for x in xs or []} - {""})
        canon = lambda xs: [c for x in xs if (c := " ".join("".join(ch if ch.isalnum() else " " for ch in x.replace("doi:", " ")).split()))]
        g, p = forms(r.g), forms(r.p)
        hits = greedy(canon(g), canon(p))
        assert r.fuzzy_overlap == hits and r.fuzzy_precision == pytest.approx(hits / len(p) if p else 0) and r.fuzzy_recall == pytest.approx(hits / len(g) if g else 0)
    assert [(r.fuzzy_overlap, r.fuzzy_f1) for r in got[-2:]] == [(1, 1.0), (1, pytest.approx(2 / 3))]
    means = d.macro_scores(spark.createDataFrame(got[-2:]), "fuzzy_precision", "fuzzy_recall", "fuzzy_f1").first()
    assert (means.n, means.macro_fuzzy_precision, means.macro_fuzzy_recall) == (2, 1.0, 0.75)
    assert tuple(d.macro_scores(spark.createDataFrame([], "f double"), "f").first()) == (0, 0.0)


def test_fuzzy_matches_ask_difflib_only_where_bounds_allow(monkeypatch):
    rng = random.Random(3)
    texts = lambda: ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 70))).strip() or "a" for _ in range(12)]
    pairs = [(texts(), texts()) for _ in range(20)]
    for g, p in pairs[:8]:
        p[3:5] = [g[2][:-1] + "x", g[2]]
        p[7] = " ".join(reversed(g[5].split()))
    pairs += [(["a" * 250 + "b"], ["a" * 250 + "c", "a" * 251]), ([""], ["", "a"]), (["a b"], ["c d", "b a", "a b"])]
    want = [greedy([x for x in g if x], [x for x in p if x]) for g, p in pairs]
    calls = []
    monkeypatch.setattr(d, "SequenceMatcher", lambda *a: calls.append(1) or SequenceMatcher(*a))
    assert [d._greedy_hits(g, p, 0.72) for g, p in pairs] == want and sum(want) > 16
    assert len(calls) < sum(len(g) * len(p) for g, p in pairs) // 20
    for low in (0.0, 0.3, 0.5):
        for g, p in pairs[:12]:
            free, hits = list(p), 0
            for x in g:
                scores = [alike(x, y) for y in free]
                if scores and max(scores) > 0 and max(scores) >= low:
                    free.pop(scores.index(max(scores)))
                    hits += 1
            assert d._greedy_hits(g, p, low) == hits


def test_small_functions(spark):
    row = spark.range(1).select(
        n.slug(F.lit(" Ab c! ")).alias("a"), n.slug(F.lit("--")).alias("b"), n.slug(F.lit(None).cast("string")).alias("c"), n.filename_fields(F.lit("/x/smithJones2001-SomeTitle_of,it.pdf")).alias("d"), n.filename_fields(F.lit("plain_name.pdf")).alias("e"),
        q.citation_details(F.lit("A title that is long, pp. 3"), F.lit("raw"), F.lit(None).cast("int"), F.array(F.lit("x")), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit("llm"), F.lit(False)).alias("f"),
        q.recognition_summary(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit("ocr"), F.lit(None).cast("string")).alias("g"),
    ).first()
    assert (row.a, row.b, row.c) == ("ab-c", "unknown", "unknown")
    assert tuple(row.d) == ("Smithjones", 2001, "Some Title of, it") and tuple(row.e) == ("Unknown Author", None, "plain name")
    assert row.f.score == pytest.approx(0.25 + 0.2 + 0.1 - 0.2) and row.f.needs_review and row.f.reasons == ["missing_year", "truncated_title"]
    assert row.g == "heuristic:ocr;lines=0;pages=0;chars=0;tokens=0;alpha_ratio=0.000;suspect_ratio=0.000;native_reason=unknown"


def test_writers(spark, tmp_path):
    refs = spark.createDataFrame([(1, 1, "second  one"), (1, 0, "first"), (2, 0, ""), (3, 0, None)], "article_id int, ref_index int, raw_text string")
    d.write_sidecars(refs, f"file://{tmp_path}/side")
    assert sorted(p.name for p in (tmp_path / "side").iterdir() if p.is_dir()) == ["article_id=1"]
    assert spark.read.text(f"file://{tmp_path}/side/article_id=1").collect()[0].value == "first"
    d.write_json_lines(refs, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 4
    assert d.exclude_ids(refs, spark.createDataFrame([(1,), (None,)], "article_id int"), "article_id").count() == 2


def recognised(spark, *texts):
    rows = sg.recognised_references(spark.createDataFrame([(k, i, x) for k, lines in enumerate(texts) for i, x in enumerate(lines)], "k int, line_no int, line string").repartition(3), "k").collect()
    found = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.k, r.ref_index)):
        found[r.k].append(r.raw_text)
    return found


def test_recognised_references(spark):
    first = ["9", "Smith, John and Ann Lee", "1999 The growth of towns in the west.", "University of Utah Press", "2001a Another study of the same towns", "Jones, A. 2003 Clay pots and how they were fired", "12", "short", "", None, "2001a another study of the same towns"]
    # A line with digits isn't one of names, even above a year.
    second = ["Smith, John. 1999 Growth of towns", "2001 Another study of the same towns in Utah"]
    third = ["lost line", "Lee, Ann", "no year below", "Kim, Bo", "1980 A long study of towns; ", "Lee, Ann", "1990 too short"]
    assert recognised(spark, first, second, third, []) == [
        ["Smith, John and Ann Lee 1999 The growth of towns in the west. University of Utah Press", "Smith, John and Ann Lee 2001a Another study of the same towns", "Jones, A. 2003 Clay pots and how they were fired short"],
        ["Smith, John. 1999 Growth of towns", "2001 Another study of the same towns in Utah"],
        ["Kim, Bo 1980 A long study of towns"],
        [],
    ]


def test_recognised_region(spark):
    text = "Smith 1990 not here, it is before the list\nReferences\nLee, A. 2001 A study of the towns of Utah\nArticle continued from page 3\nKim, B. 2002 A study that is beyond the stop"
    rows = sg.split_recognised(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k int, text string"), "k").collect()
    assert [(r.k, r.ref_index, r.raw_text) for r in rows] == [(1, 0, "Lee, A. 2001 A study of the towns of Utah")]


def test_slow_vectors_are_left_out(spark):
    import time

    articles = spark.createDataFrame([(1, "Utah points", 2001, "Ann Lee", "lee1")], "article_id long, title string, year int, author string, citekey string")
    chunks = spark.createDataFrame([("1:0", 1, "projectile point typology in utah")], "chunk_id string, article_id long, chunk_text string")
    vectors = spark.createDataFrame([("1:0", [1.0, 0.0])], "chunk_id string, embedding array<float>")

    def slow(frames):
        time.sleep(25)
        yield from frames

    def broken(frames):
        raise ValueError("no vectors today")
        yield

    corpus = lambda v: rt.Corpus(articles, chunks, index.postings(chunks, "chunk_id"), v)
    began = time.monotonic()
    rows = rt.contextual_retrieve(corpus(vectors.mapInPandas(slow, vectors.schema)), "Utah points", [1.0, 0.0], 2, vector_seconds=3).collect()
    assert rows and all("vector" not in r.sources for r in rows) and time.monotonic() - began < 60
    rows = rt.contextual_retrieve(corpus(vectors), "Utah points", [1.0, 0.0], 2, vector_seconds=60).collect()
    assert any("vector" in r.sources for r in rows)
    with pytest.raises(Exception, match="(?s).*"):
        rt.contextual_retrieve(corpus(vectors.mapInPandas(broken, vectors.schema)), "Utah points", [1.0, 0.0], 2, vector_seconds=60).collect()


def test_time_limit_leaves_the_callers_properties_and_workers(spark):
    import time

    context = spark.sparkContext
    context.setJobGroup("mine", "a group of the caller", interruptOnCancel=False)
    context.addJobTag("own-tag")
    try:
        rows = spark.range(8).repartition(8)

        def slow(frames):
            time.sleep(3)
            yield from frames

        for _ in range(10):
            assert rt.within(rows.mapInPandas(slow, "id long"), 0.3) is None
            # Python workers that are left behind don't fail the stages after them.
            assert rows.mapInPandas(lambda frames: frames, "id long").count() == 8
        waits = rows.select(F.expr("java_method('java.lang.Thread', 'sleep', 2000L)"))
        began = time.monotonic()
        assert rt.within(waits, 0.3) is None and time.monotonic() - began < 2
        assert rt.within(rows, 60).count() == 8
        assert context.getLocalProperty("spark.jobGroup.id") == "mine" and set(context.getJobTags()) == {"own-tag"}
    finally:
        context.clearJobTags()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def test_recognised_references_without_a_shuffle(spark):
    text = "intro\nReferences\n  12 \nprelude\nSmith, Al\n1998 A title that is long enough\ngoes on\n1999 another title that is long enough\nKim, B. 2001 a third one, quite long;\nKIM, B. 2001 A THIRD ONE, QUITE LONG\nLee, Cy\n2002 short\n2003 a title of the last author here"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "References")], "k int, text string")
    found = sg.split_recognised(docs, "k")
    assert [tuple(r) for r in found.orderBy("ref_index").collect()] == [
        (1, 0, "Smith, Al 1998 A title that is long enough goes on"), (1, 1, "Smith, Al 1999 another title that is long enough"), (1, 2, "Kim, B. 2001 a third one, quite long"), (1, 3, "Lee, Cy 2003 a title of the last author here"),
    ]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
