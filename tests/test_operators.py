import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import quality as q, text as tx
from quillgraph.operators import evidence as e, graph as g, index, resolution as r, retrieval as rt, segmentation as s
from quillgraph.operators.components import connected_components


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.normalize_title, "Fabrega: Pathways, 2nd") == "fabrega pathways 2nd"
    assert one(spark, tx.normalize_doi, " https://dx.doi.org/10.1/AbC., ") == "10.1/abc" and one(spark, tx.normalize_doi, " ; ") is None
    assert one(spark, tx.path_stem, "a\\b/c.d.PDF") == "c.d" and one(spark, tx.identity, "  ") is None
    assert one(spark, tx.sentences, "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"] and one(spark, tx.words, None) == []
    assert one(spark, tx.first_year, "x1999 in 2004b, 2011.") == 2011 and one(spark, tx.first_doi, "doi:10.1234/ab.c.,") == "10.1234/ab.c"
    assert one(spark, tx.html_text, "<p>a &lt;b&gt; </p>c<br/>d") == "a <b>\nc\nd"
    assert one(spark, tx.html_text, "caf&#233; &eacute;&ndash;&#x27;&hellip;&amp;amp;&nbsp;<br>&unknown; &copy") == "café é–'…&amp;\n&unknown; ©"
    assert one(spark, tx.looks_like_references, "References\n1") and one(spark, tx.looks_like_references, "doi x doi y") and not one(spark, tx.looks_like_references, "plain")


def test_query_plan():
    p = rt.plan_query('Bischoff chronology "northern Utah" 2021')
    assert "bischoff" in p.tokens and p.years == (2021,) and p.phrases == ("northern utah",) and "bischoff" in p.author_terms
    assert p.must_terms == ("utah",) and p.anchor_terms == ("utah",) and not p.strict


def test_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, "a"), (3, None)], "k int, text string")
    got = [(x.k, x.word_start, x.word_end, x.chunk_text) for x in index.word_windows(docs, "k", size=4, overlap=1).orderBy("k", "word_start").collect()]
    assert got == [(1, 0, 4, "0 1 2 3"), (1, 3, 7, "3 4 5 6"), (1, 6, 10, "6 7 8 9"), (2, 0, 1, "a")]
    with pytest.raises(ValueError):
        index.word_windows(docs, "k", size=4, overlap=4)


def corpus(spark):
    articles = spark.createDataFrame([(1, "Utah points", 2001, "Ann Lee", "lee1"), (2, "Pottery", 2002, "Bo Ray", "ray2")], "article_id long, title string, year int, author string, citekey string")
    chunks = spark.createDataFrame([("1:0", 1, "projectile point typology in utah"), ("1:1", 1, "other words"), ("2:0", 2, "generic point text")], "chunk_id string, article_id long, chunk_text string")
    vectors = spark.createDataFrame([("1:0", [1.0, 0.0]), ("2:0", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    return rt.Corpus(articles, chunks, index.postings(chunks, "chunk_id"), vectors)


def test_retrieval(spark):
    c = corpus(spark)
    rows = rt.contextual_retrieve(c, "Utah projectile points", [1.0, 0.0], 2).collect()
    assert rows[0].chunk_id == "1:0" and "vector" in rows[0].sources and all(r.article_id == 1 for r in rows)
    lexical = rt.contextual_retrieve(c, "Utah projectile points", None, 2).collect()
    assert all("vector" not in r.sources for r in lexical) and any("token" in r.sources for r in lexical)
    papers = rt.contextual_retrieve(c, "point words", [0.0, 1.0], 2, "papers", 2).collect()
    assert len({p.article_id for p in papers}) == len(papers) == 2 and all(len(p.highlights) <= 2 for p in papers)
    assert len(rt.contextual_retrieve(c, "point words", None, 1, threshold=99.0).collect()) == 1
    assert rt.graphrag_retrieve(c, "point", None, 5, "chunks", threshold=99.0).count() == 0
    assert {r.chunk_id for r in rt.graphrag_retrieve(c, "POINT", None, 5, "chunks").collect()} == set()
    assert rt.contextual_retrieve(c, "", None, 2).count() == 0


def test_stored_index_answers_alike(spark, tmp_path):
    from quillgraph.operators import store

    c = corpus(spark)
    cites = spark.createDataFrame([(1, 2)], "src long, dst long")
    c = rt.Corpus(c.articles, c.chunks, c.tokens, c.vectors, cites)
    kept = rt.Corpus.stored(store.build_index(c.articles, c.chunks, f"file://{tmp_path}/index", c.vectors, cites, buckets=3))
    for question in ("Utah projectile points", "point words by Lee", "", "nothing that is there"):
        for vector in ([1.0, 0.0], None):
            a, b = ([(x.chunk_id, x.article_id, round(x.score, 9), x.sources, x.cites_out, x.cited_by) for x in rt.contextual_retrieve(k, question, vector, 3).collect()] for k in (c, kept))
            assert a == b
    a, b = ([(x.chunk_id, x.score, x.sources) for x in rt.graphrag_retrieve(k, "point utah", [1.0, 0.0], 5, "chunks").collect()] for k in (c, kept))
    assert a == b
    plan = kept.store.postings(["utah"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
    assert store.buckets_of(["utah", "é"], 7) == sorted({r.b for r in spark.createDataFrame([("utah",), ("é",)], "t string").select(store.bucket_of(F.col("t"), 7).alias("b")).collect()})


def test_claims(spark):
    rows = [(1, "A review without human experts shows solved tools", 1, "Tools", 2020, "c1", "human review remains; tools shows limitations"), (1, "A review without human experts shows solved tools", 1, "Tools", 2020, "c2", "References\ntools"), (2, "archaeology of mud", 1, "Tools", 2020, "c1", "nothing")]
    got = {(r.claim_id, r.chunk_id): r for r in e.score_claims(spark.createDataFrame(rows, "claim_id int, claim string, article_id int, title string, year int, chunk_id string, chunk_text string")).collect()}
    assert got[1, "c1"].contradiction == pytest.approx(0.47) and got[1, "c1"].score > got[1, "c2"].score and got[2, "c1"].classification == "not_supported"


def test_gate_and_audit(spark):
    from quillgraph.functions.vocabulary import ANSWER_STOPWORDS

    rows = [("hohokam projectile points of arizona", "hohokam projectile forms in arizona"), ("hohokam projectile points of arizona", "pottery dart")]
    assert [r.usable for r in e.gate_relevance(spark.createDataFrame(rows, "question string, evidence string"), ANSWER_STOPWORDS).collect()] == [True, False]
    audit = e.audit_answers(spark.createDataFrame([("Dogs bark. Cats fly!", "dogs"), ("Dogs bark.", None), ("", "x")], "answer string, evidence string")).collect()
    assert [(r.supported, r.unsupported, r.risk_label) for r in audit] == [(1, 1, "medium"), (0, 1, "high"), (0, 0, "low")]


def test_components_of_chains_stars_and_odd_rows(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3), (7, None)] + [(1, 0)] * 5
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines_and_blocks(spark):
    text = "\n".join(["HEAD", "first", "1", "HEAD", "second", "body two", "2", "HEAD", "third", "xii"])
    lines = s.lines_of(spark.createDataFrame([(1, text)], "d int, text string"), "d", per_page=3)
    kept = [x.line for x in s.strip_running_lines(lines, "d").orderBy("line_no").collect()]
    assert kept == ["first", "second", "body two", "third"]
    refs = "Smith, J. 1999. A title. Press\nmore of it\nJones, K., 2003 Other thing"
    blocks = s.citation_blocks(s.lines_of(spark.createDataFrame([(1, refs)], "d int, text string"), "d"), "d").orderBy("block").collect()
    assert [(b.year, b.raw_text.split()[0]) for b in blocks] == [(1999, "Smith,"), (2003, "Jones,")]
    assert blocks[0].raw_text.endswith("more of it") and blocks[1].title_guess == "Other thing"
    tail = "intro\n" * 30 + "\n".join(f"Name{i}, A. Title {i}. 19{80 + i}" .replace(str(i) + ",", ",") for i in range(5))
    assert s.reference_tail(s.lines_of(spark.createDataFrame([(1, tail)], "d int, text string"), "d"), "d").first().start_line == 30


def test_graph_edges(spark):
    records = spark.createDataFrame([(1, "", None), (2, "x", "d"), (3, "y", "e")], "id int, a string, b string")
    got = {x.id: (x.a, x.b) for x in g.merge_records(records, "id", spark.createDataFrame([(2, 1)], "old int, new int")).collect()}
    assert got == {1: ("x", "d"), 3: ("y", "e")}
    stored = spark.createDataFrame([(1, "old"), (2, "old")], "article_id int, v string")
    assert sorted(map(tuple, g.replace_articles(stored, spark.createDataFrame([(2, "new"), (2, "newer")], stored.schema)).collect())) == [(1, "old"), (2, "new"), (2, "newer")]


def test_citations(spark):
    refs = spark.createDataFrame([("a", 1, "growth of towns in utah", 2001, None, ["lee"]), ("b", 1, "x", None, "10.1/z", []), ("c", 1, "unrelated words entirely", 1950, None, [])], "reference_id string, article_id long, title_norm string, year int, doi string, author_tokens array<string>")
    targets = spark.createDataFrame([(2, "the growth of towns in utah", 2002, None, ["lee"]), (3, "y", 1999, "10.1/z", []), (1, "growth of towns in utah", 2001, None, [])], "target_id long, target_title string, target_year int, target_doi string, target_authors array<string>")
    got = {x.reference_id: x for x in r.resolve_citations(refs, targets).collect()}
    assert set(got) == {"a", "b"} and got["a"].target_id == 2 and got["a"].method == "reference_structured_match" and got["b"].score == 1.0


def plain_probability(a, b):
    """The formula, pair by pair."""
    similar = SequenceMatcher(None, a["title_norm"], b["target_title"]).ratio() if a["title_norm"] and b["target_title"] else 0.0
    x, y = set((a["title_norm"] or "").split()), set((b["target_title"] or "").split())
    jaccard = len(x & y) / len(x | y) if x & y else 0.0
    gap = None if a["year"] is None or b["target_year"] is None else abs(a["year"] - b["target_year"])
    author, token = 0.0, a["author_token"]
    if token:
        author = 1.0 if token in (b["target_authors"] or []) else 0.5 if token in (b["target_key"] or "") or token in (b["target_title"] or "") else 0.0
    p = 0.6 * similar + 0.2 * jaccard + 0.12 * {0: 1.0, 1: 0.4}.get(gap, 0.0) + 0.08 * author
    if a["doi"] is not None and a["doi"] == b["target_doi"]:
        p = max(p, 0.98)
    return round(min(1.0, max(0.0, p)), 4)


@pytest.mark.parametrize("block", [2048, 30])
def test_best_matches_are_those_of_all_pairs(spark, block):
    rng = random.Random(2)
    words = "growth of towns in utah and the early pottery from clay pits near rivers maps of bends".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    refs = [{"reference_id": i, "title_norm": title() if i % 9 else None, "year": rng.choice([None, 1999, 2000, 2001]), "author_token": rng.choice([None, "", "lee", "clay", "key7"]), "doi": rng.choice([None, None, "10.1/a"])} for i in range(60)]
    targets = [{"target_id": i, "target_title": title() if i % 11 else "", "target_year": rng.choice([None, 1999, 2002]), "target_doi": rng.choice([None, None, None, "10.1/a"]), "target_authors": rng.choice([None, [], ["lee"], ["kim", "lee"]]), "target_key": f"key{i}"} for i in range(90)]
    left = spark.createDataFrame(refs, "reference_id long, title_norm string, year int, author_token string, doi string")
    right = spark.createDataFrame(targets, "target_id long, target_title string, target_year int, target_doi string, target_authors array<string>, target_key string")
    got = {}
    for x in r.best_matches(left, right, 2, block).collect():
        got[x.reference_id, x.place] = (x.target_id, x.probability)
    for a in refs:
        want = sorted(((plain_probability(a, b), -b["target_id"]) for b in targets if b["target_id"] != a["reference_id"]), reverse=True)[:2]
        assert [got[a["reference_id"], i] for i in (1, 2)] == [(-t, p) for p, t in want]
    assert r.best_matches(left.limit(0), right).count() == 0 == r.best_matches(left, right.limit(0)).count()


def test_keys_lose_their_marks(spark):
    row = spark.createDataFrame([("Fábrega-Álvarez: Pathwáys", 2022)], "t string, y int").select(tx.title_year_key(F.col("t"), F.col("y")).alias("k"), tx.fold(F.col("t")).alias("f")).first()
    assert row.k == "fabrega alvarez pathways|2022" and row.f == "fabrega-alvarez: pathways"
    rows = spark.createDataFrame([(None,), ("",), ("AB c",)], "t string").select(tx.fold(F.col("t")).alias("f")).collect()
    assert [x.f for x in rows] == [None, "", "ab c"]


def test_names_of_a_hub_stay_few(spark):
    edges = spark.range(0, 5000).select(F.lit(1).alias("k"), (F.lit(5000) - F.col("id")).alias("at"), F.concat(F.lit("n"), F.lpad((F.col("id") % 50).cast("string"), 3, "0")).alias("name"))
    assert g.ordered_names(edges, "k", "at", "name", 3).first().names == ["n049", "n048", "n047"]
    assert g.first_distinct(edges, "k", "name", 2).first().names == ["n000", "n001"]


def test_citation_score(spark):
    rows = spark.createDataFrame([("A good title here", "x", 2000, ["a"], "10.1/x"), ("abc", "Downloaded from http://a", None, None, None)], "t string, r string, y int, a array<string>, d string")
    got = [x.s for x in rows.select(q.citation_score(*[F.col(c) for c in "tryad"]).alias("s")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0


def test_claim_chunks_are_those_of_postings(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["the", "a", "archive"]
    chunks = spark.createDataFrame([(f"{i % 97}:{i}", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(400)] + [("none", None)], "chunk_id string, chunk_text string").repartition(3)
    claims = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(40)] + [(900, None), (901, "unknown"), (902, "the")], "claim_id long, claim string")
    want = sorted(e.claim_candidates(claims, index.postings(chunks, "chunk_id"), 5).collect())
    for block, rows in ((512, 2048), (7, 50), (40, 3)):
        assert sorted(e.claim_chunks(claims, chunks, 5, block, rows).collect()) == want and want
    # The pairs of claims and chunks are no rows of a shuffle: only the chosen ones are.
    plan = e.claim_chunks(claims, chunks.coalesce(1), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan


def test_best_matches_compare_few_titles(monkeypatch):
    import pandas as pd

    calls = []
    monkeypatch.setattr(r, "SequenceMatcher", lambda *a: calls.append(1) or SequenceMatcher(*a))
    rng, m = random.Random(8), 400
    titles = [" ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(7)) for _ in range(m)]
    targets = pd.DataFrame({"target_id": range(m), "target_title": titles, "target_year": 2000, "target_doi": None, "target_authors": [["x"]] * m, "target_key": "k"})
    refs = pd.DataFrame({"reference_id": range(m, m + 40), "title_norm": titles[:40], "year": 2000, "author_token": "x", "doi": None, "floor": 0.7})
    got = list(r._match_block(refs, targets, 2))
    assert [x[1] for x in got if x[4] == 1.0] == list(range(40)) and len(calls) < 40 * 12


def test_only_entities_go_to_python(spark):
    df = spark.createDataFrame([("&lt;" + "x" * 50 + "&amp;&notit;&#x41;",), ("no entity",), (None,), ("&eacute",)], "h string")
    found = df.select(tx.html_text(F.col("h")).alias("t"))
    assert [r.t for r in found.collect()] == ["<" + "x" * 50 + "&¬it;A", "no entity", "", "é"]
    assert "regexp_extract_all" in next(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "_unescaped(" in x and "ArrowEvalPython" in x) or "_unescaped(regexp_extract_all" in found._jdf.queryExecution().analyzed().toString()


def test_many_pairs_match_as_difflib_does():
    import numpy as np

    rng = random.Random(4)
    texts = ["", "a", "a" * 64, "ab" * 32, "ba" * 90, "a" * 199] + ["".join(rng.choices("ab c", k=rng.randint(1, 70))) for _ in range(60)]
    place = {c: i for i, c in enumerate("ab c")}
    codes, masks = np.full((len(texts), 199), 4), np.zeros((len(texts), 5), np.uint64)
    for i, x in enumerate(texts):
        codes[i, : len(x)] = [place[c] for c in x]
        for j, c in enumerate(x if len(x) <= 64 else ""):
            masks[i, place[c]] |= np.uint64(1 << j)
    a, b = (x.ravel() for x in np.meshgrid([i for i, x in enumerate(texts) if len(x) <= 64], range(len(texts))))
    lengths = np.array([len(x) for x in texts])
    want = [sum(m.size for m in SequenceMatcher(None, texts[i], texts[j]).get_matching_blocks()) for i, j in zip(a, b, strict=True)]
    assert r._matched(masks, a, codes[b], lengths[a], lengths[b]).tolist() == want


def test_equal_titles_are_worked_once(monkeypatch):
    """Copies of a title share what is found for it."""
    import pandas as pd

    calls, inner = [], r._common_subsequences
    monkeypatch.setattr(r, "_common_subsequences", lambda masks, n, codes, lengths: calls.append(len(lengths)) or inner(masks, n, codes, lengths))
    titles = ["an aianque en de vequeu des an", "thtion on of a tionre ble hees the"]
    targets = pd.DataFrame({"target_id": range(300), "target_title": [titles[1]] * 300, "target_year": 2014, "target_doi": None, "target_authors": [["src14"]] * 300, "target_key": "k"})
    refs = pd.DataFrame({"reference_id": range(1000, 1300), "title_norm": titles[0], "year": 2014, "author_token": "src14", "doi": None, "floor": None})
    got = list(r._match_block(refs, targets, 2))
    assert len(got) == 600 and {x[4] for x in got} == {round(0.6 * 0.40625 + 0.2 * 0.0 + 0.12 * 1.0 + 0.08 * 1.0, 4)} and sum(calls) <= 1


def test_pairs_of_blocks_are_not_merged_by_bytes(spark, monkeypatch):
    """Titles are few bytes, and a task that adaptive execution makes of many blocks would compare them all."""
    refs = spark.range(600).selectExpr("id as reference_id", "concat('title ', id % 50) as title_norm", "2000 as year", "'x' as author_token", "cast(null as string) as doi")
    targets = spark.range(600).selectExpr("id as target_id", "concat('title ', id % 50) as target_title", "2000 as target_year", "cast(null as string) as target_doi", "array('x') as target_authors", "'k' as target_key")
    found = r.best_matches(refs, targets, 2, 100)
    assert found.count() == 1200
    plan = found._jdf.queryExecution().executedPlan().toString()
    held = [x for x in plan.split("\n") if "Exchange hashpartitioning(rb" in x]
    assert len(held) == 2 and all("REPARTITION_BY_NUM" in x for x in held)
