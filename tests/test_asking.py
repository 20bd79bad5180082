"""Questions made queries, outcomes of retrieved rows, keywords with seeds."""

import pytest

from quillgraph.functions.vocabulary import Vocabulary
from quillgraph.operators import asking as a, catalogue as cat

HINTS = {"fremont": ("utah", "intermountain", "formative"), "points": ("projectile", "point")}


def test_questions_become_queries(spark):
    cases = [
        ("What did Janetski argue about Fremont points in 1999?", "authors: Janetski Fremont | years: 1999 | title_terms: Janetski Fremont points | content_terms: utah intermountain formative projectile point", "Janetski Fremont 1999 points utah intermountain formative projectile point", True),
        # Generic words alone are no query, nor is one of fewer words than the question's three.
        ("research methods", "authors: none | years: none | title_terms: research methods | content_terms: none", "research methods", False),
        ("What is it?", "authors: none | years: none | title_terms: none | content_terms: none", "What is it?", False),
        ("clay and NOT pots", "authors: NOT | years: none | title_terms: clay and NOT pots | content_terms: none", "clay pots", False),
        ("Clay pots of Utah", "authors: Clay Utah | years: none | title_terms: Clay pots Utah | content_terms: none", "Clay Utah pots", True),
        ("", "authors: none | years: none | title_terms: none | content_terms: none", "", False),
        (None, "authors: none | years: none | title_terms: none | content_terms: none", "", False),
    ]
    rows = a.rewrite_questions(spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(cases)], "i int, question string").coalesce(1), expansions=HINTS).orderBy("i").collect()
    for r, (q, directive, compact, sane) in zip(rows, cases, strict=True):
        assert (r.directive, r.compact_query, r.sane) == (directive, compact, sane)
        assert r.search_query == (compact if sane else (q or "").strip())
    assert rows[0].asDict().keys() == {"i", "question", "directive", "compact_query", "sane", "search_query"}


def test_outcomes(spark):
    asked = spark.createDataFrame([(1, "fremont points in utah"), (2, "fremont points in utah"), (3, "fremont points in utah"), (4, None)], "q int, question string")
    found = spark.createDataFrame([
        (1, 9, "Fremont points of Utah", None, "Ann"), (1, 3, "Nothing here", "Title", None), (1, 20, " ", "Fremont points", "Utah"), (1, 30, "Utah Fremont", None, None), (1, 31, "Fremont, Utah, points", None, None),
        (2, 1, "Clay pots", "Pots", "Ann"), (4, 1, "text", None, None), (7, 1, "fremont points utah", None, None),
    ], "q int, position int, text string, title string, authors string")
    got = {r.q: r for r in a.ground_answers(asked, found, "q").collect()}
    assert {k: (r.status, r.fallback_reason) for k, r in got.items()} == {1: ("failed", "synthesis_unavailable"), 2: ("irrelevant_context", "no_relevant_evidence"), 3: ("no_context", "no_retrieved_context"), 4: ("irrelevant_context", "no_relevant_evidence")}
    assert got[1].used == ["C2", "C3", "C4", "C5"] and got[1].excluded == ["C1"] and got[1].snippets == ["[C2] Fremont points of Utah", "[C4] Utah Fremont"]
    assert got[2].used == [] and got[2].excluded == ["C1"] and got[3].snippets == [] and got[1].summary.startswith("4 of 5 ") and all(r.answer == a.ANSWERS[r.status] for r in got.values())
    assert a.ground_answers(asked.limit(0), found, "q").count() == 0
    plain = a.ground_answers(asked, found.select("q", "position", "text"), "q", vocabulary=Vocabulary(families={})).where("q = 2").first()
    assert plain.status == "irrelevant_context"


@pytest.mark.parametrize("limit,most", [(32, 32), (1, 8), (500, 80)])
def test_keywords_have_seeds_and_limits(spark, limit, most):
    words = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120))
    rows = spark.createDataFrame([(1, "The Towns", "the  towns!", "Growth", f"growth growth towns towns {words}"), (2, None, "", None, ""), (3, "A", "B", "C", None)], "k int, title string, journal string, publisher string, text string")
    got = {}
    for r in cat.keywords(rows, "k", ("title", "journal", "publisher"), "text", limit).collect():
        got.setdefault(r.k, []).append((r.value, r.origin, r.score))
    assert len(got[1]) == most and [v for v, o, _ in got[1] if o == "metadata_seed"] == ["the towns", "growth"] and 2 not in got and {v for v, *_ in got[3]} == {"a", "b", "c"}
    body = {v: s for v, o, s in got[1] if o == "heuristic_tokens"}
    assert "growth" not in body and body["towns"] == 0.9 and all(s == pytest.approx(0.7) for v, s in body.items() if v != "towns")
