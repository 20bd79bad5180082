import pytest
from pyspark.sql import functions as F

from quillgraph.functions import documents as d, reports
from quillgraph.functions.references import authors
from quillgraph.operators import datasets, documents as o


def test_reference_spans():
    tail = ["body", "text", "Smith, J. 1999. One.", "Jones, K. 2001. Two.", "Brown, L. 2003. Three."]
    assert d.reference_spans(tail) == [{"start_line": 2, "end_line": 4, "method": "tail_cluster", "confidence": 0.78}]
    two = ["# A", "# References", "x", "y", "# B", "## Bibliography", "z", "w"]
    assert [(s["start_line"], s["end_line"]) for s in d.reference_spans(two)] == [(2, 3), (6, 7)]
    assert d.reference_spans(["a", "Works Cited", "b"])[0]["method"] == "plain_heading" and d.reference_spans([]) == []


def test_entries():
    entries, failures = d.split_entries(["Smith, J. 1999. One.", "https://doi.org/10.1/x", "Figure 3. noise", "[6] Jones 2001 two [7] Brown 2002 three", "stray", "Smith, j. 1999. one. https://doi.org/10.1/x"])
    assert entries[0] == "Smith, J. 1999. One. https://doi.org/10.1/x" and entries[1].startswith("[6]") and entries[2].startswith("[7]")
    assert d.split_entries(["stray words"]) == ([], ["orphan_continuation"])
    assert d.split_entries(["[1] x"])[1] == ["invalid_reference_text"]


def test_markdown_chunks():
    text = "# A\n" + "a " * 30 + "\n## B\nfew words\n# References\nSmith 1999\n# C\n" + "\n\n".join("c " * 40 for _ in range(4))
    got = d.markdown_chunks(text, 20, 50, 60)
    assert got[0]["heading_path"] == ["A"] and "few words" in got[0]["text"] and not any("Smith" in c["text"] for c in got)
    assert len(got) == 5 and all(c["token_count"] <= 60 for c in got)
    assert d.blocks(["```", "x", "", "y", "```", "- a", "- b", "p", "q", "", "r"]) == ["```\nx\n\ny\n```", "- a", "- b", "p\nq", "r"]
    assert d.markdown_chunks("") == [] and d.markdown_chunks(None) == []


def test_frames(spark):
    docs = spark.createDataFrame([(1, "# References\nSmith, J. 1999. One.\nmore"), (2, None), (2, "plain")], "k long, text string")
    got = o.references(docs, "k").collect()
    assert [(r.k, r.kind, r.method) for r in got] == [(1, "entry", "markdown_heading")]
    assert {r.k for r in o.markdown_chunks(docs, "k").collect()} == {2}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ames, Noah 1931 The Old Ways of the River.", ["Noah Ames"]),
        ("Beck, Emma M., Tia Gray, Ann Mc-Mill, and Sue Shaw. 2021. On Birds.", ["Emma M. Beck", "Tia Gray", "Ann Mc-Mill", "Sue Shaw"]),
        ("Lind, Ada R., Reil, Max V., Kohl, Tim A., 1992. Digs in Area 1.", ["Ada R. Lind", "Max V. Reil", "Tim A Kohl"]),
        ("Bly Bird, R., Smit, E.A., Bird, D.W., 2005. Signals.", ["R. Bly Bird", "E.A. Smit", "D.W Bird"]),
        ("[55] Gard, J.-C., Built constructs : an aspect, Cambridge; New York: Some Press, 1980", ["J.-C. Gard"]),
        ("[51] Tran, J., Curating things: museums, in: Mart, P.F, Jon, B.K. (Eds.), Museums, London, 2007", ["J. Tran"]),
        ("[31] Adhi, K., Real, G., Smit, A.J.P., et al.: A wide study, 2015", ["K. Adhi", "G. Real", "A.J.P. Smit"]),
        ("[44] Viol, P., Jon, M.: Rapid detection. Int. J. 57(2), 137-154 (2004).", ["P. Viol", "M. Jon"]),
        ("[120] D.W. Thom, On Growth and Form, Some University Press, 1917.", ["D.W. Thom"]),
        ("Brou, Jack, M., and Frank E. Bay 2002 Showing Off.", ["Jack Brou", "Frank E. Bay"]),
        ("van der Berg, Jan; Lee, A., Jr. 1999. X", ["Jan van der Berg", "A. Lee"]),
        ("no names here 1999", []), ("1999. Title", []), ("", []), (None, []),
    ],
)
def test_authors(text, want):
    assert authors(text) == want


def test_sections():
    lines = ["Contents", "One ..... 1", "References ..... 9", "# One", *["text here."] * 30, "RUNNING HEAD", "x y.", "RUNNING HEAD", "# References", "Lee, A. 1999. One.", "Kim, B. 2001. Two.", "Appendix A", "last"]
    assert [(s["kind"], s["start_line"], s["end_line"]) for s in d.sections(lines)] == [("frontmatter", 0, 2), ("body", 3, 36), ("references", 37, 39), ("backmatter_other", 40, 41)]
    assert d.sections([]) == [] and d.sections([""])[0]["kind"] == "body"
    assert [s["kind"] for s in d.sections(["Preface", "a b.", "# One", "c d."])] == ["frontmatter", "body"]


def test_reference_frames(spark):
    raw = spark.createDataFrame([(1, "Lee, A. 1999. A title. doi:10.1234/AB."), (2, None), (3, "no year")], "k long, raw_text string")
    got = {r.k: r for r in o.parsed_references(raw).collect()}
    assert (got[1].authors, got[1].author_tokens, got[1].year, got[1].title, got[1].doi) == (["A Lee"], ["lee"], 1999, "A title", "10.1234/ab")
    assert (got[2].authors, got[2].year, got[2].title, got[2].doi) == ([], None, "", None) and got[3].title == "no year"
    docs = spark.createDataFrame([(1, "# A\nb"), (1, "# A\nb"), (2, None)], "k long, text string")
    assert [(r.k, r.kind) for r in o.section_plan(docs, "k").collect()] == [(1, "body")] * 2


def test_rewrites_and_reports(spark):
    one = [datasets.Template("t", 1, "Who is {a}?", authors="{a} and {a}")]
    keys = spark.createDataFrame([(3,), (1,), (None,)], "k long")
    got = datasets.query_rewrites(keys, "k", one, {"a": ["Jo Lee"]})
    rows = datasets.chat_rows(got, "s", "question", "directive").collect()
    assert [(r.k, r.question, r.directive, r.compact_query) for r in rows] == [(1, "Who is Jo Lee?", "authors: jo lee | years: none | title_terms: none | content_terms: none", "jo lee")]
    assert [m.role for m in rows[0].messages] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        datasets.query_rewrites(keys, "k", one, {"a": []})
    kind = "array<struct<citation_id:string,article_title:string,article_year:int,authors:array<string>,citekey:string,doi:string,page_start:int,page_end:int,chunk_id:string>>"
    frame = spark.createDataFrame([([("C1", 'a, "b"', None, None, None, None, 1, 2, "x")],), ([],), (None,)], f"c {kind}")
    text = [r[0].split("\r\n") for r in frame.select(reports.citations_csv(F.col("c"))).collect()]
    assert text[0][1] == 'C1,"a, ""b""",,,,,1,2,x' and len(text[1]) == len(text[2]) == 2
    none = F.lit(None).cast("string")
    report = [r[0] for r in frame.select(reports.markdown_report(none, none, none, none, none, none, F.col("c"), none)).collect()]
    assert report[0].endswith("- [C1] a, \"b\" () | Authors:  | Citekey:  | DOI:  | Pages: 1-2") and report[2].endswith("- None") and "n/a (n/a)" in report[1]


def test_section_plan_builds_few_frames(spark, monkeypatch):
    made = []

    class Rows:
        schema = spark.range(1).selectExpr("id as k").schema

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            made.extend(run(iter([o.pd.DataFrame({"k": range(50), "text": ["a\n# References\nLee, A. 1999. X."] * 50})])))

    o.section_plan(Rows(), "k")
    assert len(made) == 1 and made[0].groupby("k").position.apply(list).map(lambda p: p == list(range(len(p)))).all() and made[0].k.nunique() == 50
