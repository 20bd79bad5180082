"""Reports of answers with their citations, as column expressions over one row per report."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Columns of exported citations, in order.
CITATION_FIELDS = ("citation_id", "article_title", "article_year", "authors", "citekey", "doi", "page_start", "page_end", "chunk_id")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _joined(names: Column, by: str) -> Column:
    return F.coalesce(F.array_join(names, by), F.lit(""))


def markdown_report(question: Column, model: Column, results: Column, risk: Column, score: Column, answer: Column, citations: Column, generated: Column) -> Column:
    """A Markdown report; ``citations`` is an array of structs with CITATION_FIELDS. Nulls are shown as blanks, a missing risk as n/a."""
    lines = F.transform(
        citations,
        lambda c: F.concat(
            F.lit("- ["), _text(c["citation_id"]), F.lit("] "), _text(c["article_title"]), F.lit(" ("), _text(c["article_year"]),
            F.lit(") | Authors: "), _joined(c["authors"], ", "), F.lit(" | Citekey: "), _text(c["citekey"]),
            F.lit(" | DOI: "), _text(c["doi"]), F.lit(" | Pages: "), _text(c["page_start"]), F.lit("-"), _text(c["page_end"]),
        ),
    )
    known = lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    head = [
        F.lit("# Answer report\n"), F.concat(F.lit("- Generated: "), _text(generated)), F.concat(F.lit("- Question: "), _text(question)),
        F.concat(F.lit("- Model: "), _text(model)), F.concat(F.lit("- Results: "), _text(results)),
        F.concat(F.lit("- Risk: "), known(risk), F.lit(" ("), known(score), F.lit(")\n")),
    ]
    return F.concat_ws("\n", *head, F.lit("## Answer\n"), F.concat(_text(answer), F.lit("\n")), F.lit("## Used citations\n"), F.when(F.size(citations) > 0, F.array_join(lines, "\n")).otherwise("- None"))


def citations_csv(citations: Column) -> Column:
    """The citations as CSV with a header; fields with commas, quotes or line ends are quoted, lines end in CR LF."""

    def field(value: Column) -> Column:
        return F.when(value.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    lines = F.transform(citations, lambda c: F.concat_ws(",", *[field(_joined(c[f], "; ") if f == "authors" else _text(c[f])) for f in CITATION_FIELDS]))
    return F.concat(F.lit(",".join(CITATION_FIELDS) + "\r\n"), F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\r\n"))), ""), F.lit("")))
