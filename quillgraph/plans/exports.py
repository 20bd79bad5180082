"""Reference fields, section plans, query rewrites and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillgraph.functions import references as r, reports
from quillgraph.operators import datasets as d, documents as o
from quillgraph.plans.tables import table

#: Templates and slots of the registered query.
TEMPLATES = (
    d.Template("overview", 14, "What is known about {topic}?", title_terms="{topic}", content_terms="{topic} overview"),
    d.Template("topic_in_place", 20, "How is {topic} studied in {place}?", title_terms="{topic} {place}", content_terms="{topic}"),
    d.Template("author_claim", 14, "What did {author} say about {topic} in {year}?", authors="{author}", years="{year}", content_terms="{topic} claim"),
    d.Template("method_topic", 16, "Which results has {method} given for {topic}?", title_terms="{topic}", content_terms="{method} {topic}"),
)
VOCABULARY = {
    "topic": ("maize farming", "rock art", "land use", "trade and exchange", "settlement"),
    "place": ("Utah", "Peru", "Kenya", "France", "Japan", "Brazil"),
    "author": ("Noel Morss", "Angela Linse", "Jan van der Berg"),
    "method": ("radiocarbon dating", "survey", "pollen analysis"),
    "year": ("1931", "1992", "2005"),
}
_RAW = ("Lee, A. B., Kim Park, and Jo Ng ", ". ", ". Press. doi:10.1234/AB.")


def _raw(spark, sf):
    """Benchmark passages as titles of raw references."""
    place, text = F.col("item_id").cast("string"), F.regexp_replace("text", r"[.0-9\n]+", " ")
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.lit(_RAW[0]), (1900 + F.col("item_id") % 120).cast("string"), F.lit(_RAW[1]), text, F.lit(_RAW[2]), place, F.lit(".")).alias("raw_text"))


def reference_fields(spark, sf):
    raw = F.col("raw_text")
    return _raw(spark, sf).select("item_id", r.year(raw).alias("year"), r.doi(raw).alias("doi"), F.md5(r.title(raw)).alias("title_md5"))


def reference_authors(spark, sf):
    parsed = o.parsed_references(_raw(spark, sf))
    return parsed.select("item_id", F.array_join("authors", "|").alias("authors"), F.array_join("author_tokens", "|").alias("tokens"))


def section_plan(spark, sf):
    """Documents between a title page and an appendix."""
    docs = table(spark, sf, "documents").withColumn("text", F.concat(F.lit("Contents\nOne .... 1\n# One\n"), "text", F.lit("\n# References\nLee, A. 1999. X.\nAppendix A\nlast")))
    return o.section_plan(docs, "doc_id").select("doc_id", "position", "kind", "start_line", "end_line")


def query_rewrites(spark, sf):
    return d.query_rewrites(table(spark, sf, "documents"), "doc_id", TEMPLATES, VOCABULARY)


def _reports(spark, sf):
    """Each turn as an answer that cites itself and the two turns before it."""
    turns = table(spark, sf, "conversations")
    cited = turns.withColumns({
        "citation_id": F.concat(F.lit("C"), "turn"), "article_title": F.col("role"), "article_year": (F.lit(2000) + F.col("turn")).cast("int"), "authors": F.array("role", F.lit('A "B" C')),
        "citekey": F.lit(None).cast("string"), "doi": F.lit("10.1/x"), "page_start": F.col("turn"), "page_end": F.col("turn"), "chunk_id": F.md5("text"),
    })
    w = Window.partitionBy("conv_id").orderBy("turn", "chunk_id").rowsBetween(-2, 0)
    return cited.withColumn("citations", F.collect_list(F.struct(*reports.CITATION_FIELDS)).over(w)).select("conv_id", "turn", "role", "text", "citations")


def report_markdown(spark, sf):
    text = reports.markdown_report(F.lit("why"), F.col("role"), F.size("citations"), F.lit(None), F.lit(None), F.col("text"), F.col("citations"), F.lit("2024-01-01"))
    return _reports(spark, sf).select("conv_id", "turn", F.md5(text).alias("report_md5"))


def report_csv(spark, sf):
    return _reports(spark, sf).select("conv_id", "turn", F.md5(reports.citations_csv(F.col("citations"))).alias("csv_md5"))


QUERIES = {f.__name__: f for f in (reference_fields, reference_authors, section_plan, query_rewrites, report_markdown, report_csv)}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _drawn(salt: str, n: int) -> str:
    return f"(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT % {n})"


def _chosen(field: str) -> str:
    upto, cases = 0, []
    for t in TEMPLATES:
        upto += t.weight
        text = getattr(t, field)
        for slot in VOCABULARY:
            text = text.replace(f"{{{slot}}}", f"' || {slot} || '")
        cases.append(f"WHEN r < {upto} THEN '{text}'")
    return f"CASE {' '.join(cases)} END"


_FIELDS = ("authors", "years", "title_terms", "content_terms")
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9''-]*')"
_ONCE = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i AND x NOT IN ('and', 'or', 'not')), ' ')"
_CITED = """c AS (SELECT *, 'C' || turn AS id, 2000 + turn AS y, md5(text) AS chunk FROM conversations),
v AS (SELECT conv_id, turn, role, text, count(*) OVER w AS n,
  string_agg('- [' || id || '] ' || role || ' (' || y || ') | Authors: ' || role || ', A "B" C | Citekey:  | DOI: 10.1/x | Pages: ' || turn || '-' || turn, chr(10)) OVER w AS md,
  string_agg(id || ',' || role || ',' || y || ',"' || role || '; A ""B"" C",,10.1/x,' || turn || ',' || turn || ',' || chunk || chr(13) || chr(10), '') OVER w AS csv
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, chunk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
SQL = {
    "reference_fields": r"""SELECT item_id, CAST(1900 + item_id % 120 AS INTEGER) AS year, '10.1234/ab.' || item_id AS doi,
  md5(substr(regexp_replace(trim(regexp_replace(regexp_replace(text, '[.0-9\n]+', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')), '^[ .,:;]+|[ .,:;]+$', '', 'g'), 1, 240)) AS title_md5 FROM benchmark""",
    "query_rewrites": f"""WITH s AS (SELECT doc_id, {_drawn("template", sum(t.weight for t in TEMPLATES))} AS r, {", ".join(f"({_list(v)})[{_drawn(k, len(v))} + 1] AS {k}" for k, v in VOCABULARY.items())} FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT doc_id, {_chosen("name")} AS template, {_chosen("question")} AS question, {", ".join(f"{_WORDS.format(_chosen(f))} AS {f}" for f in _FIELDS)} FROM s),
n AS (SELECT doc_id, template, question, {", ".join(f"{_ONCE.format(f)} AS {f}" for f in _FIELDS)}, row_number() OVER (PARTITION BY lower(question) ORDER BY doc_id) AS i FROM m)
SELECT doc_id, template, question, {" || ' | ' || ".join(f"'{f}: ' || CASE WHEN {f} = '' THEN 'none' ELSE {f} END" for f in _FIELDS)} AS directive,
  array_to_string(list_filter([{", ".join(_FIELDS)}], lambda x: x <> ''), ' ') AS compact_query FROM n WHERE i = 1""",
    "report_markdown": f"""WITH {_CITED} SELECT v.conv_id, v.turn, md5(array_to_string(['# Answer report', '', '- Generated: 2024-01-01', '- Question: why', '- Model: ' || role, '- Results: ' || coalesce(CAST(n AS VARCHAR), ''), '- Risk: n/a (n/a)', '', '## Answer', '', text, '', '## Used citations', '', coalesce(md, '- None')], chr(10))) AS report_md5
FROM v""",
    "report_csv": f"WITH {_CITED} SELECT v.conv_id, v.turn, md5('citation_id,article_title,article_year,authors,citekey,doi,page_start,page_end,chunk_id' || chr(13) || chr(10) || coalesce(csv, '')) AS csv_md5 FROM v",
}
