"""Training sets for parsers of references, and times, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import times
from quillgraph.operators import documents as o, training_sets as ts
from quillgraph.plans import tables as t
from quillgraph.plans.library import SQL as _LIBRARY
from quillgraph.plans.tables import table


def _recognised(spark, sf):
    """Documents as recognised pages below a line of references, as ``recognised_references`` has them."""
    lines = F.regexp_replace(F.col("text"), r"(\S+\s+\S+\s+\S+)\s+", "$1\nSmith, A\n1998 title ")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("intro\nReferences\n"), lines).alias("text"))


def reference_split_set(spark, sf):
    """A tenth of a thousand bibliographies of 5 to 40 references, none of those of an older set."""
    docs = _recognised(spark, sf)
    rows = ts.reference_split_rows(docs, "doc_id", 100, least=5, most=40, seed=11, excluded=docs.where("doc_id % 5 = 0").select("doc_id"))
    return rows.select("doc_id", F.size("references").alias("n"), "start_line", F.md5(F.array_join("references", "|")).alias("references_md5"))


def parse_samples(spark, sf):
    """Articles as citations of the article before them, with the catalogue's fields where it has the title."""
    a = t.articles(spark, sf)
    k = F.col("article_id")
    cites = a.select(F.floor(k / 7).cast("long").alias("doc"), (k % 7).alias("place"), F.concat(F.lit(" "), "author", F.lit(". "), "title").alias("raw_text"), "title", F.col("title").alias("title_guess"), "year", F.when(k % 3 == 0, F.concat(F.lit("10.1000/C"), k)).alias("doi"), F.array("author").alias("author_tokens"), F.lit("").alias("type_guess"))
    records = a.where("article_id % 2 = 0").select("title", k.alias("place"), (F.col("year") + 1).alias("year"), F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/R"), k)).alias("doi"), F.array(F.concat(F.lit("Ann "), "author")).alias("authors"), F.lit("book").alias("type"))
    rows = ts.parse_sample_rows(cites.drop("title"), records, "doc", "place", 5)
    x = F.col("target")
    return rows.select("doc", "place", "origin", x["title"].alias("title"), x["year"].alias("year"), F.coalesce(x["doi"], F.lit("")).alias("doi"), F.array_join(x["author_tokens"], ",").alias("tokens"), F.coalesce(x["type"], F.lit("")).alias("type"))


def section_training_set(spark, sf):
    """The section plans of all documents that end in references; those of every tenth are set by hand."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\nReferences\nLee, A. 2001. Towns.\nKim, B. 2002. Pots.")).alias("text"))
    last = F.size(F.split("text", "\n")) - 1
    spans = F.array(F.struct(F.lit("body").alias("kind"), F.lit(0).alias("start_line"), (last - 3).alias("end_line")), F.struct(F.lit("references").alias("kind"), (last - 2).alias("start_line"), last.alias("end_line")))
    overrides = docs.where("doc_id % 10 = 0").select("doc_id", F.inline(spans))
    rows = ts.section_rows(docs, o.section_plan(docs, "doc_id"), "doc_id", overrides=overrides, seed=3)
    return rows.select("doc_id", F.size("sections").alias("n"), "reference_start", "overridden", F.size("messages").alias("messages"), "split")


def event_times(spark, sf):
    """Events' times as ISO text and milliseconds."""
    return table(spark, sf, "events").select("event_id", times.iso_utc(F.col("ts").cast("timestamp_ntz"), zoned=False).alias("iso"), times.epoch_millis(F.col("ts").cast("timestamp_ntz"), zoned=False).alias("millis"))


QUERIES = {f.__name__: f for f in (reference_split_set, parse_samples, section_training_set, event_times)}
_CTES, _ = _LIBRARY["recognised_references"].rsplit("\nSELECT doc_id,", 1)
_NORM = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')".format
SQL = {
    "reference_split_set": f"""{_CTES}, s AS (SELECT doc_id, count(*) AS n, md5(string_agg(raw, '|' ORDER BY entry)) AS references_md5 FROM u WHERE doc_id % 5 <> 0 GROUP BY 1 HAVING count(*) BETWEEN 5 AND 40)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(2 AS INTEGER) AS start_line, references_md5 FROM (SELECT *, row_number() OVER (ORDER BY md5('11:' || doc_id)) AS i FROM s) WHERE i <= 100""",
    "parse_samples": f"""WITH {t.ARTICLES}, r AS (SELECT {_NORM("title")} AS k, arg_min(title, article_id) AS title, arg_min(year, article_id) AS year, min(article_id) AS id, arg_min(author, article_id) AS author FROM articles WHERE article_id % 2 = 0 AND {_NORM("title")} <> '' GROUP BY 1),
c AS (SELECT article_id // 7 AS doc, article_id % 7 AS place, trim(' ' || a.author || '. ' || a.title) AS raw, a.*, r.id AS rid, r.title AS rt, r.year AS ry, r.author AS ra FROM articles a LEFT JOIN r ON r.k = {_NORM("a.title")} AND r.k <> ''),
f AS (SELECT doc, place, raw, CASE WHEN rid IS NULL THEN 'heuristic_citation' ELSE 'catalogue_title' END AS origin, CASE WHEN rid IS NULL THEN coalesce(nullif(trim(title), ''), substr(raw, 1, 180)) ELSE coalesce(nullif(trim(rt), ''), title) END AS title,
  CASE WHEN rid IS NULL THEN year ELSE ry + 1 END AS year, coalesce(CASE WHEN rid % 4 = 0 THEN '10.1000/r' || rid END, CASE WHEN article_id % 3 = 0 THEN '10.1000/c' || article_id END, '') AS doi,
  CASE WHEN rid IS NULL THEN author ELSE regexp_extract_all(lower(ra), '[a-z0-9]+')[-1] END AS tokens, CASE WHEN rid IS NULL THEN '' ELSE 'book' END AS type FROM c),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lower(raw), lower(title), year, doi ORDER BY doc, place) = 1)
SELECT doc, place, origin, title, year, doi, tokens, type FROM o QUALIFY row_number() OVER (PARTITION BY doc ORDER BY place) <= 5""",
    "event_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso, epoch_us(ts) // 1000 AS millis FROM events",
}
