"""Document table functions over the driver's tables; their rules are no SQL, so tests hold them against literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import documents as d
from quillgraph.plans.tables import table


def markdown_chunks(spark, sf):
    """Pages as notes: headings become Markdown, the rest plain text."""
    pages = table(spark, sf, "pages").withColumn("text", tx.html_text(F.regexp_replace(F.regexp_replace("html", "(?i)<h([1-3])[^>]*>", "\n# "), "(?i)</h[1-3]>", "\n")))
    return d.markdown_chunks(pages, "page_id", least=20, target=60, most=90).select("page_id", "chunk_index", "token_count", F.md5("text").alias("text_md5"))


def reference_entries(spark, sf):
    """Benchmark passages as the references of documents."""
    docs = table(spark, sf, "benchmark").withColumn("text", F.concat(F.lit("intro\n# References\n[1] Name, A. 1999. "), F.regexp_replace("text", "\n", "\n[2] Other, B. 2001. ")))
    return d.references(docs, "item_id").select("item_id", "kind", "position", F.md5("raw_text").alias("text_md5"), "method")


QUERIES = {f.__name__: f for f in (markdown_chunks, reference_entries)}
SQL: dict[str, str] = {}
