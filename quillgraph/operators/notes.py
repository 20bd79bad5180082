"""Notes of a catalogue that hold a document's Markdown, and the attachments they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as tx

LEAST_LENGTH = 120

def attachment_id(text: Column) -> Column:
    """The number in a line ``attachment_id = n``, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*attachment_id\s*=\s*(\d+)\s*$", 1), F.lit("")).try_cast("long")


def _sign(line: Column) -> Column:
    """What a line's beginning says of Markdown: heading, bullet, number, fence or table, or null."""
    # Up to three blanks may stand before a block; a table's row may stand anywhere.
    block = F.when(line.rlike("^ {4}"), F.lit("")).otherwise(F.ltrim(line))
    lead, rest = F.regexp_extract(block, "^([^ \t]+)[ \t]+[^ \t]", 1), F.trim(line)
    return (
        F.when(block.startswith("```"), "fence")
        .when((F.length(lead) <= 6) & (F.replace(lead, F.lit("#"), F.lit("")) == "") & (lead != ""), "heading")
        .when(lead.isin("-", "*", "+"), "bullet")
        .when(lead.endswith(".") & F.rtrim(lead, F.lit(".")).rlike("^[0-9]+$") & (F.length(lead) == F.length(F.rtrim(lead, F.lit("."))) + 1), "number")
        .when(rest.startswith("|") & rest.endswith("|") & (F.length(rest) >= 3), "table")
    )


def markdown_signs(text: Column) -> Column:
    """How many of the five signs of Markdown a text's lines show: headings, bullets, numbers, fences, table rows."""
    return F.size(F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r?\n"), _sign))))


def is_markdown_note(title: Column, text: Column, marker: str, hint: str) -> Column:
    """A note of 120 characters or more that has a marker line and an attachment id, or a hint in its title and two signs of
    Markdown. ``marker`` is what a marker line begins with; a version number follows it."""
    marked = F.coalesce(text, F.lit("")).rlike(rf"(?m)^\s*{marker}\d+\s*$") & attachment_id(text).isNotNull()
    hinted = F.lower(F.coalesce(title, F.lit(""))).contains(hint.lower()) & (markdown_signs(text) >= 2)
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) >= LEAST_LENGTH) & (marked | hinted)


def match_notes(attachments: DataFrame, notes: DataFrame, marker: str, hint: str) -> DataFrame:
    """(attachment_id, note_id, note_key, title, markdown): of each attachment the first Markdown note, its own notes before
    those of its parent, then by note id.

    ``attachments``: attachment_id, parent_id; ``notes``: note_id, note_key, parent_id, title, html. A parent's note that names
    another attachment isn't taken; notes without a key neither.
    """
    text = tx.html_text(F.col("html"))
    good = notes.where(F.trim(F.coalesce("note_key", F.lit(""))) != "").select("note_id", "note_key", F.col("parent_id").alias("owner"), "title", text.alias("markdown"))
    good = good.where(is_markdown_note(F.col("title"), F.col("markdown"), marker, hint)).withColumn("named", attachment_id(F.col("markdown")))
    own = attachments.select("attachment_id", F.col("attachment_id").alias("owner"), F.lit(0).alias("level"))
    above = attachments.where("parent_id > 0 and parent_id <> attachment_id").select("attachment_id", F.col("parent_id").alias("owner"), F.lit(1).alias("level"))
    met = own.unionByName(above).join(good, "owner").where((F.col("level") == 0) | F.col("named").isNull() | (F.col("named") == F.col("attachment_id")))
    place = F.row_number().over(Window.partitionBy("attachment_id").orderBy("level", "note_id"))
    return met.withColumn("_place", place).where("_place = 1").select("attachment_id", "note_id", "note_key", "title", "markdown")
