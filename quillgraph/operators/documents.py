"""Table functions: one document in, many rows out. Documents are independent; a failed one gives its own failure row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillgraph.functions import documents as d, references as r

#: Rows of a frame that a table function gives.
FRAME = 10_000


def markdown_chunks(docs: DataFrame, key: str, text: str = "text", least: int = 120, target: int = 220, most: int = 360) -> DataFrame:
    """(key, chunk_index, text, heading_path, token_count, start_line, end_line) by Markdown heading."""
    if not 0 < least <= target <= most:
        raise ValueError("least, target and most must rise")
    source = docs.select(F.col(key), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, x in zip(f[key], f["text"], strict=True):
                if rows := d.markdown_chunks(x, least, target, most):
                    yield pd.DataFrame(rows).assign(chunk_index=range(len(rows)), **{key: k})

    kind = source.schema[key].dataType.simpleString()
    return source.mapInPandas(run, f"{key} {kind}, chunk_index int, text string, heading_path array<string>, token_count int, start_line int, end_line int")


def references(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, position, raw_text, method, confidence): entries of the reference sections, and failures as rows.

    Confidence is the spans' mean, five hundredths more where entries were continued, less for failures, from .35 to .98.
    """
    source = docs.select(F.col(key), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, x in zip(f[key], f["text"], strict=True):
                lines = (x or "").split("\n")
                spans = d.reference_spans(lines)
                if not spans:
                    continue
                entries, failures = d.split_entries([line for s in spans for line in lines[s["start_line"] : s["end_line"] + 1]])
                methods = {s["method"] for s in spans}
                joined = sum(len(line.split()) > 0 for s in spans for line in lines[s["start_line"] : s["end_line"] + 1]) > len(entries)
                mean = sum(s["confidence"] for s in spans) / len(spans)
                sure = min(0.98, max(0.35, mean + 0.05 * joined - 0.05 * min(3, len(failures))))
                rows = [("entry", i, e) for i, e in enumerate(entries)] + [("failure", i, e) for i, e in enumerate(failures)]
                if rows:
                    out = pd.DataFrame(rows, columns=["kind", "position", "raw_text"])
                    yield out.assign(method="multi_section" if len(methods) > 1 else methods.pop(), confidence=sure, **{key: k})

    kind = source.schema[key].dataType.simpleString()
    return source.mapInPandas(run, f"{key} {kind}, kind string, position int, raw_text string, method string, confidence double")


def section_plan(docs: DataFrame, key: str, text: str = "text", least: int = 24) -> DataFrame:
    """(key, position, kind, heading, start_line, end_line): typed sections of every document; none for null texts."""
    source = docs.select(F.col(key), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: list[dict] = []
            for k, x in zip(f[key], f["text"], strict=True):
                found += [{**s, "position": i, key: k} for i, s in enumerate(d.sections(x.split("\n") if x else [], least))]
                # A frame for each document would take longer than its sections.
                if len(found) >= FRAME:
                    yield pd.DataFrame(found)
                    found = []
            if found:
                yield pd.DataFrame(found)

    kind = source.schema[key].dataType.simpleString()
    return source.mapInPandas(run, f"{key} {kind}, position int, kind string, heading string, start_line int, end_line int")


def parsed_references(entries: DataFrame, raw: str = "raw_text") -> DataFrame:
    """``entries`` with the fields of each reference: authors, author_tokens, year, title and doi.

    Null and blank references have empty arrays, an empty title, and null for the rest. Columns of these names are replaced.
    """
    named = entries.withColumn("authors", r.author_names(F.coalesce(F.col(raw), F.lit(""))))
    return named.withColumns({"author_tokens": r.family_names(F.col("authors")), "year": r.year(F.col(raw)), "title": r.title(F.col(raw)), "doi": r.doi(F.col(raw))})
