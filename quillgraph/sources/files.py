"""Readers of document files: listings, header checks, page text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.functions import text as tx
from quillgraph.sources.archives import opened


def list_files(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """(path, length, modified, stem, readable) of the files below a folder; ``readable``: a PDF by its first bytes, the only
    ones that are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "length", F.col("modificationTime").alias("modified"))

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_starts(x, b"%PDF") for x in b.column(0).to_pylist()])], names=[*b.schema.names, "readable"])

    seen = found.mapInArrow(sniff, "path string, length long, modified timestamp, readable boolean")
    return seen.select("path", "length", "modified", tx.path_stem(F.col("path")).alias("stem"), "readable")


def _starts(path: str, head: bytes) -> bool:
    try:
        with opened(path) as f:
            return f.read(len(head)) == head
    except OSError:
        return False


def read_plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page, line_no, line) of recognised text files: trimmed lines that aren't blank, all on page 1."""
    whole = spark.read.option("wholetext", True).text(path).select(F.regexp_replace(tx.path_stem(F.col("_metadata.file_path")), "\\.[A-Za-z0-9]+$", "").alias("stem"), "value")
    rows = whole.select("stem", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return rows.select("stem", F.lit(1).alias("page"), "line_no", F.trim(F.regexp_replace("line", "\r", "")).alias("line")).where("line <> ''")


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest (path, length, modified) doesn't hold as they are now."""
    return listing.join(manifest.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
