"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import chroma, clusters, decontaminate, licences, merkle, pii, quality, segmentations, sharding, simhash, substrings, token_counts, warc

MODULES = (simhash, substrings, pii, quality, decontaminate, segmentations, sharding, warc, licences, chroma, merkle, clusters, token_counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
