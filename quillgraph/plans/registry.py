"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from quillgraph.plans import documents, evidence, exports, graph, jobs, library, more, retrieval, stored, stream, training

MODULES = (retrieval, evidence, graph, stream, documents, more, exports, library, stored, jobs, training)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
