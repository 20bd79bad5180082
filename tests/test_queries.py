"""Every registered query of the library proper against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillgraph.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, db, name):
    found = registry.queries()[name](spark, sf)
    rows = found.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in ("citation_resolution", "markdown_chunks", "reference_entries", "reference_authors", "section_plan", "match_probability", "probable_merges", "fuzzy_split_scores", "reference_blocks", "section_training_set") and rows
        return
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert plain([tuple(r) for r in rows], found.columns) == plain(want.fetchall(), names)
