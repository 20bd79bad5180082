"""Edge tables of the literature graph: counts, look-ups, replacement, merging and cleaning.

Keys may be any type. Edge tables are plain frames; every operator returns the new table and leaves the old one as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def graph_stats(tables: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """One row with each table's number of rows. ``strict``: all are zero if one is empty."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    row = reduce(DataFrame.crossJoin, counts)
    if strict:
        full = reduce(Column.__and__, [F.col(n) > 0 for n in tables])
        row = row.select(*[F.when(full, F.col(n)).otherwise(F.lit(0)).alias(n) for n in tables])
    return row


def degree_counts(nodes: DataFrame, key: str, **edges: tuple[DataFrame, str]) -> DataFrame:
    """``nodes`` with the number of rows of each edge table that have the node in the named column; 0 where there are none."""
    out = nodes
    for name, (df, column) in edges.items():
        counts = df.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def ordered_names(edges: DataFrame, key: str, position: str, name: str, first: int) -> DataFrame:
    """(key, names): the names by position, the first ones only.

    Rows are ranked before they are collected: a key's array never holds more than ``first``, and tasks drop what is beyond.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(position, name))
    top = edges.select(key, position, name).withColumn("_place", place).where(F.col("_place") <= first)
    pairs = F.array_sort(F.collect_list(F.struct("_place", F.col(name))))
    return top.groupBy(key).agg(F.transform(pairs, lambda p: p[name]).alias("names"))


def first_distinct(edges: DataFrame, key: str, name: str, first: int) -> DataFrame:
    """(key, names): the first distinct names in order, for keys of any number of edges."""
    return ordered_names(edges.select(key, name).distinct().withColumn("_by", F.col(name)), key, "_by", name, first)


def replace_articles(stored: DataFrame, incoming: DataFrame, key: str = "article_id") -> DataFrame:
    """Everything of the incoming articles replaces what was stored of them."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def upsert_last(links: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key: the one with the greatest ordinal. Map-side, so a hot key costs a row for each task."""
    rest = [c for c in links.columns if c not in keys]
    return links.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("last")).select(*keys, "last.*")


def stale_edges(cites: DataFrame, supports: DataFrame) -> DataFrame:
    """Edges made from references (or corrections) that no reference supports any more; ``supports`` has src and dst."""
    derived = F.col("method").startswith("reference_") | (F.col("method") == "manual_correction_citekey")
    return cites.where(derived).join(supports.select("src", "dst"), ["src", "dst"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(edges.select(key), key, "left_anti")


def merge_nodes(edges: DataFrame, key: str, other: str, mapping: DataFrame, position: str | None = None) -> DataFrame:
    """``edges`` with ``mapping(old, new)`` applied to ``key``; one row per pair, with the least position."""
    moved = edges.join(mapping.select(F.col("old").alias(key), "new"), key, "left").withColumn(key, F.coalesce("new", key)).drop("new")
    return moved.groupBy(key, other).agg(F.min(position).alias(position)) if position else moved.select(key, other).distinct()


def merge_records(records: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Records whose keys map to one are one: the kept key's own value, else the first other (by key) that isn't blank."""
    rest = [c for c in records.columns if c != key]
    joined = records.join(mapping.select(F.col("old").alias(key), "new"), key, "left").withColumn("kept", F.coalesce("new", key))
    order = F.struct((F.col("kept") != F.col(key)).alias("o"), F.col(key).alias("k"))
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    # An unmerged key has one row, so this is one aggregation with map-side minima.
    return joined.groupBy(F.col("kept").alias(key)).agg(*[F.min_by(F.col(c), F.when(blank(c).isNotNull(), order)).alias(c) for c in rest])


def canonical_pick(groups: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group by the given order."""
    return groups.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_place = 1").drop("_place")
