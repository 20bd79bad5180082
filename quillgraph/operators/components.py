"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations with partial (map-side) minima and two joins that AQE can split on skewed keys: a hash of the
node is a second join key, so that both sides are exchanged for the join and neither is an aggregate's own output. Minima are
merged, not broadcast: a compressed table passes for small. Rounds end in a table in the shared folder. No edge list, label
map or component ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.session import stage


def _with_min(arcs: DataFrame) -> DataFrame:
    """``arcs(u, v)`` with ``m``: the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hashed = F.xxhash64("u").alias("h")
    return arcs.select("*", hashed).join(least.select("*", hashed).hint("merge"), ["u", "h"]).drop("h")


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(arcs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_min(down)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(linked.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable type to ``(node, component)``: the least node reachable.

    Only nodes with a link to another node are returned; rows with a null end, self links and repeated rows change
    nothing; an empty table gives an empty table.
    """
    current = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        current = stage(_small_star(_large_star(current)), "stars")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
    )
