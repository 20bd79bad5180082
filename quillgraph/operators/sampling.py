"""Samples and splits of an exact size, and a curriculum composed of tiers.

Rows are ordered by a digest of seed and key, so any engine and any partitioning draws the same ones. Exactly n rows are taken
without a sort of them all: digests are counted by their first digits, the count that passes n is found by running sums, and
only rows of that one prefix are counted or ranked further.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.operators.datasets import dedupe_by_priority, replicate
from quillgraph.session import stage

#: Hexadecimal digits of a step: 65,536 counts at most reach the driver.
DIGITS = 4
#: Rows of one prefix that a window ranks.
RANKED = 50_000


def draw_order(key: Column, seed: int) -> Column:
    """The digest that rows are drawn by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def exact_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The n rows that come first by ``draw_order``; all if there are fewer, none for n below 1.

    Rows of equal keys have equal digests: which of them are taken at the edge is open unless the whole rows are equal.
    """
    if n < 1:
        return rows.limit(0)
    digest, prefix, left, taken = draw_order(F.col(key), seed), "", n, F.lit(False)
    while True:
        inside = rows.where(digest.startswith(prefix)) if prefix else rows
        at = len(prefix)
        counts = sorted((r.p, r.n) for r in inside.groupBy(F.substring(digest, at + 1, DIGITS).alias("p")).agg(F.count("*").alias("n")).collect())
        for p, held in counts:
            if held >= left:
                break
            left -= held
        else:
            return rows
        taken = taken | (digest.startswith(prefix) & (F.substring(digest, at + 1, DIGITS) < p))
        prefix += p
        if held == left:
            return rows.where(taken | digest.startswith(prefix))
        if held <= RANKED or len(prefix) == 32:
            break
    edge = rows.where(digest.startswith(prefix))
    if held <= RANKED:
        # One prefix's rows, few of them, are ranked in one task.
        edge = edge.withColumn("_place", F.row_number().over(Window.orderBy(digest, F.col(key).cast("string")))).where(F.col("_place") <= left).drop("_place")
    else:
        edge = edge.limit(left)
    return rows.where(taken).unionByName(edge)


def eval_size(n: int, share: float) -> int:
    """Rows for evaluation of n: the share, half at most, rounded half to even; of eight rows or more at least one for either
    side, of fewer never all."""
    size = round(n * max(0.0, min(0.5, share)))
    return max(1, min(n - 1, size)) if n >= 8 else max(0, min(n - 1, size))


def exact_split(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``rows`` with ``split``: exactly ``eval_size`` of them eval, the others train. Keys should not repeat."""
    chosen = exact_sample(rows.select(key), eval_size(rows.count(), share), key, seed).select(F.col(key).alias("_key")).withColumn("_eval", F.lit(True))
    return rows.join(chosen, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("split", F.when(F.col("_eval"), "eval").otherwise("train")).drop("_key", "_eval")


def curriculum(examples: DataFrame, key: str, tier: str, task: str, priority: Mapping[str, int], stages: Mapping[str, tuple[Mapping[str, int], Mapping[str, int], int]], share: float, seed: int = 0) -> DataFrame:
    """(key, tier, task, split, stage, copy, draw): the rows of each training stage, and of evaluation.

    Of examples with one key the tier of the highest ``priority`` stays, then the first task. Each tier is split on its own, exactly. A stage has
    weights by tier and by task (1 if not named) and the most rows it may have (0: any number): a training row comes once for
    each unit of their product, tiers without a weight not at all. Evaluation rows come once, as stage ``eval``. ``draw``
    gives the order of a stage's rows.
    """
    rank = F.coalesce(*[F.when(F.col(tier) == t, F.lit(p)) for t, p in priority.items()], F.lit(0))
    kept = stage(dedupe_by_priority(examples.select(key, tier, task), key, rank.desc(), F.col(tier), F.col(task)), "examples")
    split = None
    for name in sorted(r[0] for r in kept.select(tier).distinct().where(F.col(tier).isin(*priority)).collect()):
        part = exact_split(kept.where(F.col(tier) == name), key, share, seed + len(name))
        split = part if split is None else split.unionByName(part)
    if split is None:
        split = kept.limit(0).withColumn("split", F.lit("train"))
    split = stage(split, "split")
    out = split.where("split = 'eval'").withColumns({"stage": F.lit("eval"), "copy": F.lit(1)})
    for name, (tiers, tasks, most) in stages.items():
        pick = lambda c, weights, other: F.coalesce(*[F.when(F.col(c) == k, F.lit(w)) for k, w in weights.items()], F.lit(other))
        weight = F.greatest(F.lit(0), pick(tier, tiers, 0)) * F.greatest(F.lit(1), pick(task, tasks, 1))
        rows = replicate(split.where("split = 'train'").withColumn("_weight", weight), F.col("_weight")).drop("_weight").withColumn("stage", F.lit(name))
        if most > 0:
            named = rows.withColumn("_row", F.concat_ws(":", key, "copy"))
            rows = exact_sample(named, most, "_row", seed + len(name)).drop("_row")
        out = out.unionByName(rows)
    return out.withColumn("draw", draw_order(F.concat_ws(":", "stage", key, "copy"), seed))
