"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniform permutation, the number of a partition's rows that go to each shard is multivariate hypergeometric. So the
counts are drawn first: a matrix of partitions by shards whose rows add up to the partitions' sizes and whose columns to the
shards' (at most one apart). Each partition then permutes its own list of destinations, rows are exchanged, and each shard
permutes what it got (Bacher, Bodini, Hollender and Lumbroso, 2015). All permutations are uniform and the sizes exact, with
one exchange of the rows.

A partition is a run of ``block`` rows of a file, so that counts, draws and places don't depend on how a scan is split or
repeated. The driver draws the counts of groups of ``GROUP`` partitions; each group's own rows of the matrix are drawn in a
task, given the group's: a hypergeometric draw in two steps is one. A shard's second permutation sorts by a hash; it is done in buckets of hash ranges, so that no task holds a shard.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgraph.llm._places import placed
from quillgraph.session import stage

SHARDS = 24
BLOCK = 1 << 16
BUCKET = 1 << 14
GROUP = 1024
#: Matrix cells that are broadcast; beyond, the matrix is joined like any table.
BROADCAST_CELLS = 1 << 20


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart, the larger ones first."""
    return rows // shards + (np.arange(shards) < rows % shards)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones in a sample without replacement. numpy ends at 10**9; beyond, by the ratio of uniforms (Stadlober, 1990)."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    whole, fewer, m = good + bad, min(good, bad), min(sample, good + bad - sample)
    if not fewer or not m:
        few = 0
    else:
        share = fewer / whole
        centre, spread = m * share + 0.5, math.sqrt((whole - m) * m * share * (1 - share) / (whole - 1) + 0.5)
        log = lambda x: math.lgamma(x + 1) + math.lgamma(fewer - x + 1) + math.lgamma(m - x + 1) + math.lgamma(whole - fewer - m + x + 1)
        peak, end = log((m + 1) * (fewer + 1) // (whole + 2)), min(min(m, fewer) + 1, centre + 16 * spread)
        while True:
            x, y = rng.random(), rng.random()
            few = centre + (2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)) * (y - 0.5) / x if x else -1.0
            if 0 <= few < end and 2 * math.log(x) <= peak - log(math.floor(few)):
                break
        few = math.floor(few)
    taken = m - few if good > bad else few
    return taken if m == sample else good - taken


def communication_matrix(sources: np.ndarray, targets: np.ndarray, *seed: int) -> np.ndarray:
    """Counts by source and target with the given sums, as a uniform permutation would have them."""
    rng, left = np.random.default_rng([*seed, 1]), targets.astype(np.int64).copy()
    out = np.zeros((len(sources), len(targets)), np.int64)
    for i, n in enumerate(sources.tolist()):
        rest = int(left.sum())
        for j, has in enumerate(left.tolist()):
            rest -= has
            out[i, j] = _hypergeometric(rng, has, rest, n) if n else 0
            n -= int(out[i, j])
        left -= out[i]
    return out


@lru_cache(maxsize=8)
def _destinations(seed: int, block: int, counts: tuple[int, ...]) -> np.ndarray:
    out = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    np.random.default_rng([seed, 2, block]).shuffle(out)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 0, block: int = BLOCK, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot``, the row's place in its shard, without gaps.

    Every row has a place of its own: nulls and repeated rows are rows like any other, and no column is read for it. Columns
    named ``shard`` or ``slot`` are replaced. With fewer rows than shards, the last shards are empty. The same files, seed,
    ``block`` and ``group`` give the same shuffle.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    source, files = placed(docs.select(*[f"`{c}`" for c in names]), whole=True)
    sizes = files.where("rows > 0").orderBy("file").toPandas()
    blocks = -(-sizes["rows"].to_numpy(np.int64) // block)
    first = np.cumsum(blocks) - blocks
    # The last block of each file takes what is left.
    held = np.full(int(blocks.sum()), block, np.int64)
    held[first + blocks - 1] = sizes["rows"].to_numpy(np.int64) - (blocks - 1) * block
    n, groups = int(held.sum()), np.add.reduceat(held, np.arange(0, len(held), group)) if len(held) else np.zeros(0, np.int64)
    shares = communication_matrix(groups, shard_sizes(n, shards), seed)
    given = spark.createDataFrame([(g, m.tolist()) for g, m in enumerate(shares)], "group long, share array<long>")
    listed = spark.createDataFrame(pd.DataFrame({"file": sizes["file"].astype(str), "first": first, "last": blocks - 1, "rows": sizes["rows"].astype("int64")}), "file string, first long, last long, rows long")
    cut = listed.select("file", "first", "last", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"))
    cut = cut.select("file", "block", (F.col("first") + F.col("block")).alias("number"), F.when(F.col("block") < F.col("last"), F.lit(block)).otherwise(F.col("rows") - F.col("last") * block).cast("long").alias("size"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        counts = communication_matrix(rows["size"].to_numpy(), np.array(rows["share"].iloc[0]), seed, 3, int(rows["group"].iloc[0]))
        return pd.DataFrame({"file": rows["file"], "block": rows["block"], "number": rows["number"], "counts": counts.astype(np.int32).tolist()})

    drawn = cut.withColumn("group", F.floor(F.col("number") / group)).join(given, "group").groupBy("group").applyInPandas(draw, "file string, block long, number long, counts array<int>")
    cells = stage(drawn, "matrix")
    if len(held) * shards <= BROADCAST_CELLS:
        cells = F.broadcast(cells)

    @F.pandas_udf("int")
    def destination(number: pd.Series, offset: pd.Series, counts: pd.Series) -> pd.Series:
        out = np.zeros(len(number), np.int32)
        numbers, offsets = number.to_numpy(), offset.to_numpy()
        for b in np.unique(numbers):
            rows = np.flatnonzero(numbers == b)
            out[rows] = _destinations(seed, int(b), tuple(counts.iloc[rows[0]]))[offsets[rows]]
        return pd.Series(out)

    buckets = F.greatest(F.lit(1), F.ceil(F.lit(n / shards / bucket))).cast("long")
    dealt = (
        source.withColumn("block", F.floor(F.col("at") / block).cast("long"))
        .join(cells, ["file", "block"])
        .withColumn("offset", (F.col("at") - F.col("block") * block).cast("int"))
        .withColumn("shard", destination("number", "offset", "counts"))
        .withColumn("noise", F.xxhash64(F.lit(seed), F.lit("second"), "number", "offset"))
        .withColumn("bucket", F.shiftright(F.shiftrightunsigned("noise", 33) * buckets, 31).cast("int"))
    )
    held = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy(F.shiftrightunsigned("noise", 1), "number", "offset")
    ranked = dealt.select(*[f"c{i}" for i in range(len(names))], "shard", "bucket", F.row_number().over(order).alias("rank"))
    return ranked.join(starts, ["shard", "bucket"]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot")
    )


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of equal size, with its slot there."""
    shuffled = shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    return shuffled.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op1_shuffle_shards": op1_shuffle_shards}
SQL: dict[str, str] = {}
