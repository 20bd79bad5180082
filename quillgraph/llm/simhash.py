"""SimHash near-duplicate classes by covering locality-sensitive hashing.

A fingerprint's covering masks (Pagh, 2016) come from a map of bit positions to vectors of r + 1 bits: for each non-zero
vector v the mask keeps the positions whose vector has an odd product with v. Two fingerprints that differ in at most r
bits agree under one of the 2**(r + 1) - 1 masks at least, so equality under a mask finds every pair: no pair within the
radius is lost and none needs luck.

Fingerprints are made distinct before any pairing, so copies cost nothing. Within a bucket no pairs are listed either: a
breadth-first search over the bucket yields a spanning forest of its links. A bucket beyond ``block`` fingerprints is cut
into blocks and each pair of blocks is searched by a task of its own, so no task holds more than two blocks.

A wide radius would need too many masks. There the fingerprint is covered in ``parts`` of equal width: of r differing bits
one part holds r / parts at most, so the masks of that smaller radius over each part lose no pair either. Their keys are
shorter and meet by chance more often, so a second word of 64 bits goes along and decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillgraph.llm._words import mix, words
from quillgraph.operators.components import connected_components
from quillgraph.session import stage

RADIUS = 4
BLOCK = 1 << 16
LINKS = 1 << 20


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 11) -> list[int]:
    """2**(radius + 1) - 1 masks; any ``radius`` positions are all left out by one mask at least.

    Vectors are dealt evenly, so masks keep about half of the positions. Where there are more vectors than positions those
    of the upper half come first: each mask keeps half of them (a first-order Reed-Muller code) or, one mask, all. With the
    lower half one mask would keep a position or none, and its keys would hold half of all points.
    """
    size = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(size - 1 - np.arange(bits) % (size - 1))
    return [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") & 1) for v in range(1, size)]


def part_masks(radius: int, parts: int) -> list[int]:
    """Masks over each of ``parts`` of 64 bits; two words that differ in ``radius`` bits or fewer agree under one at least."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [m << lo for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) for m in covering_masks(radius // parts, hi - lo, 11 + i)]


def _majority(h: np.ndarray, at: np.ndarray, runs: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > runs[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _fingerprints(column: pa.Array, width: int, words_out: int = 1) -> np.ndarray:
    """A row of ``words_out`` words of 64 bits for each text; the first takes bits of the shingle's XXH64, others of its mix."""
    out = np.zeros((len(column), words_out), np.uint64)
    for w in words(column, lower=True):
        counts = np.diff(w.first)
        if not counts.any():
            continue
        keep = np.zeros(len(w.data) + 1, np.int8)
        keep[w.start] += 1
        keep[w.end] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        gaps = w.end[w.end < len(w.data)]
        gaps = gaps[~keep[gaps]]
        data = w.data.copy()
        data[gaps] = 32
        keep[gaps] = True
        # Rows may touch without a separator: place words by their lengths plus the blanks that are kept.
        place = np.cumsum(keep)
        start, end = place[w.start] - 1, place[w.end - 1]
        text = data[keep].tobytes()
        runs = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
        row = np.repeat(np.arange(len(counts)), runs)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + w.first[row]
        last = np.minimum(begin + width, w.first[row + 1]) - 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(text[a:b], 42) for a, b in zip(start[begin].tolist(), end[last].tolist(), strict=True)), np.uint64, len(row))
        some = np.flatnonzero(counts)
        at = (np.cumsum(runs) - runs)[some]
        for i in range(words_out):
            out[w.lo + some, i] = _majority(mix(h + np.uint64(i)) if i else h, at, runs[some])
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fingerprint", second: str | None = None) -> DataFrame:
    """``docs`` without its text and with a 64-bit fingerprint (a signed long with the same bits), and a second one on demand.

    Null and blank texts have fingerprint zero; fewer than ``width`` words make one shingle. Other columns stay as they
    are, but for those that are named ``out`` or ``second``, which are replaced.
    """
    made = [out] if second is None else [out, second]
    others = [c for c in docs.columns if c not in (text, *made)]
    source = docs.select(*[f"`{c}`" for c in (*others, text)])
    schema = StructType([*source.schema.fields[:-1], *[StructField(c, LongType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _fingerprints(b.column(len(others)), width, len(made)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *[pa.array(np.ascontiguousarray(v)) for v in values.T]], names=[*others, *made])

    return source.mapInArrow(run, schema)


def _spanning_links(points: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (node, its group's first) of a forest that spans each group of points within ``radius`` of one another."""
    left, ends, heads = points, [], []
    while len(left) > 1:
        head, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                ends.append(found)
                heads.append(np.full(len(found), head))
                frontier.extend(found)
    return ends, heads


def _search(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames are sorted by the group's columns; a group may go on in the next frame."""
        rest: pd.DataFrame | None = None

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            keys = frame[["m", "key", "i", "j"]].to_numpy()
            points = frame["fp"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(points)]])
            ends, heads = [], []
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            a, b = points[two], points[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            ends.append(a[near])
            heads.append(b[near])
            for k in np.flatnonzero(sizes > 2):
                e, h = _spanning_links(points[bounds[k] : bounds[k + 1]], radius)
                ends += e
                heads += h
            return pd.DataFrame({"u": np.concatenate(ends).view(np.int64), "v": np.concatenate(heads).view(np.int64)})

        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            if frame.empty:
                continue
            last = (frame[["m", "key", "i", "j"]] == frame[["m", "key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            cut = len(frame) - int(last.sum())
            if cut:
                yield links(frame.iloc[:cut])
            rest = frame.iloc[cut:]
        if rest is not None and len(rest):
            yield links(rest)

    return run


def near_links(points: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct ``points(fp)`` to links (u, v) that span every group of points within ``radius`` bits of one another."""
    spark = points.sparkSession
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(radius)])
    keyed = points.select("fp", F.posexplode(masks).alias("m", "mask")).select("fp", "m", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # A hash as a further join key: both sides get exchanges of their own, so that a key of very many fingerprints can be split.
    hashed = F.xxhash64("m", "key").alias("h")
    shared = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1").select("*", hashed)
    # Spark sizes these rows as if no mask had multiplied them, so they pass for small; they are merged.
    met = keyed.select("*", hashed).join(shared.hint("merge"), ["m", "key", "h"]).select("fp", "m", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block b of a large bucket goes to each pair of blocks that has it; with one block that is (0, 0).
    dealt = met.withColumn("b", own).select(
        "fp", "m", "key",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))).alias("p"),
    ).select("fp", "m", "key", "p.i", "p.j")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "m", "key", "i", "j").sortWithinPartitions("m", "key", "i", "j")
    return ordered.mapInPandas(_search(radius), "u long, v long")


def _pairs_near(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, radius: int, wide: int) -> np.ndarray:
    first = np.bitwise_count(a ^ c)
    return (first <= radius) & (first.astype(np.int16) + np.bitwise_count(b ^ d) <= wide)


def _bucket_links(key: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(one, other): rows that are linked, so that each bucket's near rows hang together. ``key`` is sorted.

    Buckets of up to 8 rows compare by shifts, of up to 512 by a table of all pairs; larger ones are searched breadth first.
    """
    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    sizes = np.diff(bounds)
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(np.repeat(sizes <= 8, sizes))
    for s in range(1, min(8, len(small))):
        x, y = small[:-s], small[s:]
        same = key[x] == key[y]
        x, y = x[same], y[same]
        near = _pairs_near(a[x], b[x], a[y], b[y], radius, wide)
        ones.append(x[near])
        others.append(y[near])
    for k in np.flatnonzero((sizes > 8) & (sizes <= 512)):
        lo, hi = bounds[k], bounds[k + 1]
        p, q = a[lo:hi], b[lo:hi]
        near = _pairs_near(p[:, None], q[:, None], p, q, radius, wide)
        before = np.tril(near, -1)
        rows = np.flatnonzero(before.any(axis=1))
        if len(rows):
            # Of the near rows before one, those that are near its first are linked through that one already.
            head = before[rows].argmax(axis=1)
            need = before[rows] & ~near[head]
            need[np.arange(len(rows)), head] = True
            x, y = np.nonzero(need)
            ones.append(rows[x] + lo)
            others.append(y + lo)
    for k in np.flatnonzero(sizes > 512):
        left = np.arange(bounds[k], bounds[k + 1])
        while len(left) > 1:
            head, frontier, left = left[0], [left[0]], left[1:]
            while frontier and len(left):
                f = frontier.pop()
                near = _pairs_near(a[left], b[left], a[f], b[f], radius, wide)
                if near.any():
                    found, left = left[near], left[~near]
                    ones.append(found)
                    others.append(np.full(len(found), head))
                    frontier.extend(found)
    return np.concatenate(ones), np.concatenate(others)


def _search_wide(radius: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, a, b, label) sorted by key; a bucket may go on in the next batch. Rows of one label are linked already."""
        rest = np.zeros((4, 0), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            one, other = _bucket_links(rows[0], rows[1].view(np.uint64), rows[2].view(np.uint64), radius, wide)
            news = (rows[3][one] != rows[3][other]) | (rows[3][one] == 0)
            one, other = one[news], other[news]
            ends = [rows[1][one], rows[2][one], rows[1][other], rows[2][other]]
            return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["ua", "ub", "va", "vb"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if rows.shape[1] else 0
            if cut:
                yield links(np.ascontiguousarray(rows[:, :cut]))
            rest = rows[:, cut:]
        if rest.shape[1]:
            yield links(np.ascontiguousarray(rest))

    return run


_ENDS = "ua long, ub long, va long, vb long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task (ua, ub, va, vb) to as few that connect the same points: each to the least of its group."""
    table = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in ("ua", "ub", "va", "vb")]))
    columns = [c.to_numpy() for c in table.columns]
    if not len(columns[0]):
        return
    pairs = np.empty(2 * len(columns[0]), [("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = np.concatenate([columns[0], columns[2]]), np.concatenate([columns[1], columns[3]])
    nodes, at = np.unique(pairs, return_inverse=True)
    u, v = at[: len(columns[0])], at[len(columns[0]) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    ends = [nodes["a"][moved], nodes["b"][moved], nodes["a"][label[moved]], nodes["b"][label[moved]]]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e)) for e in ends], names=["ua", "ub", "va", "vb"])


def _wide_round(points: DataFrame, masks: list[int], radius: int, wide: int, block: int) -> DataFrame:
    """Links (u, v) found under some masks for ``points(a, b, label)``; none between points of one label, unless it is 0."""
    spark = points.sparkSession
    column = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    keyed = points.select("a", "b", "label", F.posexplode(column).alias("m", "mask")).select("a", "b", "label", F.xxhash64("m", F.col("a").bitwiseAND(F.col("mask"))).alias("key"))
    # Buckets that may be beyond a block, by one point in 64. This only weighs work: a bucket that isn't here is one group.
    share = 64
    some = points.where(F.pmod(F.xxhash64(F.lit("weigh"), "a", "b"), F.lit(share)) == 0).select("a", F.posexplode(column).alias("m", "mask"))
    heavy = some.groupBy(F.xxhash64("m", F.col("a").bitwiseAND(F.col("mask"))).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > block // share)
    heavy = stage(heavy.select("key", F.ceil(2 * share * F.col("n") / block).cast("int").alias("blocks")), "heavy")
    if not heavy.isEmpty():
        own = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
        # Block i of a heavy bucket goes to each pair of blocks that has it.
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(o, own), F.greatest(o, own)))
        keyed = keyed.join(heavy, "key", "left").select("a", "b", "label", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.select("key", "a", "b", "label").repartition(partitions, "key").sortWithinPartitions("key")
    found = stage(ordered.mapInArrow(_search_wide(radius, wide), _ENDS).distinct(), "links")
    # Each mask leaves links of its own within a large group. Tasks of a bounded number of links reduce them to forests.
    found = found.repartition(-(-found.count() // LINKS) or 1).mapInArrow(_forest, _ENDS)
    return stage(found.select(F.struct(F.col("ua").alias("a"), F.col("ub").alias("b")).alias("u"), F.struct(F.col("va").alias("a"), F.col("vb").alias("b")).alias("v")), "forest")


def near_links_wide(points: DataFrame, radius: int, parts: int, wide: int, block: int = BLOCK, first: int = 4) -> DataFrame:
    """Distinct ``points(a, b)`` to links (u, v) of structs (a, b) that span every group of near points.

    Two points are near where ``a`` differs in ``radius`` bits at most, and both words together in ``wide``. The first few
    masks of each part go before all others: they join most of a large group, and what is joined is labelled, so that the
    other masks don't link it again and again.
    """
    masks = part_masks(radius, parts)
    each = len(masks) // parts
    early = [m for i, m in enumerate(masks) if i % each < first]
    late = [m for i, m in enumerate(masks) if i % each >= first]
    links = _wide_round(points.select("a", "b", F.lit(0).cast("long").alias("label")), early, radius, wide, block)
    if not late:
        return links
    known = stage(connected_components(links).select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.xxhash64("component").alias("label")), "labels")
    labelled = stage(points.join(known, ["a", "b"], "left").select("a", "b", F.coalesce("label", F.lit(0).cast("long")).alias("label")), "labelled")
    return links.unionByName(_wide_round(labelled, late, radius, wide, block))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = RADIUS, block: int = BLOCK, parts: int = 1, wide: int | None = None) -> DataFrame:
    """(key, fingerprint long, component): component is the least key of all that are linked, over any number of steps.

    Null texts count as empty; all blank texts share fingerprint zero and so one component. Repeated rows stay repeated.
    Null keys are kept, and name a component only if it has no other key. An empty table gives an empty table.

    With ``wide`` fingerprints have a second word: links differ in ``radius`` bits of the first at most and in ``wide`` of
    both, and the first is covered in ``parts``.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if wide is None:
        marked = stage(fingerprints(source, "t", width, "fp"), "fingerprints")
    else:
        marked = stage(fingerprints(source, "t", width, "a", "b").select("k", F.struct("a", "b").alias("fp")), "fingerprints")
    points = stage(marked.groupBy("fp").agg(F.min("k").alias("least")), "points")
    links = near_links(points.select("fp"), radius, block) if wide is None else near_links_wide(points.select("fp.*"), radius, parts, wide, block)
    # Only linked fingerprints have a name to look for, and names are a table: Spark sees its size, and beyond a broadcast
    # can split a large component. What has a row for each fingerprint is merged: stored, it passes for small.
    groups = stage(connected_components(links).join(points.hint("merge"), F.col("node") == F.col("fp")).select("fp", "component", "least"), "groups")
    names = stage(groups.groupBy("component").agg(F.min("least").alias("name")), "names")
    named = stage(groups.join(names, "component").select("fp", "name"), "named")
    labels = points.join(named.hint("merge"), "fp", "left").select("fp", F.when(F.col("name").isNull(), F.col("least")).otherwise(F.col("name")).alias("component"))
    # Copies share a fingerprint: with a hash as a further key both sides are exchanged for the join, and AQE can split it.
    hashed = F.xxhash64("fp").alias("h")
    return marked.select("*", hashed).join(labels.select("*", hashed).hint("merge"), ["fp", "h"]).select(F.col("k").alias(key), (F.col("fp") if wide is None else F.col("fp.a")).alias("fingerprint"), "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
