"""Benchmark passages in training texts, by spaced-seed hashing.

Words are lower-cased runs of letters and digits. A seed is the hash of a few words at fixed places of a short stretch; the
places between don't count, so that a changed word there leaves the seed as it is. The two masks used here meet every
stretch of 13 words in which at most two differ. Seeds of both sides are joined by their hash; around each hit, test and
training words are compared along the hit's diagonal, and stretches of 13 words with 11 or more equal are reported. Test
items of 5 to 12 words are met only as a whole and unchanged; shorter ones are not searched.

The join runs where the texts are: a block of the benchmark (``block_words`` words at most, but one item at least) is a
sorted array of seeds that every task holds. A benchmark of one block costs no shuffle; of more, each block is a pass that
leaves only its hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quillgraph.llm._words import NOT_ALNUM, mix, word_hashes, words
from quillgraph.session import stage

STRETCH = 13
SIMILARITY = 0.8
#: Word places that count. Any two differing words in 13 leave one of these whole somewhere.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
LEAST_WORDS = 5
BLOCK_WORDS = 1 << 18
_FILTER = 22
MATCHES = "array<struct<item_id:{},first_word:int,last_word:int,equal:int,compared:int>>"


def _seeds(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed that starts at each word, as far as the mask fits."""
    n = max(0, len(codes) - mask[-1])
    h = np.zeros(n, np.uint64)
    for k, place in enumerate(mask):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[place : place + n]
    return mix(h + np.uint64(len(mask) * 1009 + mask[-1]))


@dataclass(frozen=True)
class Index:
    """Seeds of a block of items, sorted, with the word each starts at; and the items' words."""

    items: list[int | None]
    first: np.ndarray
    codes: np.ndarray
    seeds: np.ndarray
    starts: np.ndarray
    masks: tuple[tuple[int, ...], ...]
    filter: np.ndarray


def build_index(items: list[tuple[int, str]], stretch: int = STRETCH, masks: tuple[tuple[int, ...], ...] = MASKS) -> Index:
    """Items with fewer than ``stretch`` words have one seed: all their words."""
    texts = pa.array([t for _, t in items], pa.string())
    codes, counts = [], []
    for w in words(texts, NOT_ALNUM, lower=True):
        codes.append(word_hashes(w))
        counts.append(np.diff(w.first))
    codes = np.concatenate([*codes, np.zeros(0, np.uint64)])
    counts = np.concatenate([*counts, np.zeros(0, np.int64)])
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    whole = sorted({int(c) for c in counts if LEAST_WORDS <= c < stretch})
    masks = (*masks, *(tuple(range(c)) for c in whole))
    seeds, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask in masks:
        short = len(mask) < stretch and mask == tuple(range(len(mask)))
        for i in np.flatnonzero(counts == len(mask) if short else counts >= stretch):
            h = _seeds(codes[first[i] : first[i + 1]], mask)
            seeds.append(h)
            starts.append(first[i] + np.arange(len(h)))
    seeds, starts = np.concatenate(seeds), np.concatenate(starts)
    order = np.argsort(seeds, kind="stable")
    met = np.zeros(1 << _FILTER, bool)
    met[(seeds >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
    return Index([i for i, _ in items], first, codes, seeds[order], starts[order], masks, met)


def _stretches(equal: np.ndarray, stretch: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Maximal unions of windows with enough equal words, cut back to equal words at both ends."""
    width = min(stretch, len(equal))
    need = width if len(equal) < stretch else int(np.ceil(similarity * width - 1e-9))
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= need)
    if not len(good):
        return
    cuts = np.flatnonzero(np.diff(good) > width) + 1
    for part in np.split(good, cuts):
        hit = np.flatnonzero(equal[part[0] : part[-1] + width]) + part[0]
        yield int(hit[0]), int(hit[-1])


def search(column: pa.Array, index: Index, stretch: int = STRETCH, similarity: float = SIMILARITY) -> Iterator[list[dict]]:
    """For each text its matches, by item and place; at most one for each item and run of words."""
    for w in words(column, NOT_ALNUM, lower=True):
        codes, row = word_hashes(w), w.row
        found: list[list[dict]] = [[] for _ in range(w.hi - w.lo)]
        pairs = []
        for mask in index.masks:
            h = _seeds(codes, mask)
            at = np.flatnonzero(index.filter[(h >> np.uint64(64 - _FILTER)).astype(np.int64)])
            at = at[row[at] == row[at + mask[-1]]]
            lo, hi = np.searchsorted(index.seeds, h[at], "left"), np.searchsorted(index.seeds, h[at], "right")
            n = hi - lo
            if n.any():
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                start, place = index.starts[entry], np.repeat(at, n)
                pairs.append(np.stack([place - start, np.searchsorted(index.first, start, "right") - 1, row[place]], axis=1))
        for shift, item, r in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else ():
            a, b = int(index.first[item]), int(index.first[item + 1])
            lo, hi = max(a, int(w.first[r]) - shift), min(b, int(w.first[r + 1]) - shift)
            equal = codes[lo + shift : hi + shift] == index.codes[lo:hi]
            if hi - lo < min(stretch, b - a):
                continue
            for x, y in _stretches(equal, stretch, similarity):
                begin = lo + shift + x - int(w.first[r])
                found[r].append({"item_id": index.items[item], "first_word": begin, "last_word": begin + y - x, "equal": int(equal[x : y + 1].sum()), "compared": y - x + 1})
        for matches in found:
            matches.sort(key=lambda m: (m["item_id"] is None, () if m["item_id"] is None else (m["item_id"],), m["first_word"], m["last_word"]))
            yield matches


def _key(text: str | None) -> tuple[int, int | None]:
    h = xxhash.xxh3_128_intdigest((text or "").encode())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & (1 << 64) - 1))


def find_benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", stretch: int = STRETCH, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with ``matches``, an array of (item_id, first_word, last_word, equal, compared); word places count from 0.

    Null and blank texts have an empty array, null items are not searched, an item id may be null, repeated, a number or a text.
    Repeated rows have equal results. A column named ``matches`` is replaced, all others stay. Empty tables, of either side, are no error.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "matches"]
    # Plain names inside, so that no column of the input clashes.
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)

    def named(frame: DataFrame, matches: Column) -> DataFrame:
        return frame.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], matches.alias("matches"))

    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    kind = MATCHES.format(items.schema["i"].dataType.simpleString())
    arrow = to_arrow_type(_parse_datatype_string(kind))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    # A word takes two characters with its gap.
    blocks = max(1, -(-total // (2 * block_words)))

    def index_of(part: DataFrame):
        return spark.sparkContext.broadcast(build_index([(r.i, r.t) for r in part.collect()], stretch))

    if blocks == 1:
        shared = index_of(items)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(search(b.column(at), shared.value, stretch, similarity)), arrow)], names=[*b.schema.names, "matches"])

        return named(source.mapInArrow(mark, StructType([*source.schema.fields, StructField("matches", _parse_datatype_string(kind))])), F.col("matches"))

    def hits_of(shared):
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(*_key(t.as_py()), m) for t, m in zip(b.column(0), search(b.column(0), shared.value, stretch, similarity), strict=True) if m]
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), arrow), strict=True)], names=["k1", "k2", "m"])

        return hits

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [_key(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in k], pa.int64()), pa.array([x for _, x in k], pa.int64())], names=[*b.schema.names, "k1", "k2"])

    parts = []
    dealt = stage(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "items")
    for block in range(blocks):
        shared = index_of(dealt.where(F.col("block") == block))
        parts.append(stage(source.select(f"c{at}").mapInArrow(hits_of(shared), f"k1 long, k2 long, m {kind}").distinct(), "hits"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.flatten(F.collect_list("m")).alias("m"))
    # Null ids last, as within a block.
    every = every.withColumn("m", F.transform(F.array_sort(F.transform("m", lambda x: F.struct(x["item_id"].isNull().alias("none"), x.alias("x")))), lambda s: s["x"]))
    keyed = source.mapInArrow(keys, StructType([*source.schema.fields, *(StructField(k, _parse_datatype_string("long")) for k in ("k1", "k2"))]))
    return named(keyed.join(stage(every, "matches"), ["k1", "k2"], "left"), F.coalesce("m", F.array().cast(kind)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents: one row for each document, item and run of words."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_benchmark_passages(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.inline("matches"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
SQL: dict[str, str] = {}
