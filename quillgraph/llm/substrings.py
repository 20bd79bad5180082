"""Removal of passages that occur more than once, by difference-cover anchors.

A difference cover of a period v holds residues such that any two positions can be moved by the same shift, below v, onto
residues of the cover. Hashes of n - v + 1 words at cover positions alone are then enough to meet every repeat of n words:
two equal windows share an aligned anchor. With n = 35 and v = 21, 5 of 21 positions are hashed.

1. Anchors of all texts are hashed and those met twice are marked. Anchors that one batch already holds twice are marked
   there, and go on as a single row, so that a passage in a third of all texts sends a row for each batch.
2. Texts with a marked anchor are gathered, and every window around one is extended to its full n words (128-bit hash).
   Windows met twice are the repeats; no pair of occurrences is ever listed.
3. The words that such windows cover are removed.

Texts that are equal as a whole go through once for each task; copies are known from a count of text digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgraph.llm._words import Words, run_hashes, word_hashes, words
from quillgraph.session import stage

WINDOW = 35
#: Perfect difference sets: each non-zero residue of the period is the difference of exactly one pair.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
LEAST_ANCHOR = 12
_EMPTY = hashlib.sha256(b"").hexdigest()
_SEEN = 1 << 18


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, residues, words of an anchor) for repeats of ``window`` words: the sparsest that leaves long anchors."""
    period = max((p for p in COVERS if window - p + 1 >= LEAST_ANCHOR), default=1)
    return period, COVERS[period], window - period + 1


def _places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Position of each word in its text, and the number of words from there on."""
    counts = np.diff(w.first)
    at = np.arange(len(w.start)) - np.repeat(w.first[:-1], counts)
    return at, np.repeat(counts, counts) - at


def _keys(w: Words, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """128 bits of each text of the slice, as two signed longs."""
    raw = w.data.tobytes()
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    both = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _slices(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    lengths = None
    for w in words(column):
        if lengths is None:
            lengths = np.array(pa.compute.binary_length(pa.compute.fill_null(column, "").cast(pa.binary())).to_numpy(zero_copy_only=False), np.int64)
        yield w, np.concatenate([[0], np.cumsum(lengths[w.lo : w.hi])])


class _Once:
    """True for keys not met before in this task; forgets all of them now and then, which only costs repeated work."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if key not in self.seen:
                self.seen.add(key)
                out[i] = True
        if len(self.seen) > _SEEN:
            self.seen.clear()
        return out


def _met_here(h: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, known): of equal hashes the first keeps its hash as key; further ones get a key of their own and are known."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    twice = ~new
    twice[:-1] |= ~new[1:]
    first, known = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order], known[order] = new, twice
    return np.where(first, h, salt), known


def _anchors(window: int):
    period, residues, length = cover_for(window)
    covered = np.zeros(period, bool)
    covered[list(residues)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for b in batches:
            hs, ids, ats = [], [], []
            for w, offsets in _slices(b.column(0)):
                k1, k2 = _keys(w, offsets)
                at, left = _places(w)
                row = w.row
                s = np.flatnonzero(once(k1, k2)[row] & (np.repeat(np.diff(w.first), np.diff(w.first)) >= window) & (left >= length) & covered[at % period])
                hs.append(run_hashes(word_hashes(w), s, length))
                ids.append(k1[row[s]])
                ats.append(at[s])
            if not hs:
                continue
            h, k, at = np.concatenate(hs), np.concatenate(ids), np.concatenate(ats)
            key, known = _met_here(h, h ^ k.view(np.uint64) ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k), pa.array(at.astype(np.int32)), pa.array(known)], names=["key", "k1", "at", "known"])

    return run


def _packed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, pack = _Once(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            for w, offsets in _slices(b.column(0)):
                k1, k2 = _keys(w, offsets)
                raw = w.data.tobytes()
                take = np.flatnonzero(once(k1, k2) & (np.diff(w.first) >= window))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[take]), pa.array(k2[take]), pa.array([pack.compress(raw[offsets[i] : offsets[i + 1]]) for i in take], pa.binary())],
                    names=["k1", "k2", "packed"],
                )

    return run


def _unpacked(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(row, its words), one text at a time."""
    open_ = zstandard.ZstdDecompressor()
    for i, x in enumerate(column):
        text = pa.array([open_.decompress(x.as_py())], pa.binary()).cast(pa.string())
        for w in words(text):
            yield i, w


def _windows(window: int):
    period, _, length = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids, marks = b.column(0).to_numpy(), b.column(2)
            ones, twos, ids, ats = [], [], [], []
            for i, w in _unpacked(b.column(1)):
                n = len(w.start)
                near = np.zeros(n + 1, np.int64)
                m = np.unique(np.asarray(marks[i].values))
                m = m[m <= n - length]
                np.add.at(near, np.maximum(m - period + 1, 0), 1)
                near[m + 1] -= 1
                s = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                s = s[s <= n - window]
                codes = word_hashes(w)
                ones.append(run_hashes(codes, s, window, 1))
                twos.append(run_hashes(codes, s, window, 2))
                ids.append(np.full(len(s), tids[i]))
                ats.append(s.astype(np.int32))
            if not ones:
                continue
            h, two, k, at = (np.concatenate(x) for x in (ones, twos, ids, ats))
            both = h ^ (two * np.uint64(0x9E3779B97F4A7C15))
            key, known = _met_here(both, both ^ (k.view(np.uint64) << np.uint64(20)) ^ at.astype(np.uint64))
            # Two windows that a batch holds twice must agree in all 128 bits; a chance meeting in 64 is left to the join.
            order = np.argsort(both, kind="stable")
            alike = np.zeros(len(h), bool)
            same = (both[order[1:]] == both[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
            alike[order[1:]] |= same
            alike[order[:-1]] |= same
            odd = known & ~alike
            key[odd], known[odd] = both[odd], False
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(k), pa.array(at), pa.array(known)], names=["key", "h", "tid", "at", "known"])

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, kept, gone, texts = b.column(3), [], [], []
            for i, w in _unpacked(b.column(2)):
                edge = np.zeros(len(w.start) + 1, np.int64)
                s = np.unique(np.asarray(starts[i].values))
                edge[s] += 1
                np.add.at(edge, np.minimum(s + window, len(w.start)), -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                raw = w.data.tobytes()
                text = b" ".join(raw[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True))
                texts.append(text.decode())
                kept.append(hashlib.sha256(text).hexdigest())
                gone.append(len(w.start) - len(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.string())], names=["k1", "k2", "gone", "kept", "kept_text"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1s, k2s, counts, shas = [], [], [], []
        for w, offsets in _slices(b.column(1)):
            k1, k2 = _keys(w, offsets)
            raw, s, e = w.data.tobytes(), w.start.tolist(), w.end.tolist()
            for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                shas.append(hashlib.sha256(b" ".join([raw[s[i] : e[i]] for i in range(x, y)])).hexdigest())
            k1s.append(k1)
            k2s.append(k2)
            counts.append(np.diff(w.first))
        if k1s:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (k1s, k2s, counts)), pa.array(shas, pa.string())], names=["id", "k1", "k2", "n_words", "whole"]
            )


def _met_twice(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*by))).where("known or n > 1")


def repeated_passages(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """For every distinct text with a marked anchor: (k1, k2, gone, kept, kept_text).

    ``gone`` words are covered by windows that occur again in any text; ``kept_text`` is the rest, joined by one blank, and
    ``kept`` its SHA-256. Texts that occur twice as a whole may miss here; ``remove_repeats`` adds them.
    """
    source = docs.select(F.col(text).alias("t"))
    hashed = source.mapInArrow(_anchors(window), "key long, k1 long, at int, known boolean")
    marks = _met_twice(hashed, "key").groupBy("k1").agg(F.collect_list("at").alias("marks"))
    texts = source.mapInArrow(_packed(window), "k1 long, k2 long, packed binary")
    suspects = stage(texts.join(marks, "k1").withColumn("tid", F.monotonically_increasing_id()), "suspects")
    found = suspects.select("tid", "packed", "marks").mapInArrow(_windows(window), "key long, h long, tid long, at int, known boolean")
    starts = _met_twice(found, "key", "h").groupBy("tid").agg(F.collect_list("at").alias("starts"))
    return suspects.join(starts, "tid").select("k1", "k2", "packed", "starts").mapInArrow(_removed(window), "k1 long, k2 long, gone long, kept string, kept_text string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept_text]) for every row.

    Words are runs without ASCII white space. A null text has no words. Repeated rows count as further occurrences, so each
    loses all its words where it has ``window`` of them. Keys may be null or repeated; other columns are not read. An empty
    table gives an empty table. ``kept_text`` is null where nothing is removed: the text itself is the result then.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(_digests, docs.select(F.col(key).alias("id")).withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"), "n_words": F.lit(0).cast("long"), "whole": F.lit("")}).schema)
    rows = stage(rows, "digests")
    copies = rows.where(F.col("n_words") >= window).groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("copied"))
    found = repeated_passages(docs, text, window)
    if not texts:
        found = found.drop("kept_text")
    parts = found.join(copies, ["k1", "k2"], "full")
    # Tasks may each have sent a copied text: one row for each text is enough.
    parts = parts.groupBy("k1", "k2").agg(F.max("copied").alias("copied"), F.max("gone").alias("gone"), F.max("kept").alias("kept"), *([F.max("kept_text").alias("kept_text")] if texts else []))
    # A table of its own, so that the join has its own exchange and a text with very many copies can be split.
    joined = rows.join(stage(parts, "parts"), ["k1", "k2"], "left")
    return joined.select(
        F.col("id").alias(key),
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(_EMPTY)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        *([F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if texts else []),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows removed from every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
SQL = {
    "op8_substring_dedup": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1
), c AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM d
), g AS (SELECT r, list(p) AS ps FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE [ws[k] FOR k IN range(1, len(ws) + 1) IF NOT list_contains(ps, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""
}
