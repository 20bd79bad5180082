"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of byte 3-grams, byte 4-grams and word pairs, hashed to ``2 ** BITS`` places. Each indicator is
scaled by its place's log-count ratio between the classes and by one over the root of the text's number of indicators. On
these a linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al., 2008), and Platt scaling turns margins
into scores.

The ratios count all labelled training texts: each task sums its own into fixed arrays, Spark adds those up. The descent
needs single rows and takes a sample of about ``SAMPLE`` labelled texts, chosen by a hash of their key; that is the one
bound, and it bounds what the driver gets. Scoring is one pass without any shuffle.

Only texts whose key passes a Bloom filter over the label keys are shuffled to the labels, and those go packed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from quillgraph.llm._sieve import Sieve, key_hash
from quillgraph.llm._words import SLICE, Words, mix, word_hashes, words
from quillgraph.session import stage

BITS = 18
SAMPLE = 6000
COST = 1.0
ROUNDS = 25
FOLDS = 3


def _slice_features(w: Words, lengths: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each row its distinct places, in order of first use."""
    data = w.data.astype(np.uint32)
    shift = np.uint32(32 - bits)
    two = (data[:-1] << np.uint32(8)) | data[1:] if len(data) > 1 else data[:0]
    three = (two[:-1] << np.uint32(8)) | data[2:] if len(data) > 2 else data[:0]
    four = (three[:-1] << np.uint32(8)) | data[3:] if len(data) > 3 else data[:0]
    h3 = ((three * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
    h4 = (((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift).astype(np.int32)
    codes = word_hashes(w)
    pairs = (mix(codes[:-1] * np.uint64(3) + codes[1:]) >> np.uint64(64 - bits)).astype(np.int32) if len(codes) > 1 else np.zeros(0, np.int32)
    slot = np.zeros(1 << bits, np.int32)
    count = np.arange(len(data) * 2 + len(pairs) + 1, dtype=np.int32)
    ends = np.cumsum(lengths)
    for a, b, x, y in zip((ends - lengths).tolist(), ends.tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        places = np.concatenate([h3[a : max(a, b - 2)], h4[a : max(a, b - 3)], pairs[x : max(x, y - 1)]])
        own = count[: len(places)]
        slot[places] = own
        yield places[slot[places] == own]


def features(column: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """Distinct feature places of each text; none for null or empty texts."""
    lengths = np.asarray(pa.compute.binary_length(pa.compute.fill_null(column, "").cast(pa.large_binary())), np.int64)
    for w in words(column):
        yield from _slice_features(w, lengths[w.lo : w.hi], bits)


@dataclass(frozen=True)
class Model:
    """Weights by place (the ratios are in them), the bias, and Platt's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int = BITS

    def margin(self, places: np.ndarray) -> float:
        return self.bias + (float(self.weights[places].sum(dtype=np.float64)) / math.sqrt(len(places)) if len(places) else 0.0)

    def score(self, places: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.slope * self.margin(places) + self.offset))))


def log_ratios(positive: np.ndarray, negative: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of each place's share of the positive counts over its share of the negative ones."""
    p, q = positive + smoothing, negative + smoothing
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights for scaled indicators and the bias: hinge loss, L2 penalty, one dual variable at a time."""
    scales = 1 / np.sqrt([max(1, len(r)) for r in rows])
    squares = ratios * ratios
    norms = np.array([squares[r].sum() * s * s for r, s in zip(rows, scales, strict=True)]) + 1.0
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            value = ratios[rows[i]] * scales[i]
            gradient = signs[i] * (float(weights[rows[i]] @ value) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            worst = max(worst, abs(projected))
            if projected:
                step = min(max(alpha[i] - gradient / norms[i], 0.0), cost) - alpha[i]
                alpha[i] += step
                weights[rows[i]] += step * signs[i] * value
                bias += step * signs[i]
        if worst < tolerance:
            break
    return weights, bias


def _linear(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, bits: int) -> Model:
    weights, bias = dual_descent(rows, 2 * labels - 1, ratios)
    return Model((weights * ratios).astype(np.float32), bias, 1.0, 0.0, bits)


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method on Platt's softened targets."""
    n1, n0 = float(labels.sum()), float((1 - labels).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 1e-6), float(offset)


def _packed(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """``docs(key, t)`` as (h, key, t): rows whose key may have a label, with their texts packed by zstd."""
    source = docs.select(key_hash(F.col("key")).alias("h"), "key", "t")
    schema = StructType([*source.schema.fields[:-1], StructField("t", BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            b = b.filter(pa.array(shared.value.passes(b.column(0).to_numpy())))
            texts = (cell.as_py() for cell in b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _texts(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts, or of packed ones, in parts of about ``SLICE`` bytes."""
    if not pa.types.is_binary(column.type):
        yield column
        return
    unpack = zstandard.ZstdDecompressor().decompress
    part, held = [], 0
    for cell in column:
        part.append(unpack(cell.as_py()))
        held += len(part[-1])
        if held > SLICE:
            yield pa.array(part, pa.large_binary()).cast(pa.large_string())
            part, held = [], 0
    yield pa.array(part, pa.large_binary()).cast(pa.large_string())


def _gather(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In: label, chosen, text or packed text. Out: a row of places for each chosen text, and the task's counts as one row."""
        counts = np.zeros((2, 1 << bits), np.int64)
        names = ["label", "places", "positive", "negative"]
        types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            labels, chosen = b.column(0).to_pylist(), b.column(1).to_pylist()
            kept, of = [], []
            for i, places in enumerate(p for texts in _texts(b.column(2)) for p in features(texts, bits)):
                counts[labels[i]][places] += 1
                if chosen[i]:
                    kept.append(places)
                    of.append(labels[i])
            none = [None] * len(of)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((of, kept, none, none), types, strict=True)], names=names)
        used = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([None], [used], [counts[1][used]], [counts[0][used]]), types, strict=True)], names=names)

    return run


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "key", sample: int = SAMPLE, bits: int = BITS, rows: int | None = None) -> Model:
    """A model from ``labelled(key, text, label)``; labels other than 0 and 1 are left out, null texts count as empty.

    Texts are strings, or binary and packed by zstd. ``rows``, where known, saves counting ``labelled``.

    With rows of one class only, or none, all texts score alike: the class's smoothed share.
    """
    known = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), F.col(key).alias("key"), F.col(text).alias("t"))
    n = known.count() if rows is None else rows
    limit = int(min(1.0, sample / max(1, n)) * (1 << 62))
    chosen = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "key"), 2) < F.lit(limit)
    gathered = stage(known.select("label", chosen.alias("chosen"), "t").mapInArrow(_gather(bits), "label int, places array<int>, positive array<long>, negative array<long>"), "features")
    sums = (
        gathered.where("label is null")
        .select(F.explode(F.arrays_zip("places", "positive", "negative")).alias("x"))
        .groupBy(F.col("x.places").alias("place"))
        .agg(F.sum("x.positive").alias("p"), F.sum("x.negative").alias("q"))
        .toPandas()
    )
    positive, negative = np.zeros(1 << bits), np.zeros(1 << bits)
    positive[sums["place"]], negative[sums["place"]] = sums["p"], sums["q"]
    taken = gathered.where("label is not null").select("label", "places", F.xxhash64("places").alias("h")).toArrow().combine_chunks()
    # The driver orders them: rows arrive in no fixed order, and descent depends on it.
    order = np.lexsort((taken["label"].to_numpy(), taken["h"].to_numpy()))
    labels = taken["label"].to_numpy().astype(np.float64)[order]
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    ratios = log_ratios(positive, negative)
    flat, ends = taken["places"].chunk(0).values.to_numpy(), taken["places"].chunk(0).offsets.to_numpy()
    places = [flat[ends[i] : ends[i + 1]] for i in order.tolist()]
    # Margins of rows that a model was fitted to are too sure of themselves: the curve is fitted to those of left-out rows.
    margins, fold = np.zeros(len(places)), np.arange(len(places)) % FOLDS
    for k in range(FOLDS):
        rows_in = np.flatnonzero(fold != k)
        half = _linear([places[i] for i in rows_in], labels[rows_in], ratios, bits)
        margins[fold == k] = [half.margin(places[i]) for i in np.flatnonzero(fold == k)]
    model = _linear(places, labels, ratios, bits)
    return Model(model.weights, model.bias, *_platt(margins, labels), bits)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (null and empty texts too); a column already named ``out`` is replaced."""
    others = [c for c in docs.columns if c != out]
    source = docs.select(*[f"`{c}`" for c in others])
    schema = StructType([*source.schema.fields, StructField(out, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits floats, whatever the input
    at = others.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = np.fromiter((m.score(p) for p in features(b.column(at), m.bits)), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The rows that no label is learnt from: crc32 of the key as text leaves 1 when divided by 3. A null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, without the held-out rows.

    A key that repeats in ``docs`` counts each of its rows; one with both labels counts once for each label. Null keys
    have no label.
    """
    texts = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), F.col("text").alias("t"))
    same = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    marks = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(same.alias("key"), F.col("quality").cast("int").alias("label")).where("key is not null").distinct()
    # The hash is a second join key: with it neither side of the join is an aggregate's own output, so a key that many
    # documents share can be split.
    marks = marks.withColumn("h", key_hash(F.col("key")))
    n = texts.select("key").join(marks.select("key"), "key").count()
    known = _packed(texts, Sieve.over(marks, F.col("h"))).join(marks.hint("merge"), ["key", "h"])
    return fit(known, text="t", sample=sample, rows=n)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a model of its labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
