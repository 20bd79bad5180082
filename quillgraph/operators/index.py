"""Chunks, postings and lexical scores."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from quillgraph.functions import text as tx
from quillgraph.functions.vocabulary import STOPWORDS

SIZE, OVERLAP = 220, 45


def word_windows(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, word_start, word_end, chunk_text): windows of ``size`` words, ``overlap`` shared with the next.

    The last window ends with the text. Texts without words have none. A narrow operation: no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    split = docs.select(F.col(key), tx.words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    last = F.when(F.size("ws") <= size, 0).otherwise(F.ceil((F.size("ws") - size) / F.lit(step)).cast("int"))
    # The windows are cut inside the row: exploding first would copy a text's whole word array into each of them.
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk_index"), (i * step).alias("word_start"), F.least(F.size("ws"), i * step + size).alias("word_end"),
            F.array_join(F.slice("ws", i * step + 1, F.lit(size)), " ").alias("chunk_text"),
        ),
    )
    return split.select(key, F.inline(windows))


def page_windows(docs: DataFrame, key: str, text: str = "text", per_page: int = 40, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_text, page_start, page_end): word windows over a text's lines, with the pages of their first
    and last words. ``per_page`` lines make a page. All inside the row: no shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    words = F.flatten(F.transform(lines, lambda line, i: F.transform(tx.words(line), lambda w: F.struct(w.alias("w"), (F.floor(i / per_page) + 1).cast("int").alias("p")))))
    split = docs.select(F.col(key), words.alias("ws")).where(F.size("ws") > 0)
    last = F.when(F.size("ws") <= size, 0).otherwise(F.ceil((F.size("ws") - size) / F.lit(step)).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk_index"), F.array_join(F.slice("ws.w", i * step + 1, F.lit(size)), " ").alias("chunk_text"),
            F.get("ws.p", i * step).alias("page_start"), F.get("ws.p", F.least(F.size("ws"), i * step + size) - 1).alias("page_end"),
        ),
    )
    return split.select(key, F.inline(windows))


def overwrite_vectors(stored: DataFrame, fresh: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``stored`` with the vectors that ``fresh(key, vector)`` has; unknown keys change nothing."""
    new = fresh.select(key, F.col(vector).alias("_new"))
    return stored.join(new, key, "left").select(*[F.coalesce("_new", vector).alias(vector) if c == vector else F.col(c) for c in stored.columns])


def embed_texts(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", text: str = "chunk_text", batch: int = 64) -> DataFrame:
    """(key, embedding) by a model that the caller brings: ``embed`` gets ``batch`` texts at a time, in Arrow slices on the
    executors. Null texts count as empty."""
    source = chunks.select(key, F.coalesce(text, F.lit("")).alias(text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "embedding": [[float(x) for x in v] for v in embed(part[text].tolist())]})

    return source.mapInPandas(run, StructType([source.schema[key], StructField("embedding", ArrayType(FloatType()))]))


def postings(texts: DataFrame, *keys: str, text: str = "chunk_text") -> DataFrame:
    """(keys, token, count): how often each body token occurs. Partial sums are formed before the shuffle."""
    # Words are rows before they are chosen: a filter of rows is compiled, one inside an array is not.
    rows = texts.select(*keys, F.explode(tx.body_words(F.col(text))).alias("token")).where(tx.is_body_token(F.col("token")))
    return rows.groupBy(*keys, "token").agg(F.count("*").alias("count"))


def packed_postings(texts: DataFrame, buckets: int, *keys: str, text: str = "chunk_text") -> DataFrame:
    """Postings with a ``bucket``, the token's CRC-32 modulo ``buckets``: of each Arrow batch a row for each bucket that it
    meets, with lists of keys and counts, and the tokens joined by blanks.

    Words are counted where a row is read, so nothing is shuffled for that, and lists take much less of a later shuffle than
    rows would; ``unpacked`` gives what ``postings`` gives, if no two rows have the same keys.
    """
    source = texts.select(*keys, tx.body_words(F.col(text)).alias("ws"))
    schema = StructType([StructField("bucket", IntegerType()), *[StructField(k, ArrayType(source.schema[k].dataType)) for k in keys], StructField("token", StringType()), StructField("count", ArrayType(LongType()))])
    stop = pa.array(sorted(STOPWORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.table({"token": pc.list_flatten(batch.column("ws")), "row": pc.list_parent_indices(batch.column("ws"))})
            words = words.filter(pc.and_(pc.greater(pc.utf8_length(words["token"]), 1), pc.invert(pc.is_in(words["token"], stop))))
            if not words.num_rows:
                continue
            rows = words.group_by(["token", "row"]).aggregate([([], "count_all")]).combine_chunks()
            distinct = rows["token"].combine_chunks().dictionary_encode()
            places = pa.array([zlib.crc32(t.encode()) % buckets for t in distinct.dictionary.to_pylist()], pa.int32())
            rows = rows.append_column("bucket", places.take(distinct.indices)).sort_by([("bucket", "ascending"), ("token", "ascending"), ("row", "ascending")]).combine_chunks()
            runs = pc.run_end_encode(rows["bucket"].combine_chunks())
            ends = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends.cast(pa.int32())])
            own = [batch.column(k).take(rows["row"].combine_chunks()) for k in keys]
            *ids, tokens, counts = [pa.ListArray.from_arrays(ends, c) for c in (*own, rows["token"].combine_chunks(), rows["count_all"].combine_chunks())]
            yield pa.RecordBatch.from_arrays([runs.values, *ids, pc.binary_join(tokens, " "), counts], names=schema.names)

    return source.mapInArrow(run, schema)


def unpacked(packed: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, count, bucket): the rows of packed postings."""
    return packed.select(F.inline(F.arrays_zip(*[F.col(c) for c in keys], F.split("token", " ").alias("token"), F.col("count"))), "bucket")


def bm25(fields: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that hold one of ``terms``: Okapi BM25 over letters-and-digits tokens.

    One pass: each row keeps its length and the counts of the asked terms alone; corpus totals are a one-row aggregate.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return fields.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = tx.found(F.lower(F.col(text)), "[a-z0-9]+")
    rows = fields.select(key, tokens.alias("ts")).select(key, F.size("ts").alias("len"), *[F.size(F.filter("ts", _equals(t))).alias(f"n{i}") for i, t in enumerate(terms)])
    total = rows.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        n = F.col(f"n{i}").cast("double")
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"n{i}") > 0)
    # The totals are one row.
    return rows.where(hit).crossJoin(F.broadcast(total)).select(key, score.alias("score"))


def _equals(term: str):
    return lambda t: t == term


def cosine_top(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score) of the k rows nearest to ``query`` by cosine, exact; ties by key. Each task keeps k rows."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5 or 1.0
    lit = F.array(*[F.lit(x / norm) for x in q])
    dot = F.aggregate(F.zip_with(F.col(vector), lit, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(key, (dot / F.nullif(size, F.lit(0.0))).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)
