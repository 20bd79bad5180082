"""Centroid clustering of integer vectors, with distances screened by block norms.

A vector is compressed to the norms of its segments (Bottesch, Bühler and Kächele, 2016). By Cauchy and Schwarz the product
of two vectors is at most the sum of the products of their segments' norms, so the compressed forms bound the distance from
below. A vector's first exact distance is to the centroid of the least bound; of the others only those whose bound doesn't
pass the least distance so far are computed, in integers. Bounds are floats, lowered by more than rounding can raise them,
so the screening never changes an assignment.

Vectors are made integers and their segments' squares computed once, as a table. Each round is one pass over it: a task sends
one row of sums for each centroid, Spark adds those up, and the driver holds centroids alone (their number times the
dimension, whatever the input). Floors of sums by counts are exact, so rounds don't depend on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillgraph.session import stage

DIMENSION = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEGMENTS = 16
#: Integers stay below: then no squared distance of 64 components passes a long.
MOST = 1 << 27
#: Rows handled at once in a task.
_ROWS = 4096


def _whole(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components as doubles) of the vectors with exactly ``dimension`` components, none null or not finite."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimension)
    flat = column.take(pa.array(rows)).flatten()
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """(id, q, squares) of the vectors with exactly ``dimension`` components, none of them null, NaN or infinite: integers
    floor(scale * x), and the sum of squares of each of ``segments`` equal parts. Others have no row. Keys may be null or
    repeated. An integer of 2**27 or more fails the job, since its distance may not fit a long."""
    if dimension % segments:
        raise ValueError("segments must divide the dimension")
    source = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    schema = StructType([source.schema["id"], StructField("q", ArrayType(IntegerType())), StructField("squares", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, _ROWS):
                b = whole.slice(a, _ROWS)
                rows, values = _whole(b.column(1), dimension)
                with np.errstate(over="ignore"):
                    floored = np.floor(values * scale)
                if len(rows) and not (np.abs(floored) < MOST).all():
                    raise ValueError(f"a component times {scale} is {MOST} or more")
                q = floored.astype(np.int64)
                squares = (q * q).reshape(len(rows), segments, dimension // segments).sum(axis=2)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), t)) for x, t in ((q, pa.int32()), (squares, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *lists], names=schema.names)

    return source.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


@dataclass(frozen=True)
class Centroids:
    """Integer centroids, one a row."""

    rows: np.ndarray

    def nearest(self, q: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, exact distances computed) of the nearest centroid of each vector; of equal distances
        the smaller number."""
        segments = squares.shape[1]
        own = (self.rows * self.rows).reshape(len(self.rows), segments, -1).sum(axis=2)
        reach = squares.sum(axis=1)[:, None].astype(float) + own.sum(axis=1)[None, :]
        # The product's bound is a sum of ``segments`` products of roots: its relative error is far below 1e-12.
        bound = reach * (1 - 1e-12) - 2 * (np.sqrt(squares) @ np.sqrt(own).T) - 1e-6
        best = bound.argmin(axis=1) if len(q) else np.zeros(0, np.int64)
        apart = q - self.rows[best]
        distance = np.einsum("ij,ij->i", apart, apart)
        first, computed = best.copy(), np.ones(len(q), np.int64)
        for j, c in enumerate(self.rows):
            open_ = np.flatnonzero((bound[:, j] <= distance) & (first != j))
            apart = q[open_] - c
            found = np.einsum("ij,ij->i", apart, apart)
            nearer = (found < distance[open_]) | ((found == distance[open_]) & (j < best[open_]))
            best[open_[nearer]], distance[open_[nearer]] = j, found[nearer]
            computed[open_] += 1
        return best, distance, computed

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.rows.tolist()]


def first_centroids(compressed: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> Centroids | None:
    """The vectors of the smallest SHA-256 of ``seed:id`` in hexadecimal, in that order; equal ids by their vectors, null ids
    last. Fewer vectors than clusters give fewer centroids, none give none."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("q")]
    rows = compressed.orderBy(*order).limit(clusters).select("q").collect()
    return Centroids(np.array([r.q for r in rows], np.int64)) if rows else None


def next_centroids(compressed: DataFrame, now: Centroids) -> Centroids:
    """Each centroid as the floored mean of its vectors; one without vectors stays."""
    k, dimension = now.rows.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, _ROWS):
                part = b.slice(a, _ROWS)
                q = _matrix(part.column(0))
                best, *_ = now.nearest(q, _matrix(part.column(1)))
                counts += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                held, starts = np.unique(best[order], return_index=True)
                sums[held] += np.add.reduceat(q[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = compressed.select("q", "squares").mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    # Sums of many tasks may pass a long; the driver gets clusters times dimension rows.
    added = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = now.rows.copy()
    for r in added.collect():
        rows[r.cluster, r["at"]] = int(r.s) // r.n
    return Centroids(rows)


def assign(compressed: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance, computed): the nearest centroid, its squared distance, and how many distances that took."""
    schema = StructType([compressed.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("computed", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, _ROWS):
                part = b.slice(a, _ROWS)
                best, distance, computed = centroids.nearest(_matrix(part.column(1)), _matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(distance), pa.array(computed, pa.int32())], names=schema.names)

    return compressed.select("id", "q", "squares").mapInArrow(run, schema)


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """(key, cluster, distance, computed, cluster_inertia, inertia, centroid_sha256) for every vector that ``compress`` keeps.

    ``rounds`` of assignment and floored means, and one last assignment. Inertia is the squared distance summed over a cluster
    and over all; the digest is of the final centroid's integers, joined by commas. Repeated rows count as often as they
    occur; null keys are kept and start no cluster unless there are too few others. Other columns are not read. No vector
    kept gives an empty table.
    """
    held = stage(compress(vectors, key, vector, dimension, scale, segments), "vectors")
    now = first_centroids(held, clusters, seed)
    for _ in range(rounds if now else 0):
        now = next_centroids(held, now)
    rows = stage(assign(held, now or Centroids(np.zeros((1, dimension), np.int64))), "assigned")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = now.digests() if now else []
    table = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    given = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(given), "cluster").select(F.col("id").alias(key), "cluster", "distance", "computed", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's cluster of sixteen, after three rounds."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("computed")


def _round(i: int) -> str:
    return f"""
a{i} AS (SELECT row, min(d * 16 + c) AS m FROM (
  SELECT k.row, c.c, list_sum(list_transform(list_zip(k.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k CROSS JOIN c{i} c) GROUP BY row),
b{i} AS (SELECT vec_id, q, m % 16 AS c, m // 16 AS d FROM a{i} JOIN kept USING (row)),
c{i + 1} AS (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
    SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM b{i}) GROUP BY c, i) GROUP BY c) n USING (c))"""


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
SQL = {
    "op12_centroid_clusters": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT 16)),
{",".join(_round(i) for i in range(4))}
SELECT b3.vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c3.q, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM b3 JOIN c3 USING (c)"""
}
