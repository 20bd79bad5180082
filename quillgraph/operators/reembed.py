"""Embedding a stored index anew, page by page, so that a run that stops goes on where it was.

A page is a run of the chunk table's buckets: reading it opens its own folders alone. Its vectors are written first and its
watermark published last; pages without one are written again. Each watermark has the page's rate.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.operators.index import embed_texts
from quillgraph.operators.store import Store
from quillgraph.session import listed, publish

_MARKS = "page long, rows long, seconds double, rows_per_second double, done long, buckets long"


def reembed(store: Store, embed: Callable[[list[str]], list[list[float]]], path: str, buckets_a_page: int = 1, batch: int = 64, most_pages: int | None = None) -> DataFrame:
    """Vectors of all live chunks by ``embed``, below ``path``; returns the pages' progress rows.

    ``most_pages`` ends this run early. A path belongs to one state of one index: what is committed there isn't embedded
    again, also if chunks have changed since.
    """
    spark, buckets = store.spark, store.buckets("chunks")
    done = {int(n.removesuffix(".json")) for n in listed(spark, f"{path}/marks") if n.endswith(".json") and not n.startswith("_")}
    for page, first in enumerate(range(0, buckets, buckets_a_page)):
        if page in done:
            continue
        if most_pages is not None and most_pages <= 0:
            break
        most_pages = None if most_pages is None else most_pages - 1
        began, last = time.monotonic(), min(buckets, first + buckets_a_page)
        chunks = store.part("chunks", range(first, last))
        target = f"{path}/vectors/page={page}"
        embed_texts(chunks, embed, batch=batch).write.mode("overwrite").parquet(target)
        rows = spark.read.schema("chunk_id string").parquet(target).count()
        seconds = time.monotonic() - began
        done.add(page)
        mark = {"page": page, "rows": rows, "seconds": round(seconds, 3), "rows_per_second": round(rows / max(seconds, 1e-9), 1), "done": last, "buckets": buckets}
        publish(spark, f"{path}/marks", f"{page}.json", json.dumps(mark))
    return progress(spark, path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(page, rows, seconds, rows_per_second, done, buckets) of the committed pages."""
    return spark.read.schema(_MARKS).json(f"{path}/marks") if listed(spark, f"{path}/marks") else spark.createDataFrame([], _MARKS)


def reembedded(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of the committed pages."""
    vectors = spark.read.parquet(f"{path}/vectors")
    return vectors.join(F.broadcast(progress(spark, path).select("page")), "page", "left_semi").select("chunk_id", "embedding")  # a row a page
