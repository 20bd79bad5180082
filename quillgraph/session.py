"""Session helpers: a tuned builder and shared-folder staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build_session(app: str = "quillgraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on, UTC times and Arrow transfer; cluster settings stay as they are."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a temporary folder of this machine is set and used in local mode; on a cluster that is an error,
    since executors can't see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_OWNED: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one of this application's own that goes when its driver ends."""
    own = f"{shared_folder(spark)}/quillgraph/{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        _OWNED.add(own)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, calls: Mapping[str, Callable[[], T]]) -> dict[str, T]:
    """What each call returns; their Spark jobs run at the same time, with the caller's properties. The first error is raised
    when all have ended."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        found = {name: pool.submit(inheritable_thread_target(spark)(call)) for name, call in calls.items()}
    return {name: f.result() for name, f in found.items()}


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read of the table and no recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any of Spark's file systems; none where there is no such folder."""
    at, files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def publish(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file that is there whole or not at all: written under another name and moved. One that is there is an error."""
    at, files = _files(spark, f"{folder}/_{name}")
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _files(spark, f"{folder}/{name}")
    if files.exists(target) or not files.rename(at, target):
        raise RuntimeError(f"another writer has published {name} in {folder}")
