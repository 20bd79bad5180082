"""ZIP archives as tables: members in parallel, read through the archive's directory, so that no archive is held whole.

An archive's place is a path that Arrow's file systems open (local and mounted folders, HDFS, S3, GCS). Listing is Spark's.
Directories are read in tasks and cut into ranges of members; ranges are dealt out, and each member is one row. What can't be
read is a row with an issue instead of a content, and doesn't stop the rest.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of members that one range is made for, and members of a range.
RANGE_BYTES, RANGE_MEMBERS = 64 << 20, 1000
#: A member beyond is an issue: a row's content has to fit in a task.
MOST_BYTES = 512 << 20


def safe_member(name: str) -> str | None:
    """An archive member's path without roots, drives and steps upwards; none where nothing is left."""
    parts = [p for p in PurePosixPath(name.replace("\\", "/")).parts if p not in ("", "/", ".", "..") and not p.endswith(":")]
    return "/".join(parts) or None


def opened(path: str):
    """A seekable file at a path as Spark lists it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _wanted(z: zipfile.ZipFile, suffix: str) -> list[tuple[str, zipfile.ZipInfo]]:
    return [(name, i) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(suffix) and (name := safe_member(i.filename))]


def list_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, signature, length) of the archives below a folder; the signature changes with place, time and size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    signature = F.sha1(F.concat_ws("::", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")))
    return found.select(F.col("path").alias("archive"), signature.alias("signature"), "length")


def member_ranges(archives: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(archive, signature, first, last, bytes, issue): runs of an archive's wanted members by number; one row with an issue
    for an archive whose directory can't be read, and one without numbers for one that has no such member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for archive, signature in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with opened(archive) as f, zipfile.ZipFile(f) as z:
                        sizes = [i.file_size for _, i in _wanted(z, suffix)]
                except Exception as error:
                    out.append((archive, signature, None, None, None, f"archive_unreadable: {type(error).__name__}"))
                    continue
                first, held = 0, 0
                for k, size in enumerate(sizes):
                    held += size
                    if held >= RANGE_BYTES or k - first + 1 >= RANGE_MEMBERS or k == len(sizes) - 1:
                        out.append((archive, signature, first, k, held, None))
                        first, held = k + 1, 0
                if not sizes:
                    out.append((archive, signature, None, None, 0, None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["archive", "signature", "first", "last", "bytes", "issue"])

    return archives.select("archive", "signature").mapInArrow(run, "archive string, signature string, first long, last long, bytes long, issue string")


def read_members(ranges: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(archive, signature, member, size, content, issue): the members of each range, one at a time; an archive without any
    has one row without a member."""
    names = ["archive", "signature", "member", "size", "content", "issue"]
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["first"] is None:
                    yield row(r["archive"], r["signature"], None, None, None, r["issue"])
                    continue
                try:
                    with opened(r["archive"]) as f, zipfile.ZipFile(f) as z:
                        for name, info in _wanted(z, suffix)[r["first"] : r["last"] + 1]:
                            content, issue = None, "member_too_large" if info.file_size > MOST_BYTES else None
                            if not issue:
                                try:
                                    content = z.read(info)
                                except Exception as error:
                                    issue = f"member_unreadable: {type(error).__name__}"
                            yield row(r["archive"], r["signature"], name, info.file_size, content, issue)
                except Exception as error:
                    yield row(r["archive"], r["signature"], None, None, None, f"archive_unreadable: {type(error).__name__}")

    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are small rows: dealt out evenly, whatever archive they are of.
    return ranges.repartition(parts, F.xxhash64("archive", "first")).mapInArrow(run, "archive string, signature string, member string, size long, content binary, issue string")


def changed_archives(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """Archives that ``manifest(archive, signature)`` doesn't hold as they are now."""
    return archives.join(manifest.select("archive", "signature").distinct(), ["archive", "signature"], "left_anti").select(*archives.columns)


def read_archive_members(spark: SparkSession, path: str, suffix: str = ".pdf", manifest: DataFrame | None = None) -> DataFrame:
    """(archive, signature, member, size, content, issue) of all archives below a folder, without those that ``manifest``
    holds unchanged; see ``manifest_of``. Damaged archives and members have a row with an issue."""
    archives = list_archives(spark, path)
    return read_members(member_ranges(archives if manifest is None else changed_archives(archives, manifest), suffix), suffix)


def manifest_of(members: DataFrame) -> DataFrame:
    """(archive, signature, members) of the archives that were read without an issue; others are tried again next time."""
    rows = members.groupBy("archive", "signature").agg(F.count("member").alias("members"), F.count("issue").alias("issues"))
    return rows.where("issues = 0").drop("issues")


def archive_summary(archives: DataFrame, members: DataFrame) -> DataFrame:
    """One row: archives in all, unchanged ones that weren't read, failures, members read."""
    read = members.agg(F.count_distinct("archive").alias("touched"), F.count_distinct(F.when(F.col("issue").startswith("archive"), F.col("archive"))).alias("failures"), F.count_if(F.col("content").isNotNull()).alias("members"))
    total = archives.agg(F.count("*").alias("archives"))
    return total.crossJoin(F.broadcast(read)).select("archives", (F.col("archives") - F.col("touched")).alias("unchanged"), "failures", "members")  # one row each
