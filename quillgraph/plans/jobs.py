"""Datasets of exact size, scoped duplicates, archives and reported streams over the driver's tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import resolution as r, sampling
from quillgraph.plans import tables as t
from quillgraph.plans.graph import _DUP
from quillgraph.plans.tables import table
from quillgraph.session import fresh_path
from quillgraph.sources import archives
from quillgraph.streaming import jobs

PRIORITY = {"gold": 3, "silver": 2, "synthetic": 1}
STAGES = {"stage1": ({"silver": 2, "synthetic": 1}, {"split": 2}, 700), "stage2": ({"gold": 3, "silver": 1}, {}, 0)}
SHARE, SEED = 0.1, 42


def exact_split(spark, sf):
    """Documents for evaluation, exactly a tenth of them, and for training."""
    return sampling.exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARE, SEED)


def curriculum_rows(spark, sf):
    """Documents as examples of three tiers, of equal texts the best tier: two training stages and evaluation."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    tier = F.when(F.col("quality") == 1, "gold").when(F.col("quality") == 0, "silver").otherwise("synthetic")
    rows = docs.select(F.md5("text").alias("key"), tier.alias("tier"), F.when(F.length("text") % 3 == 0, "split").otherwise("parse").alias("task"))
    return sampling.curriculum(rows, "key", "tier", "task", PRIORITY, STAGES, SHARE, SEED).select("key", "tier", "task", "split", "stage", "copy")


def scoped_groups(spark, sf):
    """The duplicate groups that hold one of every fifty articles, found from those articles."""
    rows = t.articles(spark, sf).select("article_id", F.md5("text").alias("k1"), tx.title_year_key(F.col("title"), F.col("year")).alias("k2"))
    return r.groups_within(rows, "article_id", ["k1", "k2"], rows.where("article_id % 50 = 0"))


def archive_members(spark, sf):
    """Documents packed into archives of some hundreds, and read back."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "lang", "text"), fresh_path(spark, "archives")
    place = folder.removeprefix("file:")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for k, lang, text in zip(rows["doc_id"], rows["lang"], rows["text"], strict=True):
                z.writestr(f"../{lang or 'none'}/{k}.txt", text or "")
        system, inner = (fs.LocalFileSystem(), "/" + place.lstrip("/")) if folder.startswith(("file:", "/")) else fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/{int(rows['part'].iloc[0])}.zip"
        with system.open_output_stream(name) as out:
            out.write(data.getvalue())
        return pd.DataFrame({"archive": [name]})

    parts = max(1, docs.count() // 300)
    docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).groupBy("part").applyInPandas(pack, "archive string").collect()
    read = archives.read_archive_members(spark, folder, ".txt")
    return read.select(F.regexp_extract("member", "([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"), F.regexp_extract("member", "^([a-z]+)/", 1).alias("lang"), "size", F.md5("content").alias("text_md5"), F.coalesce("issue", F.lit("")).alias("issue"))


def progress_events(spark, sf):
    """What a job reports that streams the events, a file at a time, into a table: batches, rows, and how it ended."""
    landing, out, mark, told = (fresh_path(spark, n) for n in ("landing", "events", "mark", "progress"))
    events = table(spark, sf, "events")
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(landing)
    listener = jobs.ProgressRows(spark, told)
    spark.streams.addListener(listener)
    background = jobs.Jobs(spark, "ingest")

    def ingest(job: jobs.Job) -> int:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        writer = source.writeStream.queryName("ingest").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).format("parquet")
        job.stream(writer).awaitTermination()
        job.progress(90, "written")
        return spark.read.parquet(out).count()

    try:
        background.start("ingest", ingest)
        state = background.wait("ingest")
        jobs.settle(spark)
    finally:
        spark.streams.removeListener(listener)
    rows = jobs.read_progress(spark, told).where("kind <> 'progress' or rows > 0")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).withColumns({"status": F.lit(state["status"]), "percent": F.lit(state["percent"]), "written": F.lit(state["result"]).cast("long")})


QUERIES = {f.__name__: f for f in (exact_split, curriculum_rows, scoped_groups, archive_members, progress_events)}


def _size(n: str) -> str:
    half = f"CAST(round_even({n} * {SHARE}, 0) AS BIGINT)"
    return f"CASE WHEN {n} >= 8 THEN greatest(1, least({n} - 1, {half})) ELSE greatest(0, least({n} - 1, {half})) END"


def _stage_sql(name: str) -> str:
    tiers, tasks, most = STAGES[name]
    pick = lambda c, weights, other: f"CASE {' '.join(f'''WHEN {c} = '{k}' THEN {w}''' for k, w in weights.items())} ELSE {other} END" if weights else str(other)
    rows = f"SELECT key, tier, task, split, '{name}' AS stage, CAST(unnest(range(1, {pick('tier', tiers, 0)} * {pick('task', tasks, 1)} + 1)) AS INTEGER) AS copy FROM s WHERE split = 'train'"
    if not most:
        return rows
    return f"SELECT key, tier, task, split, stage, copy FROM (SELECT *, row_number() OVER (ORDER BY md5('{SEED + len(name)}:' || key || ':' || copy)) AS i FROM ({rows})) WHERE i <= {most}"


SQL = {
    "exact_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || doc_id)) <= {_size('count(*) OVER ()')} THEN 'eval' ELSE 'train' END AS split FROM documents",
    "curriculum_rows": f"""WITH e AS (SELECT md5(text) AS key, CASE quality WHEN 1 THEN 'gold' WHEN 0 THEN 'silver' ELSE 'synthetic' END AS tier, CASE WHEN length(text) % 3 = 0 THEN 'split' ELSE 'parse' END AS task FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE tier WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 ELSE 1 END DESC, tier, task) = 1),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tier ORDER BY md5(({SEED} + length(tier)) || ':' || key)) <= {_size('count(*) OVER (PARTITION BY tier)')} THEN 'eval' ELSE 'train' END AS split FROM k)
SELECT key, tier, task, split, 'eval' AS stage, CAST(1 AS INTEGER) AS copy FROM s WHERE split = 'eval' UNION ALL {_stage_sql("stage1")} UNION ALL {_stage_sql("stage2")}""",
    "scoped_groups": f"WITH RECURSIVE {t.ARTICLES}, {_DUP} SELECT article_id, \"group\" FROM dup WHERE \"group\" IN (SELECT \"group\" FROM dup WHERE article_id % 50 = 0)",
    "archive_members": "SELECT doc_id, lang, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS text_md5, '' AS issue FROM documents",
    "progress_events": "SELECT kind, CASE kind WHEN 'progress' THEN 4 ELSE 1 END AS n, CASE kind WHEN 'progress' THEN c ELSE 0 END AS rows, 'completed' AS status, CAST(100 AS DOUBLE) AS percent, c AS written FROM (SELECT unnest(['started', 'progress', 'terminated']) AS kind), (SELECT count(*) AS c FROM events)",
}
