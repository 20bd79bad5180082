"""The incremental ingest over the driver's event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.plans.tables import table
from quillgraph.session import fresh_path
from quillgraph.streaming import sync


def incremental_upsert(spark, sf):
    """The last event of each user after the events have come as a stream of files."""
    landing, out, mark = (fresh_path(spark, n) for n in ("landing", "synced", "mark"))
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    events.repartition(4, F.col("event_id") % 4).write.parquet(landing)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    sync.sync_stream(source, out, mark, "user_id", "event_id").awaitTermination()
    return sync.read_synced(spark, out, "user_id", "event_id").select("user_id", "event_id", "event_type")


def windowed_event_counts(spark, sf):
    return sync.windowed_counts(table(spark, sf, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (incremental_upsert, windowed_event_counts)}
SQL = {
    "incremental_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "windowed_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
