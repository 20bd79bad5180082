"""A lasting place for every row of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from quillgraph.session import stage


def placed(df: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``df``'s columns as c0, c1, ... with ``file`` and ``at``, the row's place in its Parquet file; and rows by file.

    Places don't change when a task runs again or a scan is split otherwise. A frame that isn't a scan of Parquet files is
    written to the shared folder first. With ``whole``, so is one that leaves rows of its files out, and the second result
    has each file's number of rows.
    """
    fields = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]

    def look(frame: DataFrame) -> DataFrame:
        return frame.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(frame.columns)], *fields)

    try:
        out = look(df)
    except AnalysisException:
        df = stage(df, "placed")
        out = look(df)
    if not whole:
        return out, None

    def sizes(frame: DataFrame) -> DataFrame:
        return stage(frame.groupBy("file").agg(F.count("*").alias("rows"), F.max("at").alias("last")), "files")

    files = sizes(out)
    if files.where("rows <> last + 1").limit(1).count():
        out = look(stage(df, "placed"))
        files = sizes(out)
    return out, files.select("file", "rows")
