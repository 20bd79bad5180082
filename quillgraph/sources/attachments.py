"""Where an attachment's file is: a cascade over overrides, managed storage, mapped and local paths, by joins with listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions import text as tx
from quillgraph.session import stage

#: Rows that a join may broadcast.
BROADCAST = 100_000


def _sized(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that joins broadcast only if its rows are few. Sizes that are estimated from columns leave out what an
    explode adds, so a listing of millions would pass for a small one."""
    held = stage(df, name)
    return F.broadcast(held) if held.count() <= BROADCAST else held.hint("merge")


def _look_up(rows: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """``rows`` with the columns of ``found`` by a path. Blank paths find nothing; they are spread over the tasks by the rest of
    their row, since most rows may have them. The hash is a second key, so that both sides are exchanged for the join."""
    spread = F.when(F.col(path) == "", F.xxhash64("attachment_key", "persistent_id", "raw_path", "path")).otherwise(F.xxhash64(path))
    return rows.withColumn("_h", spread).join(found.where(F.col(path) != "").withColumn("_h", F.xxhash64(path)), [path, "_h"], "left").drop("_h")


def resolve_attachments(rows: DataFrame, files: DataFrame, overrides: DataFrame, path_map: DataFrame) -> DataFrame:
    """``rows`` with ``file``, ``resolver`` and ``issue_code``: a file or the reason why there is none.

    ``rows``: attachment_key, persistent_id, raw_path, path; ``files``: path, a listing of what exists; ``overrides``: key (an
    attachment key or a persistent id), path; ``path_map``: prefix, folder, where the longest prefix that gives a file wins.
    Order: an override, managed storage (``storage:``), a URL's refusal, the resolved path, the map, then paths that can't be
    local (drive letters, network shares), then the raw path. The map is small and given by the caller; it is counted before
    it is broadcast.
    """
    base = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("attachment_key", "persistent_id", "raw_path", "path")})
    have = _sized(files.select(F.col("path").alias("_have")).distinct(), "listing")
    chosen = _sized(overrides.join(have, F.col("path") == F.col("_have"), "left_semi").groupBy("key").agg(F.min("path").alias("_o")), "overrides")
    out = base.join(chosen.select(F.col("key").alias("attachment_key"), F.col("_o").alias("_o1")), "attachment_key", "left")
    out = out.join(chosen.select(F.col("key").alias("persistent_id"), F.col("_o").alias("_o2")), "persistent_id", "left")
    out = _look_up(out, have.select(F.col("_have").alias("path"), F.lit(True).alias("_there")), "path")
    out = _look_up(out, have.select(F.col("_have").alias("raw_path"), F.lit(True).alias("_raw_there")), "raw_path")
    # Prefixes of any length meet by an equi-join: each raw path offers its beginnings at separators. Paths are known by
    # themselves: numbers given to rows need not be the same where the plan reads them twice.
    slashed = F.lower(F.replace(F.col("raw_path"), F.lit("/"), F.lit("\\")))
    cuts = F.filter(F.sequence(F.lit(1), F.length("_low")), lambda i: (F.substring("_low", i, F.lit(1)) == F.lit("\\")) | (i == F.length("_low")))
    starts = F.flatten(F.transform(cuts, lambda i: F.array(F.struct(i.alias("n"), F.substring("_low", F.lit(1), i).alias("s")), F.struct((i - 1).alias("n"), F.substring("_low", F.lit(1), i - 1).alias("s")))))
    offered = base.select("raw_path").distinct().select("raw_path", F.replace(F.col("raw_path"), F.lit("/"), F.lit("\\")).alias("_raw"), slashed.alias("_low")).where("_low <> ''").select("raw_path", "_raw", F.explode(starts).alias("x"))
    prefixes = path_map.select(F.lower(F.replace(F.trim("prefix"), F.lit("/"), F.lit("\\"))).alias("s"), F.col("folder"))
    if prefixes.count() <= BROADCAST:
        prefixes = F.broadcast(prefixes)
    rest = F.regexp_replace(F.substr("_raw", F.col("x.n") + 1), r"^\\+", "")
    mapped = offered.join(prefixes, F.col("x.s") == F.col("s")).select("raw_path", F.length("s").alias("_n"), F.when(rest == "", F.col("folder")).otherwise(F.concat("folder", F.lit("/"), F.replace(rest, F.lit("\\"), F.lit("/")))).alias("_m"))
    longest = _sized(mapped.join(have, F.col("_m") == F.col("_have"), "left_semi").groupBy("raw_path").agg(F.max_by("_m", "_n").alias("_m")), "mapped")
    out = _look_up(out, longest, "raw_path")
    raw = F.col("raw_path")
    stored = F.lower(raw).startswith("storage:")
    url, drive, share = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+://"), raw.rlike(r"^[A-Za-z]:[\\/]"), raw.startswith("\\\\")
    there = F.coalesce("_there", F.lit(False)) & (F.col("path") != "")
    states = (
        ((raw == "") & (F.col("path") == ""), None, "", "missing_attachment_path"),
        (F.coalesce("_o1", "_o2").isNotNull(), F.coalesce("_o1", "_o2"), "attachment_override", None),
        (stored & there, F.col("path"), "local_storage", None),
        (stored, None, "local_storage", "storage_missing_local"),
        (url, None, "linked_url", "linked_url"),
        (there, F.col("path"), "local_linked_path", None),
        (F.col("_m").isNotNull(), F.col("_m"), "linked_path_map", None),
        (drive, None, "linked_path", "linked_windows_path"),
        (share, None, "linked_path", "linked_unc_path"),
        (F.coalesce("_raw_there", F.lit(False)), raw, "local_linked_path", None),
    )
    file, resolver, issue = F.lit(None).cast("string"), F.lit("local_linked_path"), F.lit("local_path_missing")
    for holds, path, name, code in reversed(states):
        file = F.when(holds, F.lit(None).cast("string") if path is None else path).otherwise(file)
        resolver = F.when(holds, F.lit(name)).otherwise(resolver)
        issue = F.when(holds, F.lit(code)).otherwise(issue)
    return out.select(*rows.columns, file.alias("file"), resolver.alias("resolver"), issue.alias("issue_code"))


def locate_sidecars(stems: DataFrame, files: DataFrame, key: str = "stem") -> DataFrame:
    """(key, path) of the recognised text of each stem: folders in order, in each an equal stem before an equal look-up key.

    ``files``: path, stem, folder_order. Stems without letters and digits find nothing.
    """
    wanted = stems.select(F.col(key).alias("_stem"), tx.lookup_key(F.col(key)).alias("_key")).where("_key <> ''").distinct()
    have = files.select("path", F.col("stem").alias("_fstem"), "folder_order", tx.lookup_key(F.col("stem")).alias("_key"))
    place = F.row_number().over(Window.partitionBy("_stem").orderBy("folder_order", F.desc(F.col("_stem") == F.col("_fstem")), "path"))
    return wanted.join(have, "_key").withColumn("_place", place).where("_place = 1").select(F.col("_stem").alias(key), "path")
