"""Work on a catalogue of articles: search by page, choice of files, keywords, heading caps, evaluation of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions import text as tx
from quillgraph.functions.vocabulary import KEYWORD_STOPWORDS
from quillgraph.operators.graph import ordered_names


def search_page(articles: DataFrame, query: str, fields: Sequence[str], order: str, ident: str, page: int, size: int, stored: DataFrame | None = None, available: str | None = None) -> DataFrame:
    """One page of the articles whose fields hold ``query`` as a substring, whatever its case: (ident, total, stored).

    Sorted by ``order`` in lower case and the id; pages count from 0. ``available`` names a boolean column that must be true;
    ``stored(ident)`` marks what the store has. An empty query matches all.
    """
    hay = F.lower(F.concat_ws("\n", *[F.col(f).cast("string") for f in fields]))
    hits = articles.where(hay.contains(query.strip().lower()))
    if available:
        hits = hits.where(F.coalesce(available, F.lit(False)))
    total = hits.agg(F.count("*").alias("total"))
    rows = hits.select(ident, F.lower(order).alias("_order")).orderBy("_order", ident).offset(page * size).limit(size)
    known = rows.limit(0).select(ident) if stored is None else stored.select(ident).distinct()
    marked = rows.join(known.withColumn("stored", F.lit(True)), ident, "left")
    return marked.crossJoin(F.broadcast(total)).select(ident, "total", F.coalesce("stored", F.lit(False)).alias("stored"))


def choose_files(files: DataFrame, stored: DataFrame, ident: str, group: str, usable: str, most: int) -> DataFrame:
    """The first ``most`` usable files of each group, by id, that the store doesn't have."""
    fresh = files.where(F.coalesce(usable, F.lit(False))).join(stored.select(ident).distinct(), ident, "left_anti")
    return fresh.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(ident))).where(F.col("_i") <= most).drop("_i").select(*files.columns)


def keywords(articles: DataFrame, ident: str, seeds: Sequence[str], text: str, limit: int = 32) -> DataFrame:
    """(ident, value, score, origin): ``limit`` keywords at most, 8 to 80 whatever is asked for: the ``seeds``, such as title,
    journal and publisher, normalised and each once, with .95, and then the text's most frequent words, .2 to .9, that are no
    seed themselves; ties by the word."""
    limit = max(8, min(limit, 80))
    norms = F.array_distinct(F.filter(F.array(*[F.coalesce(tx.normalize_title(F.col(c)), F.lit("")) for c in seeds]), lambda x: x != ""))
    given = articles.select(ident, F.slice(norms, 1, limit).alias("_seeds"))
    words = articles.select(ident, F.explode(tx.body_words(F.col(text))).alias("value")).where(tx.is_body_token(F.col("value")) & (F.length("value") >= 4) & ~F.col("value").isin(*KEYWORD_STOPWORDS))
    counts = words.groupBy(ident, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(ident)
    # Words that are seeds count for the greatest number, but take no place.
    ranked = counts.withColumn("_most", F.max("n").over(w)).join(given, ident).where(~F.array_contains("_seeds", F.col("value")))
    top = ranked.withColumn("_place", F.row_number().over(w.orderBy(F.desc("n"), "value"))).where(F.col("_place") <= limit - F.size("_seeds"))
    body = top.select(ident, "value", F.least(F.lit(0.9), 0.2 + F.col("n") / F.col("_most").cast("double")).alias("score"), F.lit("heuristic_tokens").alias("origin"))
    return given.select(ident, F.explode("_seeds").alias("value"), F.lit(0.95).alias("score"), F.lit("metadata_seed").alias("origin")).unionByName(body)


def cap_headings(lines: DataFrame, key: str, position: str = "line_no", most: int = 160) -> DataFrame:
    """The first and the last ``most`` / 2 lines of each key; all where there are no more than ``most``."""
    w = Window.partitionBy(key)
    ranked = lines.withColumns({"_up": F.row_number().over(w.orderBy(position)), "_down": F.row_number().over(w.orderBy(F.desc(position)))})
    return ranked.where((F.col("_up") <= most // 2) | (F.col("_down") <= most // 2)).drop("_up", "_down")


def golden_eval(answers: DataFrame, keys: Sequence[str], words: str, expected: Sequence[str], forbidden: Sequence[str], top: int = 3) -> DataFrame:
    """(keys, passed): whether one of the expected words is among a text's ``top`` most frequent ones, and no forbidden one."""
    counts = answers.select(*keys, F.explode(tx.body_tokens(F.col(words))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    first = counts.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "w"))).where(F.col("_i") <= top)
    found = first.groupBy(*keys).agg(F.max(F.col("w").isin(*expected)).alias("_hit"), F.max(F.col("w").isin(*forbidden)).alias("_bad"))
    return found.select(*keys, (F.col("_hit") & ~F.col("_bad")).alias("passed"))


def batch_totals(rows: DataFrame, batch: str, number: str, name: str, ident: str, most: int) -> DataFrame:
    """(batch, total, first, ids): a batch's sum, its least name, and its first ``most`` ids, ranked before they are collected."""
    totals = rows.groupBy(batch).agg(F.sum(number).alias("total"), F.min(name).alias("first"))
    ids = ordered_names(rows.select(batch, ident, F.col(ident).cast("string").alias("_id")), batch, ident, "_id", most)
    return totals.join(ids, batch).select(batch, "total", "first", F.col("names").alias("ids"))
