"""Building and scoring datasets: de-duplication by priority, splits, replication, windows, metrics, differences."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as tx
from quillgraph.operators.resolution import _common_subsequence


def dedupe_by_priority(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by the given order: higher priority, then earlier."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def split_by_hash(rows: DataFrame, key: str, eval_share: float) -> DataFrame:
    """``rows`` with ``split``: eval for the given share of keys, by a hash of the key; no sort, no shuffle."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("split", F.when(bucket < int(eval_share * (1 << 32)), "eval").otherwise("train"))


def replicate(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight says, numbered from 1; weights below 1 leave none."""
    return rows.withColumn("_w", weight.cast("int")).where("_w >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w")


def prf(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of two arrays as sets, by row; an empty side counts as 0, two empty ones as 1."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(g, p))
    empty = (F.size(g) == 0) & (F.size(p) == 0)
    share = lambda n: F.when(empty, 1.0).when(F.size(n) > 0, hit / F.size(n).cast("double")).otherwise(0.0)
    out = rows.withColumns({"precision": share(p), "recall": share(g)})
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def error_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: n, mean absolute error, root of the mean squared error, share of exact hits."""
    e = F.col(predicted).cast("double") - F.col(gold).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((e == 0).cast("double")).alias("exact"))


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, state): added, removed or kept; each key once."""
    b, a = before.select(key).distinct().withColumn("_b", F.lit(1)), after.select(key).distinct().withColumn("_a", F.lit(1))
    return b.join(a, key, "full").select(key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("kept").alias("state"))


def batches(rows: DataFrame, size: int, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``batch``: groups of ``size`` in order, counted from 0 within each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("int"))


@dataclass(frozen=True)
class Template:
    """A question and its directive's fields, with slots in braces; drawn as often as its weight says."""

    name: str
    weight: int
    question: str
    authors: str = ""
    years: str = ""
    title_terms: str = ""
    content_terms: str = ""


def _draw(key: str, salt: str, n: int) -> Column:
    """A number below ``n`` by a hash of the key: any engine draws the same."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def query_rewrites(rows: DataFrame, key: str, templates: Sequence[Template], vocabulary: Mapping[str, Sequence[str]], most: int = 10_000) -> DataFrame:
    """One synthetic question for each key and the directive that rewrites it; each question once, with its least key.

    Returns (key, template, question, directive, compact_query). Slots are filled from ``vocabulary``, at most ``most`` values
    in all, since they are part of the plan. Rows without a key leave none.
    """
    if sum(map(len, vocabulary.values())) > most or not all(vocabulary.values()):
        raise ValueError(f"each slot needs values, and all together {most} at most")
    slots = {name: F.array(*map(F.lit, values))[_draw(key, name, len(values)).cast("int")] for name, values in vocabulary.items()}

    def filled(text: str) -> Column:
        pieces = [c for fixed, slot, *_ in Formatter().parse(text) for c in ([F.lit(fixed)] if fixed else []) + ([slots[slot]] if slot else [])]
        return F.concat(*pieces) if pieces else F.lit("")

    def chosen(make) -> Column:
        out, upto = None, 0
        for t in templates:
            upto += t.weight
            out = (F if out is None else out).when(F.col("_r") < upto, make(t))
        return out

    def terms(field: str) -> Column:
        words = F.array_distinct(F.regexp_extract_all(F.lower(chosen(lambda t: filled(getattr(t, field)))), F.lit("[a-z0-9][a-z0-9'-]*"), F.lit(0)))
        return F.array_join(F.filter(words, lambda w: ~w.isin("and", "or", "not")), " ")

    fields = ("authors", "years", "title_terms", "content_terms")
    drawn = rows.select(key).where(F.col(key).isNotNull()).withColumn("_r", _draw(key, "template", sum(t.weight for t in templates)))
    made = drawn.select(key, chosen(lambda t: F.lit(t.name)).alias("template"), chosen(lambda t: filled(t.question)).alias("question"), *[terms(f).alias(f) for f in fields])
    once = made.groupBy(F.lower("question").alias("_q")).agg(F.min_by(F.struct(*made.columns), key).alias("row")).select("row.*")
    shown = [F.concat(F.lit(f"{f}: "), F.when(F.col(f) == "", "none").otherwise(F.col(f))) for f in fields]
    return once.select(key, "template", "question", F.concat_ws(" | ", *shown).alias("directive"), F.array_join(F.array_remove(F.array(*fields), ""), " ").alias("compact_query"))


def chat_rows(rows: DataFrame, system: str, user: str, assistant: str) -> DataFrame:
    """``rows`` with ``messages``: a system text and two columns as the user's and the assistant's turns."""
    turns = [("system", F.lit(system)), ("user", F.col(user)), ("assistant", F.col(assistant))]
    return rows.withColumn("messages", F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns]))


def first_by_title(catalogue: DataFrame, title: str = "title", place: str = "place") -> DataFrame:
    """Catalogue records by normalised title, the first by ``place`` of each; blank titles have none. Adds ``title_key``."""
    keyed = catalogue.withColumn("title_key", tx.normalize_title(F.col(title))).where("title_key <> ''")
    return dedupe_by_priority(keyed, "title_key", F.asc(place))


def join_by_title(citations: DataFrame, catalogue: DataFrame, title: str = "title_guess") -> DataFrame:
    """``citations`` with ``record``, the catalogue's first record of the same title, and where the target comes from."""
    index = first_by_title(catalogue)
    rest = [c for c in index.columns if c != "title_key"]
    records = index.select(F.col("title_key").alias("_key"), F.struct(*rest).alias("record"))
    joined = citations.withColumn("_key", tx.normalize_title(F.col(title))).join(records, "_key", "left").drop("_key")
    return joined.withColumn("origin", F.when(F.col("record").isNotNull(), "catalogue_title").otherwise("heuristic_citation"))


def preview_summary(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """One row of counts of a preview, the first ``most`` rows in order: resolved, shown, truncated, to be ingested, existing,
    with metadata. Tasks keep ``most`` rows each; nothing ranks them all."""
    first = rows.select("will_ingest", "existing", "has_metadata", *[c.alias(f"_o{i}") for i, c in enumerate(order)]).orderBy(*[f"_o{i}" for i in range(len(order))]).limit(most)
    shown = first.agg(F.count("*").alias("total_previewed"), *[F.count_if(c).alias(c) for c in ("will_ingest", "existing", "has_metadata")])
    total = rows.agg(F.count("*").alias("total_resolved"), (F.count("*") > most).alias("truncated"))
    return total.crossJoin(F.broadcast(shown))  # one row each


def spaced_out(rows: DataFrame, key: str, position: str, gap: int = 8) -> DataFrame:
    """(key, position): the first position of each key, and then each that is ``gap`` or more past the last one kept."""
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(None).cast("bigint").alias("last"))
    kept = F.aggregate(
        F.array_sort(F.collect_set(F.col(position).cast("bigint"))), start,
        lambda s, x: F.when(s["last"].isNotNull() & (x - s["last"] < gap), s).otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), x.alias("last"))),
        lambda s: s["kept"],
    )
    return rows.groupBy(key).agg(kept.alias("_kept")).select(key, F.explode("_kept").alias(position))


def sections_of_chunks(chunks: DataFrame, key: str, position: str, label: str) -> DataFrame:
    """(key, section, label, start, end): chunks of one label are a section, numbered from 0 by their first chunk."""
    spans = chunks.groupBy(key, label).agg(F.min(position).alias("start"), F.max(position).alias("end"))
    return spans.withColumn("section", F.row_number().over(Window.partitionBy(key).orderBy("start", label)) - 1).select(key, "section", label, "start", "end")


def exclude_ids(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't in a list, such as one that ``read_json_lines`` gives."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti").select(*rows.columns)


def similarity(a: str, b: str) -> float:
    """The larger of difflib's ratio and the share of words that two canonical references have in common."""
    if not a or not b:
        return 0.0
    mine, other = set(a.split()), set(b.split())
    return max(SequenceMatcher(None, a, b).ratio(), len(mine & other) / len(mine | other))


def _letters(a: Counter, b: Counter) -> int:
    """How many characters two strings have in common."""
    return sum(min(n, b[c]) for c, n in a.items() if c in b)


def _greedy_hits(gold: list[str], predicted: list[str], threshold: float) -> int:
    """Every gold reference takes the first of the most similar ones that are free; by ``similarity``.

    difflib is asked only where bounds of its ratio, from lengths, characters and the longest common subsequence (its blocks
    are one), reach the threshold and pass the best so far.
    """
    better = lambda x, best: x >= threshold and x > best
    free, hits = [(p, set(p.split()), Counter(p)) for p in predicted if p], 0
    for g in gold:
        mine, own, places = set(g.split()), Counter(g), defaultdict(int)
        best, at = 0.0, -1
        for i, (p, other, letters) in enumerate(free):
            few, many, total = min(len(mine), len(other)), max(len(mine), len(other)), len(g) + len(p)
            score = len(mine & other) / len(mine | other) if many and better(few / many, best) else 0.0
            if score < 1 and better(2.0 * min(len(g), len(p)) / total, best) and better(2.0 * sum(min(n, letters[c]) for c, n in own.items()) / total, best):
                if not places:
                    for k, c in enumerate(g):
                        places[c] |= 1 << k
                if better(2.0 * _common_subsequence(places, len(g), p) / total, best):
                    score = similarity(g, p)
            if better(score, best):
                best, at = score, i
        if at >= 0:
            free.pop(at)
            hits += 1
    return hits


def with_forms(rows: DataFrame, references: str, out: str) -> DataFrame:
    """``rows`` with ``out``, an array of references as ``fuzzy_scores`` takes it: ``n`` different ones and their canonical forms.

    References count once each in lower case with white space squeezed, and are compared in canonical form (``eval_canon``),
    in order of the former.
    """
    forms = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(references), F.array().cast("array<string>")), tx.eval_form), lambda x: x != "")))
    canon = F.filter(F.transform("_forms", tx.canon_of_form), lambda x: x != "")
    return rows.withColumn("_forms", forms).withColumn(out, F.struct(F.size("_forms").alias("n"), canon.alias("canon"))).drop("_forms")


def fuzzy_prf(rows: DataFrame, gold: str, predicted: str, threshold: float = 0.72) -> DataFrame:
    """``rows`` with fuzzy_overlap, fuzzy_precision, fuzzy_recall and fuzzy_f1 of two arrays of references.

    Every gold one takes the most similar predicted one that is still free, if ``similarity`` reaches the threshold.
    """
    return fuzzy_scores(with_forms(with_forms(rows, gold, "_g"), predicted, "_p"), "_g", "_p", threshold).drop("_g", "_p")


def fuzzy_scores(rows: DataFrame, gold: str, predicted: str, threshold: float = 0.72) -> DataFrame:
    """The scores of ``fuzzy_prf`` from columns of ``with_forms``; a null one has no references."""

    @F.pandas_udf("int")
    def hits(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_greedy_hits(list(a), list(b), threshold) for a, b in zip(g, p, strict=True)], dtype="int32")

    canon = lambda c: F.coalesce(F.col(f"{c}.canon"), F.array().cast("array<string>"))
    counted = rows.withColumn("fuzzy_overlap", hits(canon(gold), canon(predicted)))
    share = lambda c: F.when(F.col(f"{c}.n") > 0, F.col("fuzzy_overlap") / F.col(f"{c}.n").cast("double")).otherwise(0.0)
    out = counted.withColumns({"fuzzy_precision": share(predicted), "fuzzy_recall": share(gold)})
    total = F.col("fuzzy_precision") + F.col("fuzzy_recall")
    return out.withColumn("fuzzy_f1", F.when(total > 0, 2 * F.col("fuzzy_precision") * F.col("fuzzy_recall") / total).otherwise(0.0))


def macro_scores(rows: DataFrame, *scores: str) -> DataFrame:
    """One row: n and the mean of each score over all rows, of no rows 0."""
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(s), F.lit(0.0)).alias(f"macro_{s}") for s in scores])


def section_eval(rows: DataFrame, gold_start: str, guess_start: str, gold_heads: str, guess_heads: str) -> DataFrame:
    """``rows`` with delta, exact_match, and precision, recall and F1 of the heading lines; no guess is no match."""
    delta = F.col(guess_start) - F.col(gold_start)
    none = F.array().cast("array<int>")
    g, p = (F.array_distinct(F.coalesce(F.col(c).cast("array<int>"), none)) for c in (gold_heads, guess_heads))
    hit = F.size(F.array_intersect(g, p))
    share = lambda n: F.when(F.size(n) > 0, hit / F.size(n).cast("double")).otherwise(0.0)
    out = rows.withColumns({"delta": delta, "exact_match": F.coalesce(delta == 0, F.lit(False)), "heading_precision": share(p), "heading_recall": share(g)})
    total = F.col("heading_precision") + F.col("heading_recall")
    return out.withColumn("heading_f1", F.when(total > 0, 2 * F.col("heading_precision") * F.col("heading_recall") / total).otherwise(0.0))


def parsing_eval(rows: DataFrame, start: str, expected_start: str, entries: str, expected_entries: str) -> DataFrame:
    """One row: cases, those whose start line is right (both may be none), whose number of entries is, and that pass both."""
    first, count = F.col(start).eqNullSafe(F.col(expected_start)), F.coalesce(entries, F.lit(0)) == F.coalesce(expected_entries, F.lit(0))
    return rows.agg(F.count("*").alias("cases"), F.count_if(first).alias("starts"), F.count_if(count).alias("counts"), F.count_if(first & count).alias("passed"))


def ordered_references(references: DataFrame, articles: DataFrame, key: str = "article_id", position: str = "ref_index") -> DataFrame:
    """References of a set of articles by article and position; blanks for missing texts, -1 for missing numbers."""
    rows = references.join(articles.select(key).distinct(), key, "left_semi")
    filled = [F.coalesce(f.name, F.lit("") if f.dataType.typeName() == "string" else F.lit(-1)).alias(f.name) if f.dataType.typeName() in ("string", "integer", "long") and f.name != key else F.col(f.name) for f in rows.schema.fields]
    return rows.select(*filled).orderBy(key, position)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file a task."""
    rows.write.mode("overwrite").json(path)


def write_sidecars(references: DataFrame, path: str, key: str = "article_id", position: str = "ref_index", text: str = "raw_text") -> None:
    """One folder of text for each article, a line a reference in order; articles without references leave none."""
    line = tx.squeeze(F.coalesce(text, F.lit("")))
    rows = references.select(key, position, line.alias("value")).where("value <> ''")
    rows.repartition(key).sortWithinPartitions(key, position).drop(position).write.mode("overwrite").partitionBy(key).text(path)
