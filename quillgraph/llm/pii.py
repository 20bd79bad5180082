"""Personal data by fixed forms, and by contexts that those forms teach.

Entities of fixed form (email, ip, card, phone) are the seeds. The two words before an occurrence are its lexical pattern;
every identifier-like token (digits or an at sign) with a pattern is an instance, seed or not. Spark then scores the graph
of patterns and instances in rounds: a pattern's confidence for a kind is the mean reliability of its distinct instances
(with one doubtful instance added), a seed's reliability is 1, and any other instance's is the mean confidence of its
patterns. Patterns that stay confident, with enough distinct seeds, name identifiers of a form that no rule knows; those
become seeds of the next generation, and so on until no pattern is added.

Only occurrences leave the scan, as hashes with their places; they are few beside the texts. Counts are aggregated before
they are shuffled, so a frequent pattern or value costs a row for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillgraph.session import stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5
CONFIDENCE = 0.75

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# No start within a run of digits can succeed where the run's first digit fails, so starts there are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_BLANK = re.compile(r"[ \t-\r]")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=/\\"
_PLAIN = re.compile(r"[0-9().+-]+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right, bar the last, is doubled."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Entities of fixed form by (start, kind's place in KINDS); leftmost and without overlap within a kind."""
    if not text or not _SIGN.search(text):
        return []
    out: list[Span] = []
    after = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        before = text[after : m.start()]
        start = after + len(before.rstrip(_LOCAL))
        if start < m.start():
            out.append(("email", start, m.end()))
            after = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def identifiers(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Tokens of 5 to 64 characters with three digits or an at sign, clear of ``taken``; number groups are joined."""
    out: list[tuple[int, int]] = []
    at, plain = 0, False
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        b = _BLANK.search(text, m.end())
        end = at = b.start() if b else len(text)
        token = text[start:end]
        start += len(token) - len(token.lstrip(_EDGE.replace("(", "")))
        end -= len(token) - len(token.rstrip(_EDGE.replace(")", "")))
        if start >= end:
            continue
        joins, plain = plain, bool(_PLAIN.fullmatch(text, start, end))
        if joins and plain and out[-1][1] + 1 == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    busy = sorted((s, e) for _, s, e in taken)
    kept, k = [], 0
    for start, end in out:
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        token = text[start : min(end, start + 65)]
        if 5 <= end - start <= 64 and ("@" in token or sum(c in "0123456789" for c in token) >= 3) and not any(s < end and start < e for s, e in busy[k : k + 4]):
            kept.append((start, end))
    return kept


def pattern_before(text: str, start: int) -> str | None:
    """The two words before a place, lower-cased; none where there aren't two within 80 characters."""
    words = text[max(0, start - 80) : start].split()
    # The first word may be cut where the view begins.
    if len(words) < 2 or (start > 80 and len(words) == 2):
        return None
    return " ".join(words[-2:]).lower()


def _hash(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _key(text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & (1 << 64) - 1))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for cell in b.column(0):
            text = cell.as_py()
            if not text or not _SIGN.search(text):
                continue
            base = base_spans(text)
            k1, k2 = _key(text)
            for kind, s, e in [*base, *((None, s, e) for s, e in identifiers(text, base))]:
                if pattern := pattern_before(text, s):
                    rows.append((k1, k2, _hash(pattern), _hash(text[s:e].lower()), kind, s, e))
        names = ["k1", "k2", "pattern", "value", "kind", "start", "end"]
        types = [pa.int64()] * 4 + [pa.string(), pa.int32(), pa.int32()]
        columns = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _score_once(edges: DataFrame, seeds: DataFrame, rounds: int, least_seeds: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """One generation: (pattern, kind, confidence) of the confident patterns, and (pattern, value, seed) of all that seeds teach."""
    graph = edges.join(seeds, "value", "left")
    # A pattern that no seed follows often enough can never be confident.
    taught = graph.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("n")).where(F.col("n") >= least_seeds)
    near = stage(graph.join(stage(taught.select("pattern", "kind"), "taught"), "pattern"), "pattern-graph")

    def reliability(mean: Column) -> Column:
        return F.when(F.col("seed") == F.col("kind"), F.col("weight")).when(F.col("seed").isNull(), mean).otherwise(0.0).alias("reliability")

    reliable = near.select("value", "kind", reliability(F.lit(0.0))).distinct()
    trust = None
    for _ in range(rounds):
        # Both sides of each join are tables, so that a pattern or value of many edges can be split.
        trust = stage(near.join(stage(reliable, "reliable"), ["value", "kind"]).groupBy("pattern", "kind").agg((F.sum("reliability") / (F.count("*") + 1)).alias("confidence")), "trust")
        learned = near.join(trust, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("seed").alias("seed"), F.max("weight").alias("weight"), F.avg("confidence").alias("mean"))
        reliable = learned.select("value", "kind", reliability(F.col("mean")))
    best = Window.partitionBy("pattern").orderBy(F.desc("confidence"), "kind")
    confident = trust.where(F.col("confidence") >= confidence).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    return stage(confident, "confident"), near.select("pattern", "value", "kind", "seed")


def score_patterns(occurrences: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE, generations: int | None = None) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns, one kind for each.

    After each generation the unseen values that its confident patterns precede become seeds, weighted by the mean
    confidence of those patterns (of several kinds the one of the highest mean), and teach the patterns that aren't
    confident yet; it ends when no pattern is added, or after ``generations``.
    """
    edges = stage(occurrences.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    seeds = stage(edges.where("kind is not null").groupBy("value").agg(F.max("kind").alias("seed")).withColumn("weight", F.lit(1.0)), "seeds")
    edges, accepted, done = edges.drop("kind"), None, 0
    while generations is None or done < generations:
        left = edges if accepted is None else edges.join(accepted.select("pattern"), "pattern", "left_anti")
        confident, near = _score_once(left, seeds, rounds, least_seeds, confidence)
        done += 1
        accepted = confident if accepted is None else stage(accepted.unionByName(confident), "accepted")
        if confident.isEmpty():
            break
        means = near.where("seed is null").join(confident, ["pattern", "kind"]).groupBy("value", "kind").agg(F.avg("confidence").alias("weight"))
        best = Window.partitionBy("value").orderBy(F.desc("weight"), "kind")
        fresh = means.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("value", F.col("kind").alias("seed"), "weight")
        seeds = stage(seeds.unionByName(fresh), "seeds")
    return accepted


def _with_base(n_others: int, names: list[str], spans: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, k1s, k2s = [], [], []
            for i, cell in enumerate(b.column(n_others)):
                text = cell.as_py()
                found = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                # A key that meets nothing still spreads its rows.
                k1, k2 = _key(text) if text else (i, None)
                k1s.append(k1)
                k2s.append(k2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, spans), pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64())], names=names)

    return run


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with ``base_spans`` and ``added_spans``: arrays of (kind, start, end), code points, end exclusive.

    Base spans are sorted by start, then by KINDS. Added spans are identifiers after a confident pattern; their kind is
    ``context_`` and the kind that taught the pattern, and they meet no base span. Null and blank texts have empty arrays. Repeated rows count once for the scores (values and patterns are distinct).
    Columns of ``docs`` named ``base_spans`` or ``added_spans`` are replaced; all others stay. Empty tables stay empty.
    """
    others = [c for c in docs.columns if c not in (text, "base_spans", "added_spans")]
    # Plain names inside, so that no column of the input clashes.
    inner = [f"c{i}" for i in range(len(others))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, inner, strict=True)], F.col(f"`{text}`").alias("t"))
    occurrences = stage(source.select("t").mapInArrow(_occurrences, "k1 long, k2 long, pattern long, value long, kind string, start int, end int"), "occurrences")
    patterns = score_patterns(occurrences, rounds, least_seeds, confidence).select("pattern", F.col("kind").alias("taught"))
    # A table: Spark sees its size, and beyond a broadcast can split the copies of one text in the last join.
    added = stage(
        occurrences.where("kind is null")
        .join(patterns, "pattern")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct(F.concat(F.lit("context_"), "taught").alias("kind"), "start", "end")).alias("added_spans")),
        "added",
    )
    schema = source.withColumns({"base_spans": F.lit(None).cast(_SPANS), "k1": F.lit(None).cast("long"), "k2": F.lit(None).cast("long")}).schema
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    marked = source.mapInArrow(_with_base(len(inner), schema.names, spans), schema)
    joined = marked.join(added, ["k1", "k2"], "left")
    return joined.select(
        *[F.col(n).alias(c) for c, n in zip(others, inner, strict=True)],
        F.col("t").alias(text),
        "base_spans",
        F.coalesce("added_spans", F.array().cast(_SPANS)).alias("added_spans"),
    ).select(*[c if c == text else f"`{c}`" for c in docs.columns if c not in ("base_spans", "added_spans")], "base_spans", "added_spans")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``find_personal_data`` with each span replaced by its kind in brackets; span columns go.

    Spans that touch or overlap become one, with the first one's kind. Nothing else in a text changes.
    """
    spans = F.concat("base_spans", "added_spans")
    # Code points from right to left, so that earlier places stay valid; overlapping spans are merged first.
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    cut = F.aggregate(
        F.reverse(F.col("_merged")),
        F.col(f"`{text}`"),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), s["kind"], F.lit("]"), F.substring(t, s["end"] + 1, F.length(t))),
    )
    changed = F.when(F.size("_merged") > 0, cut).otherwise(F.col(f"`{text}`"))
    return found.withColumn("_merged", merged).withColumn(text, changed).drop("_merged", "base_spans", "added_spans")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digests and places of personal data in every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def rank(kind):
        return F.when(kind == KINDS[0], 0).when(kind == KINDS[1], 1).when(kind == KINDS[2], 2).when(kind == KINDS[3], 3).otherwise(4)

    def joined(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base_spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.concat("base_spans", "added_spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
SQL: dict[str, str] = {}
