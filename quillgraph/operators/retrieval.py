"""Ranked retrieval over chunks: four channels, fusion, strict filter, re-ranking, papers, thresholds.

Every channel ends in its own top-k before anything is joined to it, so what is enriched, fused and re-ranked is bounded by
four times the candidate number, whatever the corpus. Ties go by chunk id.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as tx
from quillgraph.functions.vocabulary import INTENT_STOPWORDS, STOPWORDS, Vocabulary
from quillgraph.operators.graph import first_distinct
from quillgraph.operators.index import bm25, cosine_top
from quillgraph.operators.store import Store
from quillgraph.session import side_by_side, stage

CHANNELS = ("vector", "token", "author", "title")
#: Rows of candidates that a plan holds itself.
HELD = 2000


@dataclass(frozen=True)
class QueryPlan:
    """What a question asks for; made on the driver from the question alone."""

    tokens: tuple[str, ...]
    years: tuple[int, ...]
    phrases: tuple[str, ...]
    author_terms: tuple[str, ...]
    must_terms: tuple[str, ...]
    domain_terms: tuple[str, ...]
    anchor_terms: tuple[str, ...]

    @property
    def strict(self) -> bool:
        return max(len(self.domain_terms), len(self.must_terms), len(self.anchor_terms)) >= 2


def plan_query(question: str, vocabulary: Vocabulary = Vocabulary()) -> QueryPlan:
    """Terms of a question, in order, each once. Must terms are names, acronyms and words of the domain."""
    unique = lambda xs: tuple(dict.fromkeys(xs))
    raw = re.findall(r"[A-Za-z][A-Za-z0-9'-]*", question)
    tokens = unique(t for t in map(str.lower, raw) if len(t) > 1 and t not in STOPWORDS and t not in INTENT_STOPWORDS)
    must = unique(r.lower() for r in raw if len(r) >= 4 and (any(c.isupper() for c in r[1:]) or r.lower() in vocabulary.domain))
    return QueryPlan(
        tokens,
        unique(int(y) for y in re.findall(r"\b(?:19|20)[0-9]{2}\b", question)),
        unique(p.strip().lower() for p in re.findall(r'"([^"]+)"', question) if p.strip()),
        tuple(t for t in tokens if len(t) >= 4),
        must,
        tuple(t for t in tokens if t in vocabulary.domain),
        tuple(t for t in tokens if t in vocabulary.anchors),
    )


@dataclass(frozen=True)
class Corpus:
    """Tables that retrieval reads. ``articles``: article_id, title, year, author, citekey; ``chunks``: chunk_id, article_id,
    chunk_text; ``tokens``: chunk_id, token, count; ``vectors``: chunk_id, embedding; ``cites``: src, dst (article ids).

    With a ``store`` the lexical channels and ``enrich`` read its pruned tables instead; see ``Corpus.stored``.
    """

    articles: DataFrame
    chunks: DataFrame
    tokens: DataFrame
    vectors: DataFrame | None = None
    cites: DataFrame | None = None
    store: Store | None = None

    @staticmethod
    def stored(store: Store) -> Corpus:
        """The corpus of an index that ``store.build_index`` wrote."""
        vectors = store.table("vectors") if store.has_vectors else None
        return Corpus(store.table("articles"), store.table("chunks"), store.table("tokens"), vectors, None, store)


def held(rows: DataFrame, most: int, name: str = "held") -> DataFrame:
    """A set of ``most`` rows at most, computed now: kept in the plan if that is few, else as a table."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema) if most <= HELD else stage(rows, name)


def _together(corpus: Corpus, channels: dict[str, Callable[[], DataFrame]], most: int) -> dict[str, DataFrame]:
    """Each channel's rows; their jobs run side by side."""
    return side_by_side(corpus.chunks.sparkSession, {name: lambda make=make, name=name: held(make(), most, name) for name, make in channels.items()})


def token_query(corpus: Corpus, tokens, limit: int) -> DataFrame:
    """(chunk_id, score): how often the tokens, taken as they are, occur in a chunk."""
    if not tokens:
        hits = corpus.tokens.limit(0)
    else:
        hits = corpus.store.postings(tokens) if corpus.store else corpus.tokens.where(F.col("token").isin(*tokens))
    return hits.groupBy("chunk_id").agg(F.sum("count").cast("double").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def vector_query(corpus: Corpus, query: list[float] | None, limit: int) -> DataFrame:
    """(chunk_id, score) by cosine; none where there are no vectors or no query vector."""
    if corpus.vectors is None or query is None:
        return corpus.chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    if corpus.store:
        return corpus.store.nearest(query, limit)
    return cosine_top(corpus.vectors, "chunk_id", "embedding", query, limit)


def _first_chunks(corpus: Corpus, scored: DataFrame, limit: int) -> DataFrame:
    """Chunks of the best articles: score falling, then the later year, then chunk id."""
    dated = scored if "year" in scored.columns else scored.join(corpus.articles.select("article_id", "year"), "article_id")
    order = (F.desc("score"), F.desc("year"), F.asc("chunk_id"))

    def first(articles: DataFrame) -> DataFrame:
        met = corpus.store.first_chunks(articles) if corpus.store else corpus.chunks.select("chunk_id", "article_id").join(articles, "article_id")
        return held(met.orderBy(*order).limit(limit).select("chunk_id", "score"), limit, "first-chunks")

    # Articles of one score and year stand by their chunks' ids, so all that equal the last of the first ``limit`` come along.
    top = dated.select("score", "year").orderBy(*order[:2]).limit(limit).collect()
    if not top or len(top) < limit:
        return first(dated)
    score, year = top[-1]
    later = F.lit(True) if year is None else F.col("year") >= year
    found = first(dated.where((F.col("score") > score) | ((F.col("score") == score) & later)))
    # Articles without chunks may have taken the places of others.
    return found if found.count() == limit else first(dated)


def author_query(corpus: Corpus, terms, limit: int) -> DataFrame:
    """(chunk_id, score): BM25 of the terms over author names, for all chunks of an article."""
    terms = list(terms)
    scored = corpus.store.bm25("author", terms) if corpus.store and terms else bm25(corpus.articles, "article_id", "author", terms)
    return _first_chunks(corpus, scored, limit)


def title_query(corpus: Corpus, terms, limit: int) -> DataFrame:
    """(chunk_id, score): BM25 of the terms over title and citekey, for all chunks of an article."""
    fields = corpus.articles.select("article_id", F.concat_ws(" ", "title", "citekey").alias("field"))
    terms = [t.lower() for t in terms]
    scored = corpus.store.bm25("title", terms) if corpus.store and terms else bm25(fields, "article_id", "field", terms)
    return _first_chunks(corpus, scored, limit)


def enrich(corpus: Corpus, hits: DataFrame, most: int = HELD) -> DataFrame:
    """Adds text, article and citation neighbours to a set of ``most`` hits at most."""
    if corpus.store:
        return corpus.store.enrich(hits, lambda rows, name: held(rows, most, name))
    small = F.broadcast(hits)
    rows = corpus.chunks.join(small, "chunk_id").join(corpus.articles, "article_id")
    if corpus.cites is None:
        return rows.withColumns({"cites_out": F.array().cast("array<string>"), "cited_by": F.array().cast("array<string>")})
    wanted = rows.select("article_id").distinct()
    titles = corpus.articles.select(F.col("article_id").alias("other"), F.col("title").alias("other_title"))

    def neighbours(own: str, other: str, name: str) -> DataFrame:
        pairs = corpus.cites.select(F.col(own).alias("article_id"), F.col(other).alias("other")).join(wanted, "article_id", "left_semi")
        return first_distinct(pairs.join(titles, "other"), "article_id", "other_title", 5).withColumnRenamed("names", name)

    rows = rows.join(neighbours("src", "dst", "cites_out"), "article_id", "left").join(neighbours("dst", "src", "cited_by"), "article_id", "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("cites_out", "cited_by")})


def fuse(channels: dict[str, DataFrame]) -> DataFrame:
    """(chunk_id, vector, token, author, title, combined, sources): weighted sum of the channels' scores, capped by channel."""
    every = None
    for name in CHANNELS:
        part = channels[name].select("chunk_id", *[(F.col("score") if c == name else F.lit(None).cast("double")).alias(c) for c in CHANNELS])
        every = part if every is None else every.unionByName(part)
    one = every.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in CHANNELS])
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in CHANNELS}
    combined = zero["vector"] + zero["token"] / 10 + F.least(F.lit(1.5), 0.3 * zero["author"]) + F.least(F.lit(2.0), 0.35 * zero["title"])
    sources = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in CHANNELS]))
    return one.select("chunk_id", *[zero[c].alias(c) for c in CHANNELS], combined.alias("combined"), sources.alias("sources"))


def _hits(terms, hay: Column) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + hay.contains(t).cast("int")
    return total


def strict_filter(rows: DataFrame, plan: QueryPlan, vocabulary: Vocabulary) -> DataFrame:
    """Keeps rows that name the question's own terms, unless that would keep none."""
    if not plan.strict:
        return rows
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("chunk_text", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("citekey", F.lit(""))))
    must = [t for t in plan.must_terms if t not in vocabulary.generic]
    required = min(2, len(plan.domain_terms)) if plan.domain_terms else 1
    keep = (_hits(must, hay) > 0 if must else F.lit(True)) & (_hits(plan.domain_terms, hay) >= required)
    if len(plan.anchor_terms) >= 2:
        keep = keep & (_hits(plan.anchor_terms, hay) >= 1)
    marked = rows.withColumn("keep", keep)
    any_kept = marked.agg(F.max("keep").alias("any_kept"))
    return marked.crossJoin(F.broadcast(any_kept)).where("keep or not any_kept").drop("keep", "any_kept")


def rerank(rows: DataFrame, plan: QueryPlan) -> DataFrame:
    """Adds overlaps and ``score``; without tokens the combined score stands."""
    if not plan.tokens:
        return rows.withColumns({"author_overlap": F.lit(0.0), "title_overlap": F.lit(0.0), "score": F.col("combined")})
    asked = F.array(*[F.lit(t) for t in plan.tokens])
    share = lambda c: F.size(F.array_intersect(asked, tx.token_set(F.col(c)))) / F.lit(float(len(plan.tokens)))
    text, title = F.lower(F.coalesce("chunk_text", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    year = F.when(F.col("year").isin(*plan.years), 1.0).otherwise(0.0) if plan.years else F.lit(0.0)
    phrase = F.lit(0.0)
    for p in plan.phrases:
        phrase = phrase + (text.contains(p) | title.contains(p)).cast("int") / F.lit(float(len(plan.phrases)))
    links = F.least(F.lit(0.2), 0.03 * (F.size("cites_out") + F.size("cited_by")))
    semantic = F.greatest("combined", F.col("vector") + F.col("token") / 12 + 0.2 * F.col("author_score"))
    score = semantic + 0.45 * F.col("chunk_overlap") + 0.40 * F.col("title_overlap") + 0.70 * F.col("author_overlap") + 0.30 * year + 0.30 * phrase + links
    hay = F.concat_ws(" ", title, text)
    for terms, most, each, loss in ((plan.domain_terms, 0.75, 0.18, 0.45), (plan.anchor_terms, 0.9, 0.28, 1.1)):
        if terms:
            n = _hits(terms, hay)
            score = score + F.least(F.lit(most), each * n) - F.when(n == 0, loss).otherwise(0.0)
    return rows.withColumns({"chunk_overlap": share("chunk_text"), "title_overlap": share("title"), "author_overlap": share("author")}).withColumn("score", score)


def keep_above(rows: DataFrame, threshold: float | None, limit: int) -> DataFrame:
    """Rows with the score or more, all of them; if there are none the best ``limit``; without a threshold the best ``limit``."""
    ordered = rows.orderBy(F.desc("score"), "chunk_id")
    if threshold is None:
        return ordered.limit(limit)
    above = rows.agg(F.coalesce(F.max("score") >= threshold, F.lit(False)).alias("some"))
    # The rows are a bounded set of candidates, so one window ranks them.
    place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("place", place).crossJoin(F.broadcast(above)).where((F.col("some") & (F.col("score") >= threshold)) | (~F.col("some") & (F.col("place") <= max(1, limit)))).drop("place", "some")


def papers_of(rows: DataFrame, chunks_per_paper: int) -> DataFrame:
    """One row per article: its best chunk with the paper's score, number of chunks, sources and first chunks."""
    w = Window.partitionBy("article_id").orderBy(F.desc("score"), "chunk_id")
    ranked = rows.withColumn("place", F.row_number().over(w))
    groups = ranked.groupBy("article_id").agg(
        F.max("score").alias("top"),
        F.avg(F.when(F.col("place") <= 2, F.col("score"))).alias("mean"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("paper_sources"),
        F.count("*").alias("paper_chunks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= chunks_per_paper, F.struct("place", "chunk_id", "score")))), lambda x: x["chunk_id"]).alias("highlights"),
    )
    best = ranked.where("place = 1").drop("place", "score")
    score = F.round(F.col("top") + 0.2 * F.col("mean") + 0.06 * F.size("paper_sources"), 6)
    return best.join(groups, "article_id").withColumn("score", score).drop("top", "mean")


def within(rows: DataFrame, seconds: float) -> DataFrame | None:
    """``rows`` written within so many seconds, or none. Other errors are raised.

    The work has a thread and a job tag of its own, so the caller's job group, tags and other properties stay as they are.
    What takes longer is left behind: its jobs are cancelled by their tag if no part of the plan runs in Python. Python
    workers are shared, and a cancelled task can leave one that the next query fails on; such a plan ends by itself, unread.
    """
    context, tag, box = rows.sparkSession.sparkContext, f"within-{uuid.uuid4().hex}", {}

    def work() -> None:
        context.addJobTag(tag)
        try:
            box["rows"] = stage(rows, "within")
        except Exception as error:
            box["error"] = error

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        if not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().optimizedPlan().toString()):
            context.cancelJobsWithTag(tag)
        return None
    if "error" in box:
        raise box["error"]
    return box["rows"]


def contextual_retrieve(corpus: Corpus, question: str, query_vector: list[float] | None = None, limit: int = 8, scope: str = "chunks", chunks_per_paper: int = 1, threshold: float | None = None, vocabulary: Vocabulary = Vocabulary(), vector_seconds: float | None = None) -> DataFrame:
    """The flagship: candidates of four channels, fused, filtered, re-ranked. Columns include chunk_id, article_id, score.

    Where no title or author meets the question, candidates of the author channel come back without the strict filter.
    With ``vector_seconds`` a vector channel that takes longer is left out, and the lexical ones answer alone.
    """
    papers = scope == "papers"
    k = max(limit * (8 if papers else 5), 80 if papers else 25)
    pool = max(limit * 8, 80) if papers else limit
    plan = plan_query(question, vocabulary)

    def near() -> DataFrame:
        if vector_seconds is None or query_vector is None:
            return vector_query(corpus, query_vector, k)
        in_time = within(vector_query(corpus, query_vector, k), vector_seconds)
        return vector_query(corpus, None, k) if in_time is None else in_time

    found = _together(corpus, {
        "vector": near,
        "token": lambda: token_query(corpus, plan.tokens, k),
        "author": lambda: author_query(corpus, plan.author_terms, k),
        "title": lambda: title_query(corpus, plan.tokens, k),
    }, k)
    fused = fuse(found).withColumnsRenamed({"author": "author_score", "title": "title_score"})
    # Four times k rows at most, read by each branch below: made once, so that no branch scans the corpus again.
    rows = held(enrich(corpus, fused, 4 * k), 4 * k, "candidates")
    best = lambda frame: rerank(frame, plan).orderBy(F.desc("score"), "chunk_id").limit(pool)
    primary = best(strict_filter(rows, plan, vocabulary))
    if plan.strict:
        # All candidates again if the question's words are in no title or author; one row decides, inside the plan.
        signal = primary.agg(F.coalesce(F.max(F.col("author_overlap") + F.col("title_overlap")), F.lit(0.0)).alias("signal"))
        found = rows.agg(F.coalesce(F.max("author_score"), F.lit(0.0)).alias("named"))
        weak = signal.crossJoin(found).select(((F.col("signal") < 0.15) & (F.col("named") > 0)).alias("weak"))
        both = primary.withColumn("second", F.lit(False)).unionByName(best(rows).withColumn("second", F.lit(True)))
        primary = both.crossJoin(F.broadcast(weak)).where("second = weak").drop("second", "weak")
    return keep_above(papers_of(primary, chunks_per_paper) if papers else primary, threshold, limit)


def graphrag_retrieve(corpus: Corpus, question: str, query_vector: list[float] | None = None, limit: int = 20, scope: str = "papers", chunks_per_paper: int = 8, threshold: float | None = None) -> DataFrame:
    """Three channels, each its top ``limit``; the greatest of the raw scores counts. A threshold may leave no row."""
    terms = question.split()
    parts = _together(corpus, {"vector": lambda: vector_query(corpus, query_vector, limit), "fulltext": lambda: title_query(corpus, terms, limit), "hybrid": lambda: token_query(corpus, terms, limit)}, limit)
    every = None
    for i, (name, part) in enumerate(parts.items()):
        part = part.select("chunk_id", "score", F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("source"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("chunk_id").agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_set("source")), lambda x: x["name"]).alias("sources"))
    if threshold is not None:
        fused = fused.where(F.col("score") >= threshold)
    rows = enrich(corpus, fused, 3 * limit)
    if scope == "papers":
        w = Window.partitionBy("article_id").orderBy(F.desc("score"), "chunk_id")
        ranked = rows.withColumn("place", F.row_number().over(w))
        first = ranked.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= max(1, chunks_per_paper), F.struct("place", "chunk_id")))), lambda x: x["chunk_id"]).alias("highlights"))
        rows = ranked.where("place = 1").drop("place").join(first, "article_id")
    return rows.orderBy(F.desc("score"), "chunk_id").limit(limit)
