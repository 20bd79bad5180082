"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.text import micro
from quillgraph.functions.vocabulary import Vocabulary
from quillgraph.operators import index, retrieval as r
from quillgraph.plans import tables as t

QUESTION = 'Explain thing "of the" ention src7 thand 2003'
WORDS = ("thing", "ention", "src7", "thand")
DOMAIN = Vocabulary(domain=("thing", "ention", "thand"), anchors=("ention",), generic=("thing",))
_IN = ", ".join(f"'{w}'" for w in WORDS)


def _bm25_sql(name: str, field: str, terms) -> str:
    """CTEs that leave ``name(article_id, score)``."""
    n = [f"len(list_filter(ts, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(terms)]
    d = [f"count(*) FILTER (n{i} > 0) AS d{i}" for i in range(len(terms))]
    s = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    return f"""{name}_r AS (SELECT article_id, len(ts) AS len, {", ".join(n)} FROM (SELECT article_id, regexp_extract_all(lower({field}), '[a-z0-9]+') AS ts FROM articles)),
{name}_t AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(len) AS mean, {", ".join(d)} FROM {name}_r),
{name} AS (SELECT article_id, CAST({s} AS DOUBLE) AS score FROM {name}_r, {name}_t WHERE {" OR ".join(f"n{i} > 0" for i in range(len(terms)))})"""


def _channels_sql(k: int) -> str:
    return f"""WITH {t.ARTICLES}, {t.CHUNKS}, {t.TOKENS}, {t.CITES},
qv AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 7),
vec AS (SELECT vec_id || ':0' AS chunk_id, list_dot_product(e, q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(e, e)) AS score
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), qv ORDER BY score DESC, chunk_id LIMIT {k}),
tok AS (SELECT chunk_id, CAST(sum(n) AS DOUBLE) AS score FROM tokens WHERE token IN ({_IN}) GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT {k}),
{_bm25_sql("ab", "author", WORDS)},
{_bm25_sql("tb", "title || ' ' || citekey", WORDS)},
aut AS (SELECT chunk_id, score FROM ab JOIN articles USING (article_id) JOIN chunks USING (article_id) ORDER BY score DESC, year DESC, chunk_id LIMIT {k}),
tit AS (SELECT chunk_id, score FROM tb JOIN articles USING (article_id) JOIN chunks USING (article_id) ORDER BY score DESC, year DESC, chunk_id LIMIT {k})"""


def _fused_sql(k: int) -> str:
    return f"""{_channels_sql(k)},
fused AS (SELECT chunk_id, coalesce(max(v), 0) AS v, coalesce(max(k), 0) AS k, coalesce(max(a), 0) AS a, coalesce(max(t), 0) AS t,
    list_filter([CASE WHEN max(v) IS NOT NULL THEN 'vector' END, CASE WHEN max(k) IS NOT NULL THEN 'token' END, CASE WHEN max(a) IS NOT NULL THEN 'author' END, CASE WHEN max(t) IS NOT NULL THEN 'title' END], lambda x: x IS NOT NULL) AS sources
  FROM (SELECT chunk_id, score AS v, NULL AS k, NULL AS a, NULL AS t FROM vec UNION ALL SELECT chunk_id, NULL, score, NULL, NULL FROM tok
    UNION ALL SELECT chunk_id, NULL, NULL, score, NULL FROM aut UNION ALL SELECT chunk_id, NULL, NULL, NULL, score FROM tit) GROUP BY 1),
scored AS (SELECT *, v + k / 10 + least(1.5, 0.3 * a) + least(2.0, 0.35 * t) AS combined FROM fused)"""


def _ranked_sql(k: int) -> str:
    toks = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z][a-z0-9''-]*'))"
    share = lambda c: f"len(list_intersect([{_IN}], {toks(c)})) / {float(len(WORDS))}"
    return f"""{_fused_sql(k)},
outs AS (SELECT src AS article_id, least(5, count(DISTINCT title)) AS n FROM cites JOIN articles ON dst = article_id GROUP BY 1),
ins AS (SELECT dst AS article_id, least(5, count(DISTINCT title)) AS n FROM cites JOIN articles ON src = article_id GROUP BY 1),
rows_ AS (SELECT s.*, c.article_id, c.chunk_text, x.title, x.author, x.year, x.citekey, coalesce(o.n, 0) + coalesce(i.n, 0) AS links,
    lower(x.title || ' ' || c.chunk_text) AS hay, lower(x.title || ' ' || c.chunk_text || ' ' || x.author || ' ' || x.citekey) AS wide
  FROM scored s JOIN chunks c USING (chunk_id) JOIN articles x ON x.article_id = c.article_id LEFT JOIN outs o ON o.article_id = c.article_id LEFT JOIN ins i ON i.article_id = c.article_id),
marked AS (SELECT *, {share("chunk_text")} AS co, {share("title")} AS tio, {share("author")} AS ao,
    CAST(contains(hay, 'thing') AS INTEGER) + CAST(contains(hay, 'ention') AS INTEGER) + CAST(contains(hay, 'thand') AS INTEGER) AS dh, CAST(contains(hay, 'ention') AS INTEGER) AS ah,
    (contains(wide, 'ention') OR contains(wide, 'thand')) AND CAST(contains(wide, 'thing') AS INTEGER) + CAST(contains(wide, 'ention') AS INTEGER) + CAST(contains(wide, 'thand') AS INTEGER) >= 2 AS keep
  FROM rows_),
ranked AS (SELECT *, greatest(combined, v + k / 12 + 0.2 * a) + 0.45 * co + 0.40 * tio + 0.70 * ao + CASE WHEN year = 2003 THEN 0.3 ELSE 0 END
    + CASE WHEN contains(lower(chunk_text), 'of the') OR contains(lower(title), 'of the') THEN 0.3 ELSE 0 END + least(0.2, 0.03 * links)
    + least(0.75, 0.18 * dh) - CASE WHEN dh = 0 THEN 0.45 ELSE 0 END + least(0.9, 0.28 * ah) - CASE WHEN ah = 0 THEN 1.1 ELSE 0 END AS score FROM marked)"""


def _primary_sql(k: int, pool: int) -> str:
    return f"""{_ranked_sql(k)},
strict AS (SELECT * FROM ranked WHERE keep OR NOT (SELECT bool_or(keep) FROM ranked) ORDER BY score DESC, chunk_id LIMIT {pool}),
loose AS (SELECT * FROM ranked ORDER BY score DESC, chunk_id LIMIT {pool}),
weak AS (SELECT coalesce((SELECT max(ao + tio) FROM strict), 0) < 0.15 AND (SELECT max(a) FROM fused) > 0 AS w),
best AS (SELECT * FROM strict WHERE NOT (SELECT w FROM weak) UNION ALL SELECT * FROM loose WHERE (SELECT w FROM weak))"""


def token_postings(spark, sf):
    return index.postings(t.articles(spark, sf).select("article_id", F.col("text").alias("chunk_text")), "article_id")


def token_stats(spark, sf):
    return token_postings(spark, sf).groupBy("token").agg(F.count("*").alias("articles"), F.sum("count").alias("total")).orderBy(F.desc("total"), "token").limit(50)


def token_query(spark, sf):
    """The token channel with its neighbours: authors and titles come after the limit."""
    c = t.corpus(spark, sf)
    return r.enrich(c, r.token_query(c, WORDS, 25)).select("chunk_id", "article_id", "author", F.col("score").cast("long").alias("token_score"), F.array_join("cites_out", "|").alias("cites_out"), F.array_join("cited_by", "|").alias("cited_by"))


def title_query(spark, sf):
    return r.title_query(t.corpus(spark, sf), WORDS, 25).select("chunk_id", micro(F.col("score")).alias("score"))


def author_query(spark, sf):
    return r.author_query(t.corpus(spark, sf), WORDS, 25).select("chunk_id", micro(F.col("score")).alias("score"))


def vector_query(spark, sf):
    c = t.corpus(spark, sf)
    return r.vector_query(c, t.query_vector(spark, sf), 25).select("chunk_id", micro(F.col("score")).alias("score"))


def hybrid_fusion(spark, sf):
    c, k = t.corpus(spark, sf), 40
    fused = r.fuse({"vector": r.vector_query(c, t.query_vector(spark, sf), k), "token": r.token_query(c, WORDS, k), "author": r.author_query(c, WORDS, k), "title": r.title_query(c, WORDS, k)})
    return fused.select("chunk_id", micro(F.col("combined")).alias("combined"), F.array_join("sources", ",").alias("sources"))


def contextual_retrieve(spark, sf):
    found = r.contextual_retrieve(t.corpus(spark, sf), QUESTION, t.query_vector(spark, sf), 8, vocabulary=DOMAIN)
    return found.select("chunk_id", "article_id", micro(F.col("score")).alias("score"), F.array_join("sources", ",").alias("sources"))


def contextual_papers(spark, sf):
    found = r.contextual_retrieve(t.corpus(spark, sf), QUESTION, t.query_vector(spark, sf), 6, "papers", 3, vocabulary=DOMAIN)
    return found.select("article_id", micro(F.col("score")).alias("score"), F.col("paper_chunks").cast("long").alias("paper_chunks"), F.array_join("paper_sources", ",").alias("sources"), F.array_join("highlights", ",").alias("highlights"))


def score_threshold(spark, sf):
    """All rows at a threshold or more, whatever the limit; below it, the best few."""
    rows = r.contextual_retrieve(t.corpus(spark, sf), QUESTION, t.query_vector(spark, sf), 20, vocabulary=DOMAIN)
    high = r.keep_above(rows, 99.0, 3).withColumn("cut", F.lit("fallback"))
    some = r.keep_above(rows, 1.5, 3).withColumn("cut", F.lit("above"))
    return high.unionByName(some).select("cut", "chunk_id", micro(F.col("score")).alias("score"))


def graphrag_retrieve(spark, sf):
    found = r.graphrag_retrieve(t.corpus(spark, sf), " ".join(WORDS), t.query_vector(spark, sf), 20, "chunks", threshold=0.3)
    return found.select("chunk_id", micro(F.col("score")).alias("score"), F.array_join("sources", ",").alias("sources"))


def graphrag_papers(spark, sf):
    found = r.graphrag_retrieve(t.corpus(spark, sf), " ".join(WORDS), t.query_vector(spark, sf), 20, "papers", 2)
    return found.select("article_id", micro(F.col("score")).alias("score"), F.array_join("highlights", ",").alias("highlights"))


def vector_topk_per_label(spark, sf):
    """The three vectors of each label that are nearest to one vector."""
    from pyspark.sql import Window

    q = t.query_vector(spark, sf)
    dot = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return t.table(spark, sf, "embeddings").select("vec_id", "label", dot.alias("score")).withColumn("place", place).where("place <= 3").select("label", "place", "vec_id")


def word_windows(spark, sf):
    return t.chunks(spark, sf).select("article_id", "chunk_index", "word_start", "word_end", F.md5("chunk_text").alias("text_md5"))


_NAMES = "sources"
QUERIES = {
    "token_postings": token_postings, "token_stats": token_stats, "token_query_topk": token_query, "title_bm25": title_query, "author_channel": author_query,
    "vector_topk": vector_query, "vector_topk_per_label": vector_topk_per_label, "hybrid_fusion": hybrid_fusion, "contextual_retrieve": contextual_retrieve,
    "contextual_papers": contextual_papers, "score_threshold_fallback": score_threshold, "graphrag_retrieve": graphrag_retrieve, "graphrag_papers": graphrag_papers,
    "word_windows": word_windows,
}
_M = t.MICRO.format
_WHOLE = f"SELECT article_id, token, count(*) AS \"count\" FROM (SELECT article_id, unnest({t.sql_tokens('text')}) AS token FROM articles) GROUP BY ALL"
_GRAG = f"""{_channels_sql(20)},
every AS (SELECT chunk_id, score, 1 AS i, 'vector' AS s FROM vec UNION ALL SELECT chunk_id, score, 2, 'fulltext' FROM tit UNION ALL SELECT chunk_id, score, 3, 'hybrid' FROM tok),
g AS (SELECT chunk_id, max(score) AS score, string_agg(s, ',' ORDER BY i) AS sources FROM every GROUP BY 1)"""
SQL = {
    "token_postings": f"WITH {t.ARTICLES} {_WHOLE}",
    "token_stats": f"WITH {t.ARTICLES} SELECT token, count(*) AS articles, CAST(sum(\"count\") AS BIGINT) AS total FROM ({_WHOLE}) GROUP BY 1 ORDER BY total DESC, token LIMIT 50",
    "token_query_topk": f"""{_channels_sql(25)},
o AS (SELECT src AS article_id, array_to_string(list_sort(list(DISTINCT title))[1:5], '|') AS ts FROM cites JOIN articles ON dst = article_id GROUP BY 1),
i AS (SELECT dst AS article_id, array_to_string(list_sort(list(DISTINCT title))[1:5], '|') AS ts FROM cites JOIN articles ON src = article_id GROUP BY 1)
SELECT chunk_id, c.article_id, author, CAST(score AS BIGINT) AS token_score, coalesce(o.ts, '') AS cites_out, coalesce(i.ts, '') AS cited_by
FROM tok JOIN chunks c USING (chunk_id) JOIN articles a ON a.article_id = c.article_id LEFT JOIN o ON o.article_id = c.article_id LEFT JOIN i ON i.article_id = c.article_id""",
    "title_bm25": f"{_channels_sql(25)} SELECT chunk_id, {_M('score')} AS score FROM tit",
    "author_channel": f"{_channels_sql(25)} SELECT chunk_id, {_M('score')} AS score FROM aut",
    "vector_topk": f"{_channels_sql(25)} SELECT chunk_id, {_M('score')} AS score FROM vec",
    "vector_topk_per_label": """
WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 7),
s AS (SELECT vec_id, label, list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q) AS score FROM embeddings, q)
SELECT label, CAST(place AS INTEGER) AS place, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 3""",
    "hybrid_fusion": f"{_fused_sql(40)} SELECT chunk_id, {_M('combined')} AS combined, array_to_string(sources, ',') AS sources FROM scored",
    "contextual_retrieve": f"{_primary_sql(40, 8)} SELECT chunk_id, article_id, {_M('score')} AS score, array_to_string(sources, ',') AS sources FROM best",
    "contextual_papers": f"""{_primary_sql(80, 80)},
p AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS place FROM best),
u AS (SELECT article_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, count(DISTINCT s) AS n FROM (SELECT article_id, unnest(sources) AS s FROM p) GROUP BY 1),
g AS (SELECT article_id, max(score) + 0.2 * avg(score) FILTER (place <= 2) AS x, count(*) AS paper_chunks, string_agg(chunk_id, ',' ORDER BY place) FILTER (place <= 3) AS highlights, min(chunk_id) FILTER (place = 1) AS first FROM p GROUP BY 1)
SELECT article_id, {_M('round(x + 0.06 * n, 6)')} AS score, paper_chunks, sources, highlights FROM g JOIN u USING (article_id) ORDER BY round(x + 0.06 * n, 6) DESC, first LIMIT 6""",
    "score_threshold_fallback": f"""{_primary_sql(100, 20)}
SELECT 'fallback' AS cut, chunk_id, {_M('score')} AS score FROM (SELECT * FROM best ORDER BY score DESC, chunk_id LIMIT 3)
UNION ALL SELECT 'above', chunk_id, {_M('score')} FROM best WHERE score >= 1.5""",
    "graphrag_retrieve": f"{_GRAG} SELECT chunk_id, {_M('score')} AS score, sources FROM g WHERE score >= 0.3 ORDER BY g.score DESC, chunk_id LIMIT 20",
    "graphrag_papers": f"""{_GRAG},
p AS (SELECT g.*, article_id, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS place FROM g JOIN chunks USING (chunk_id)),
h AS (SELECT article_id, max(score) AS s, string_agg(chunk_id, ',' ORDER BY place) FILTER (place <= 2) AS highlights, min(chunk_id) FILTER (place = 1) AS first FROM p GROUP BY 1)
SELECT article_id, {_M('s')} AS score, highlights FROM h ORDER BY s DESC, first LIMIT 20""",
    "word_windows": f"WITH {t.ARTICLES}, {t.CHUNKS} SELECT article_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(word_start AS INTEGER) AS word_start, CAST(word_end AS INTEGER) AS word_end, md5(chunk_text) AS text_md5 FROM chunks",
}
