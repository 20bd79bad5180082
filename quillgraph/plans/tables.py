"""The driver's tables in the roles of a literature graph, as frames and as SQL for the independent check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.functions.vocabulary import STOPWORDS
from quillgraph.operators.index import word_windows
from quillgraph.operators.retrieval import Corpus
from quillgraph.operators.store import Store, build_index
from quillgraph.session import fresh_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: the title is the first eight words of the first line, the author its source."""
    d = table(spark, sf, "documents")
    line = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("article_id"), F.array_join(F.slice(F.split(line, " "), 1, 8), " ").alias("title"), F.col("source").alias("author"),
        (F.lit(1990) + F.col("doc_id") % 35).cast("int").alias("year"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("citekey"), "text",
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    cut = word_windows(articles(spark, sf), "article_id")
    return cut.withColumn("chunk_id", F.concat(F.col("article_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string")))


def cites(spark: SparkSession, sf: str) -> DataFrame:
    """Article n cites 3n + 1, 5n + 2 and 7n + 3, as far as they exist."""
    d = table(spark, sf, "documents").select("doc_id")
    edges = d.select(F.col("doc_id").alias("src"), F.explode(F.array(F.col("doc_id") * 3 + 1, F.col("doc_id") * 5 + 2, F.col("doc_id") * 7 + 3)).alias("dst"))
    return edges.join(d.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


_STORES: dict[tuple[str, str], Store] = {}


#: Fields that a substring search of the catalogue looks into.
SEARCHED = ("title", "doi", "journal", "publisher", "persistent_id", "item_key", "attachment_key", "author")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The articles with the fields of a catalogue, without their text."""
    k = F.col("article_id").cast("string")
    return articles(spark, sf).drop("text").withColumns({
        "doi": F.concat(F.lit("10.1000/"), F.lower("citekey")), "journal": F.concat(F.lit("Journal of "), "author"), "publisher": F.concat(F.lit("Press "), (F.col("article_id") % 17).cast("string")),
        "persistent_id": F.concat(F.lit("1:K"), k), "item_key": F.concat(F.lit("K"), k), "attachment_key": F.concat(F.lit("A"), k),
    })


def build_store(spark: SparkSession, sf: str) -> Store:
    """The index over one set of tables, written to the shared folder."""
    vectors = table(spark, sf, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), "embedding")
    return build_index(catalogue(spark, sf), chunks(spark, sf), fresh_path(spark, "index"), vectors, cites(spark, sf), search=SEARCHED)


def corpus(spark: SparkSession, sf: str) -> Corpus:
    """The stored index of these tables; a session's first question builds it, later ones find it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        _STORES[key] = build_store(spark, sf)
    return Corpus.stored(_STORES[key])


def query_vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^ \t\n\r\f\x0b]+')"


def sql_tokens(text: str, extra: str = "") -> str:
    """List of body tokens of an SQL text."""
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z][a-z0-9''-]*'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}){extra})"


ARTICLES = """articles AS (
  SELECT doc_id AS article_id, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:8], ' ') AS title, source AS author,
    CAST(1990 + doc_id % 35 AS INTEGER) AS year, source || '-' || CAST(doc_id AS VARCHAR) AS citekey, text FROM documents)"""
CHUNKS = f"""split AS (SELECT article_id, {WORDS.format("text")} AS ws FROM articles),
chunks AS (
  SELECT article_id, i AS chunk_index, article_id || ':' || i AS chunk_id, i * 175 AS word_start, least(len(ws), i * 175 + 220) AS word_end,
    array_to_string(ws[i * 175 + 1 : i * 175 + 220], ' ') AS chunk_text
  FROM (SELECT article_id, ws, unnest(range(0, CASE WHEN len(ws) <= 220 THEN 1 ELSE CAST(ceil((len(ws) - 220) / 175.0) AS BIGINT) + 1 END)) AS i FROM split WHERE len(ws) > 0))"""
TOKENS = f"""tokens AS (
  SELECT chunk_id, token, count(*) AS n FROM (SELECT chunk_id, unnest({sql_tokens("chunk_text")}) AS token FROM chunks) GROUP BY ALL)"""
CITES = """cites AS (
  SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, unnest([doc_id * 3 + 1, doc_id * 5 + 2, doc_id * 7 + 3]) AS dst FROM documents)
  WHERE src <> dst AND dst IN (SELECT doc_id FROM documents))"""
MICRO = "CAST(floor(({0}) * 1e6 + 0.5) AS BIGINT)"
