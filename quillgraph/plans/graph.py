"""Graph, resolution and dataset queries; the star schema stands for the property graph at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import catalogue as cat, datasets as d, graph as g, resolution as r
from quillgraph.plans import tables as t
from quillgraph.plans.tables import table

_M = t.MICRO.format


def graph_stats(spark, sf):
    names = ("orders", "part", "lineitem", "customer")
    return g.graph_stats({n: table(spark, sf, n) for n in names})


def graph_stats_strict(spark, sf):
    full = {n: table(spark, sf, n) for n in ("orders", "part")}
    return g.graph_stats(full | {"empty": full["part"].where("p_size < 0")}, strict=True)


def degree_counts(spark, sf):
    """Orders and nations of each customer, zero where there are none."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return g.degree_counts(table(spark, sf, "customer").select("c_custkey"), "c_custkey", orders=(o, "o_custkey"), lines=(li, "o_custkey"))


def ordered_collect_top5(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    return g.ordered_names(li, "l_orderkey", "l_linenumber", "part", 5).select("l_orderkey", F.concat_ws(",", "names").alias("names"))


def neighbour_titles(spark, sf):
    c, a = t.cites(spark, sf), t.articles(spark, sf).select("article_id", "title")
    out = g.first_distinct(c.join(a, F.col("dst") == F.col("article_id")).select(F.col("src").alias("id"), "title"), "id", "title", 5).withColumnRenamed("names", "ts")
    return a.select(F.col("article_id").alias("id")).join(out, "id", "left").select("id", F.concat_ws("|", F.coalesce("ts", F.array().cast("array<string>"))).alias("titles"))


def article_lookup(spark, sf, key: str = "SRC3-63"):
    """An article by citekey, whatever its case, with counts and neighbours."""
    a = t.articles(spark, sf).where(F.lower("citekey") == key.lower()).limit(1)
    c = t.chunks(spark, sf).join(a.select("article_id"), "article_id")
    texts = c.groupBy("article_id").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("chunk_text", 1, 1200).alias("x")))).alias("first"))
    e = t.cites(spark, sf)
    outs = e.join(a, F.col("src") == F.col("article_id"), "left_semi").agg(F.count("*").alias("cites_out"))
    ins = e.join(a, F.col("dst") == F.col("article_id"), "left_semi").agg(F.count("*").alias("cited_by"))
    return a.join(texts, "article_id").crossJoin(outs).crossJoin(ins).select("article_id", "title", "year", "chunks", F.md5(F.col("first")[0]["x"]).alias("first_md5"), "cites_out", "cited_by")


def article_chunks(spark, sf):
    c = t.chunks(spark, sf).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("cs"))
    return c.select("article_id", F.concat_ws(",", F.transform("cs", lambda x: x["chunk_id"])).alias("chunk_ids"))


def articles_by_keys(spark, sf):
    """Requested keys in order, each once, found or missing."""
    asked = spark.range(0, 400).select(F.col("id").alias("place"), F.when(F.col("id") % 3 == 0, F.upper(F.concat(F.lit("src"), F.col("id") % 20, F.lit("-"), F.col("id")))).otherwise(F.concat(F.lit("SRC"), F.col("id") % 7, F.lit("-"), F.col("id") % 100)).alias("key"))
    asked = asked.groupBy(F.lower("key").alias("key")).agg(F.min("place").alias("place"))
    have = t.articles(spark, sf).select(F.lower("citekey").alias("key"), "article_id")
    return asked.join(have, "key", "left").select("key", "place", F.coalesce("article_id", F.lit(-1)).alias("article_id"), F.when(F.col("article_id").isNull(), "missing").otherwise("found").alias("state"))


def identity_exists(spark, sf):
    """Customers known by name or by (blank for some) segment and balance."""
    c = table(spark, sf, "customer").select("c_custkey", tx.identity(F.col("c_name")).alias("name_key"), F.nullif(F.round(F.col("c_acctbal")).cast("long"), F.lit(0).cast("long")).alias("balance_key"))
    stored = c.where("c_custkey % 4 = 0").select(F.col("name_key"), (F.col("balance_key") + 1).alias("balance_key"))
    return r.exists_by(c, stored, ["name_key", "balance_key"]).select("c_custkey", "known")


def sync_antijoin(spark, sf):
    """Catalogue rows, one per id, whose id the store doesn't hold."""
    c = table(spark, sf, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(":1")).alias("pid"), "o_orderkey")
    first = c.groupBy("pid").agg(F.min("o_orderkey").alias("first_order"))
    stored = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit(":1")).alias("pid"))
    return first.join(stored, "pid", "left_anti")


def _reconciled(spark, sf):
    a = t.articles(spark, sf).select("article_id", F.col("citekey").alias("item_key"), tx.normalize_title(F.col("title")).alias("title_key"))
    stored = a.where("article_id % 2 = 0")
    incoming = a.select("article_id", F.when(F.col("article_id") % 3 == 0, F.col("item_key")).alias("item_key"), "title_key")
    stored = stored.withColumnRenamed("article_id", "stored_id")
    return r.reconcile(incoming, stored, ["item_key", "title_key"], "stored_id"), stored


def reconcile(spark, sf):
    """Rows matched by name, then by title, where a shared title is ambiguous."""
    return _reconciled(spark, sf)[0].select("article_id", F.coalesce("matched_id", F.lit(-1)).alias("matched_id"), "matched_by")


def reconcile_residual(spark, sf):
    """What stays without an id, and why."""
    return r.residual(*_reconciled(spark, sf), ["item_key", "title_key"], "stored_id").select("article_id", "reason", "holders")


def metadata_cascade(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("path"), F.lower("p_brand").alias("base"), "p_type")
    by_path = p.where("p_partkey % 5 = 0").groupBy("path").agg(F.min("p_type").alias("meta"))
    by_base = p.where("p_partkey % 7 = 0").groupBy("base").agg(F.min("p_type").alias("meta"))
    return r.cascade_lookup(p.select("p_partkey", "path", "base"), [("path", by_path), ("base", by_base)], "meta").select("p_partkey", "meta")


def reference_diff(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha1("text").alias("fingerprint"), "doc_id")
    return d.difference(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 4 <> 0"), "fingerprint")


def duplicate_components(spark, sf):
    """Documents linked by equal texts or equal titles and years."""
    a = t.articles(spark, sf)
    rows = a.select("article_id", F.md5("text").alias("k1"), tx.title_year_key(F.col("title"), F.col("year")).alias("k2"))
    return r.duplicate_groups(rows, "article_id", ["k1", "k2"])


def canonical_pick(spark, sf):
    """Of each duplicate class the article with the longest text, then the later year, then the least id."""
    groups = duplicate_components(spark, sf).join(t.articles(spark, sf), "article_id")
    best = g.canonical_pick(groups, "group", F.desc(F.length("text")), F.desc("year"), F.asc("article_id"))
    return best.select("group", "article_id")


def author_duplicate_candidates(spark, sf):
    """Short forms of part names, which stand for authors."""
    full = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("works"))
    names = full.unionByName(full.select(F.element_at(F.split("name", " "), -1).alias("name"), F.lit(0).alias("works"))).groupBy("name").agg(F.max("works").alias("works"))
    return r.author_candidates(names).select("source", "target", F.col("score").cast("double").alias("score"), "reason")


def prior_work_links(spark, sf):
    return r.prior_work_links(t.articles(spark, sf), t.cites(spark, sf))


def in_text_links(spark, sf):
    """Texts that hold an author, of one or two words, and a number that stands for a year anywhere in them."""
    first = F.lower(F.when(F.col("article_id") % 2 == 0, F.regexp_extract("title", "[A-Za-z]+", 0)).otherwise(F.regexp_extract("title", "[A-Za-z]+ [A-Za-z]+", 0)))
    targets = t.articles(spark, sf).select("article_id", first.alias("author"), (100 + F.col("article_id") % 900).cast("int").alias("year"))
    return r.in_text_links(t.chunks(spark, sf), targets, t.cites(spark, sf))


def stale_edge_cleanup(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 100).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "reference_title_match").otherwise("in_text_author_year").alias("method"))
    supports = o.where("dst % 3 = 0")
    return g.stale_edges(o.distinct(), supports)


def orphan_cleanup(spark, sf):
    """Customers without an urgent order."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return g.orphans(table(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey")


def author_merge(spark, sf):
    """Suppliers re-pointed to the supplier with the same last digit; one row per pair, with the least line number."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    mapping = table(spark, sf, "supplier").where("s_suppkey > 10").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") % 10 + 1).alias("new"))
    return g.merge_nodes(li, "l_suppkey", "l_partkey", mapping, "l_linenumber")


def article_merge(spark, sf):
    """Even documents take over what the odd ones after them have and they lack."""
    a = t.articles(spark, sf).select("article_id", F.when(F.col("article_id") % 6 != 0, F.col("author")).alias("author"), F.when(F.col("article_id") % 4 != 0, F.col("citekey")).otherwise("").alias("citekey"))
    mapping = a.where("article_id % 2 = 1").select(F.col("article_id").alias("old"), (F.col("article_id") - 1).alias("new"))
    return g.merge_records(a, "article_id", mapping)


def upsert_last(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("method"))
    return g.upsert_last(links, ["src", "dst"], "ordinal").select("src", "dst", "method")


def replace_upsert(spark, sf):
    old = table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("article_id"), F.col("o_orderkey").alias("ref"))
    new = table(spark, sf, "orders").where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("article_id"), (-F.col("o_orderkey")).alias("ref"))
    return g.replace_articles(old, new)


def eav_pivot(spark, sf):
    """Fields of long rows as columns."""
    long = table(spark, sf, "events").select("user_id", "event_type", "value")
    kinds = ("click", "view", "purchase")
    return long.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds], F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("click_value"))


def catalog_search(spark, sf):
    """Substring search over joined fields, sorted by title and id, second page; with the total and a presence flag."""
    a = t.articles(spark, sf)
    return cat.search_page(a, "ti", ("title", "author", "citekey", "year"), "title", "article_id", 1, 20, a.where("article_id % 2 = 0"))


def dedupe_priority(spark, sf):
    """One document per text: labelled ones first, then the earlier."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.dedupe_by_priority(docs.withColumn("h", F.md5("text")), "h", F.desc(F.coalesce("quality", F.lit(-1))), F.asc("doc_id")).select("h", "doc_id")


def train_eval_split(spark, sf):
    return d.split_by_hash(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2)


def weighted_replication(spark, sf):
    return d.replicate(table(spark, sf, "labels"), F.col("quality") * 2 + F.col("toxic")).select("doc_id", "copy")


def split_metrics(spark, sf):
    """Words of a document's first line against those of its first twelve words."""
    a = t.articles(spark, sf)
    gold = F.slice(tx.words(F.col("text")), 1, 12)
    rows = d.prf(a.withColumns({"gold": gold, "guess": tx.words(F.col("title"))}), "gold", "guess")
    return rows.select("article_id", *[tx.micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def section_metrics(spark, sf):
    rows = d.error_metrics(table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_quantity") % 7 + 1).cast("int").alias("guess")), "l_linenumber", "guess")
    return rows.select("n", *[tx.micro(F.col(c)).alias(c) for c in ("mae", "rmse", "exact")])


def batch_numbers(spark, sf):
    return d.batches(table(spark, sf, "documents").select("doc_id", "source"), 12, "source", F.asc("doc_id")).select("doc_id", "batch")


def probability_histogram(spark, sf):
    """Rows by twentieth of the discount's span."""
    return table(spark, sf, "lineitem").select(F.width_bucket(F.col("l_discount"), F.lit(0.0), F.lit(0.101), F.lit(20)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def method_counts(spark, sf):
    return reconcile(spark, sf).groupBy("matched_by").agg(F.count("*").alias("n"))


def coverage_summary(spark, sf):
    """Documents with and without a label, by source."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("has").alias("labelled"), F.count_if(F.col("has").isNull()).alias("missing"), tx.micro(F.count("has") / F.count("*")).alias("share"))


def citation_resolution(spark, sf):
    """The title of each article as a reference of the article after it; similarity by difflib."""
    a = t.articles(spark, sf)
    norm = tx.normalize_title(F.col("title"))
    targets = a.select(F.col("article_id").alias("target_id"), norm.alias("target_title"), F.col("year").alias("target_year"), F.when(F.col("article_id") % 9 == 0, F.col("citekey")).alias("target_doi"), F.array("author").alias("target_authors"))
    refs = a.select(F.concat(F.col("article_id"), F.lit("::ref::0")).alias("reference_id"), (F.col("article_id") + 1).alias("article_id"), norm.alias("title_norm"), (F.col("year") + F.col("article_id") % 2).alias("year"), F.when(F.col("article_id") % 9 == 0, F.col("citekey")).alias("doi"), F.array("author").alias("author_tokens"))
    return r.resolve_citations(refs, targets)


QUERIES = {f.__name__: f for f in (graph_stats, graph_stats_strict, degree_counts, ordered_collect_top5, neighbour_titles, article_lookup, article_chunks, articles_by_keys, identity_exists, sync_antijoin, reconcile, reconcile_residual, metadata_cascade, reference_diff, duplicate_components, canonical_pick, author_duplicate_candidates, prior_work_links, in_text_links, stale_edge_cleanup, orphan_cleanup, author_merge, article_merge, upsert_last, replace_upsert, eav_pivot, catalog_search, dedupe_priority, train_eval_split, weighted_replication, split_metrics, section_metrics, batch_numbers, probability_histogram, method_counts, coverage_summary, citation_resolution)}
_RECON = f"""a AS (SELECT article_id, citekey AS item_key, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS title_key FROM articles),
s AS (SELECT * FROM a WHERE article_id % 2 = 0),
u1 AS (SELECT item_key, min(article_id) AS lo, max(article_id) AS hi FROM s GROUP BY 1), u2 AS (SELECT title_key, min(article_id) AS lo, max(article_id) AS hi FROM s GROUP BY 1),
m AS (SELECT a.article_id, CASE WHEN u1.lo IS NOT NULL THEN u1.lo WHEN u2.lo = u2.hi THEN u2.lo END AS matched_id,
  CASE WHEN u1.lo IS NOT NULL THEN 'item_key' WHEN u2.lo <> u2.hi THEN 'ambiguous:title_key' WHEN u2.lo IS NOT NULL THEN 'title_key' ELSE 'none' END AS matched_by
  FROM a LEFT JOIN u1 ON a.article_id % 3 = 0 AND u1.item_key = a.item_key LEFT JOIN u2 ON u2.title_key = a.title_key)"""
_DUP = f"""k AS (SELECT article_id, md5(text) AS k1, CASE WHEN array_to_string(regexp_extract_all(strip_accents(lower(title)), '[a-z0-9]+'), ' ') <> '' THEN array_to_string(regexp_extract_all(strip_accents(lower(title)), '[a-z0-9]+'), ' ') || '|' || year END AS k2 FROM articles),
e AS (SELECT article_id AS u, min(article_id) OVER (PARTITION BY k1) AS v FROM k UNION SELECT article_id, min(article_id) OVER (PARTITION BY k2) FROM k WHERE k2 IS NOT NULL),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
w AS (SELECT u AS n, u AS c FROM b UNION SELECT b.v, w.c FROM w JOIN b ON w.n = b.u),
dup AS (SELECT n AS article_id, min(c) AS "group" FROM w GROUP BY 1)"""
SQL = {
    "graph_stats": "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM part) AS part, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM customer) AS customer",
    "graph_stats_strict": "SELECT CAST(0 AS BIGINT) AS orders, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS empty",
    "degree_counts": """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "ordered_collect_top5": "SELECT l_orderkey, string_agg(p, ',' ORDER BY i) FILTER (i <= 5) AS names FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS i FROM lineitem) GROUP BY 1",
    "neighbour_titles": f"WITH {t.ARTICLES}, {t.CITES} SELECT article_id AS id, coalesce(ts, '') AS titles FROM articles LEFT JOIN (SELECT src, array_to_string(list_sort(list(DISTINCT title))[1:5], '|') AS ts FROM cites JOIN articles ON dst = article_id GROUP BY 1) ON src = article_id",
    "article_lookup": f"WITH {t.ARTICLES}, {t.CHUNKS}, {t.CITES} SELECT article_id, title, year, (SELECT count(*) FROM chunks c WHERE c.article_id = a.article_id) AS chunks, (SELECT md5(substr(chunk_text, 1, 1200)) FROM chunks c WHERE c.article_id = a.article_id AND chunk_index = 0) AS first_md5, (SELECT count(*) FROM cites WHERE src = article_id) AS cites_out, (SELECT count(*) FROM cites WHERE dst = article_id) AS cited_by FROM articles a WHERE lower(citekey) = 'src3-63'",
    "article_chunks": f"WITH {t.ARTICLES}, {t.CHUNKS} SELECT article_id, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM chunks GROUP BY 1",
    "articles_by_keys": f"""WITH {t.ARTICLES}, q AS (SELECT lower(key) AS key, min(id) AS place FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'src' || id % 20 || '-' || id ELSE 'SRC' || id % 7 || '-' || id % 100 END AS key FROM (SELECT unnest(range(0, 400)) AS id)) GROUP BY 1)
SELECT q.key, place, coalesce(article_id, -1) AS article_id, CASE WHEN article_id IS NULL THEN 'missing' ELSE 'found' END AS state FROM q LEFT JOIN articles ON lower(citekey) = q.key""",
    "identity_exists": """WITH c AS (SELECT c_custkey, lower(trim(c_name)) AS n, nullif(CAST(round(c_acctbal) AS BIGINT), 0) AS b FROM customer), s AS (SELECT n, b + 1 AS b FROM c WHERE c_custkey % 4 = 0)
SELECT c_custkey, n IN (SELECT n FROM s) OR coalesce(b IN (SELECT b FROM s WHERE b IS NOT NULL), false) AS known FROM c""",
    "sync_antijoin": "SELECT o_custkey || ':1' AS pid, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1",
    "reconcile": f"WITH {t.ARTICLES}, {_RECON} SELECT article_id, coalesce(matched_id, -1) AS matched_id, matched_by FROM m",
    "reconcile_residual": f"""WITH {t.ARTICLES}, {_RECON}, h AS (SELECT title_key, count(*) AS n FROM s GROUP BY 1)
SELECT article_id, CASE WHEN matched_by = 'none' THEN 'not_found' ELSE matched_by END AS reason, CASE WHEN matched_by = 'none' THEN 0 ELSE n END AS holders FROM m JOIN a USING (article_id) LEFT JOIN h USING (title_key) WHERE matched_id IS NULL""",
    "method_counts": f"WITH {t.ARTICLES}, {_RECON} SELECT matched_by, count(*) AS n FROM m GROUP BY 1",
    "metadata_cascade": """WITH a AS (SELECT lower(p_name) AS k, min(p_type) AS m FROM part WHERE p_partkey % 5 = 0 GROUP BY 1), b AS (SELECT lower(p_brand) AS k, min(p_type) AS m FROM part WHERE p_partkey % 7 = 0 GROUP BY 1)
SELECT p_partkey, coalesce(a.m, b.m) AS meta FROM part LEFT JOIN a ON a.k = lower(p_name) LEFT JOIN b ON b.k = lower(p_brand)""",
    "reference_diff": """WITH b AS (SELECT DISTINCT sha1(text) AS f FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT DISTINCT sha1(text) AS f FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(b.f, a.f) AS fingerprint, CASE WHEN b.f IS NULL THEN 'added' WHEN a.f IS NULL THEN 'removed' ELSE 'kept' END AS state FROM b FULL JOIN a ON a.f = b.f""",
    "duplicate_components": f"WITH RECURSIVE {t.ARTICLES}, {_DUP} SELECT article_id, \"group\" FROM dup",
    "canonical_pick": f"WITH RECURSIVE {t.ARTICLES}, {_DUP} SELECT \"group\", article_id FROM (SELECT \"group\", article_id, row_number() OVER (PARTITION BY \"group\" ORDER BY length(text) DESC, year DESC, article_id) AS i FROM dup JOIN articles USING (article_id)) WHERE i = 1",
    "author_duplicate_candidates": """WITH f AS (SELECT p_name AS name, p_size AS works FROM part), n AS (SELECT name, max(works) AS works FROM (SELECT * FROM f UNION ALL SELECT string_split(name, ' ')[-1], 0 FROM f) GROUP BY 1),
a AS (SELECT name, works, regexp_extract_all(lower(name), '[a-z0-9]+') AS ts FROM n), p AS (SELECT s.name AS source, l.name AS target, s.ts AS t1, l.ts AS t2, len(list_distinct(s.ts)) AS d FROM a s JOIN a l ON s.name <> l.name AND s.works <= l.works AND len(list_distinct(s.ts)) < len(list_distinct(l.ts)) AND list_has_all(l.ts, s.ts) WHERE len(s.ts) > 0),
q AS (SELECT *, CASE WHEN d = 1 AND t2[-1] = t1[1] THEN 0.95 WHEN d = 1 AND t2[1] = t1[1] THEN 0.60 WHEN d > 1 AND t1[-1] = t2[-1] THEN 0.88 END AS score FROM p)
SELECT source, target, CAST(score AS DOUBLE) AS score, CASE score WHEN 0.95 THEN 'surname_only' WHEN 0.60 THEN 'first_name_only' ELSE 'subset_same_surname' END AS reason FROM q WHERE score IS NOT NULL""",
    "prior_work_links": f"WITH {t.ARTICLES}, {t.CITES} SELECT s.article_id AS src, d.article_id AS dst FROM articles s JOIN articles d ON s.author = d.author AND s.year > d.year WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.src = s.article_id AND c.dst = d.article_id)",
    "in_text_links": f"""WITH {t.ARTICLES}, {t.CHUNKS}, {t.CITES},
g AS (SELECT article_id AS dst, lower(CASE WHEN article_id % 2 = 0 THEN regexp_extract(title, '[A-Za-z]+') ELSE regexp_extract(title, '[A-Za-z]+ [A-Za-z]+') END) AS author, CAST(100 + article_id % 900 AS VARCHAR) AS year FROM articles),
l AS (SELECT article_id AS src, lower(chunk_text) AS t FROM chunks),
y AS (SELECT DISTINCT src, year FROM l JOIN (SELECT DISTINCT year FROM g) ON contains(t, year)),
a AS (SELECT DISTINCT src, author FROM l JOIN (SELECT DISTINCT author FROM g WHERE author <> '') ON contains(t, author) WHERE src IN (SELECT src FROM y))
SELECT DISTINCT a.src, g.dst FROM a JOIN y USING (src) JOIN g ON g.author = a.author AND g.year = y.year WHERE a.src <> g.dst AND NOT EXISTS (SELECT 1 FROM cites c WHERE c.src = a.src AND c.dst = g.dst)""",
    "stale_edge_cleanup": """WITH o AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 100 AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'reference_title_match' ELSE 'in_text_author_year' END AS method FROM orders) SELECT src, dst, method FROM o WHERE method LIKE 'reference_%' AND dst % 3 <> 0""",
    "orphan_cleanup": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "author_merge": "SELECT CASE WHEN l_suppkey > 10 AND l_suppkey IN (SELECT s_suppkey FROM supplier) THEN l_suppkey % 10 + 1 ELSE l_suppkey END AS l_suppkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2",
    "article_merge": f"""WITH {t.ARTICLES}, a AS (SELECT article_id, CASE WHEN article_id % 6 <> 0 THEN author END AS author, CASE WHEN article_id % 4 <> 0 THEN citekey ELSE '' END AS citekey, article_id - article_id % 2 AS k FROM articles)
SELECT k AS article_id, arg_min(author, article_id) FILTER (author <> '') AS author, arg_min(citekey, article_id) FILTER (citekey <> '') AS citekey FROM a GROUP BY 1""",
    "upsert_last": "SELECT l_suppkey AS src, l_partkey % 50 AS dst, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS method FROM lineitem GROUP BY 1, 2",
    "replace_upsert": "SELECT o_custkey AS article_id, o_orderkey AS ref FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 7 <> 0 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_custkey % 7 = 0",
    "eav_pivot": "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase, max(value) FILTER (event_type = 'click') AS click_value FROM events GROUP BY 1",
    "catalog_search": f"""WITH {t.ARTICLES}, h AS (SELECT * FROM articles WHERE contains(lower(title || chr(10) || author || chr(10) || citekey || chr(10) || year), 'ti'))
SELECT article_id, (SELECT count(*) FROM h) AS total, article_id % 2 = 0 AS stored FROM (SELECT article_id FROM h ORDER BY lower(title), article_id LIMIT 20 OFFSET 20)""",
    "dedupe_priority": "SELECT h, doc_id FROM (SELECT md5(text) AS h, d.doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY coalesce(quality, -1) DESC, d.doc_id) AS i FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE i = 1",
    "train_eval_split": f"SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT < {int(0.2 * (1 << 32))} THEN 'eval' ELSE 'train' END AS split FROM documents",
    "weighted_replication": "SELECT doc_id, CAST(unnest(range(1, quality * 2 + toxic + 1)) AS INTEGER) AS copy FROM labels",
    "split_metrics": f"""WITH {t.ARTICLES}, s AS (SELECT article_id, list_distinct(({t.WORDS.format("text")})[1:12]) AS gs, list_distinct({t.WORDS.format("title")}) AS ps FROM articles),
x AS (SELECT article_id, len(list_intersect(gs, ps)) AS h, len(gs) AS ng, len(ps) AS np FROM s),
y AS (SELECT article_id, CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN np > 0 THEN h / CAST(np AS DOUBLE) ELSE 0 END AS p, CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng > 0 THEN h / CAST(ng AS DOUBLE) ELSE 0 END AS r FROM x)
SELECT article_id, {_M("p")} AS precision, {_M("r")} AS recall, {_M("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END")} AS f1 FROM y""",
    "section_metrics": f"""WITH e AS (SELECT CAST(CAST(l_quantity % 7 + 1 AS INTEGER) - l_linenumber AS DOUBLE) AS e FROM lineitem) SELECT count(*) AS n, {_M("avg(abs(e))")} AS mae, {_M("sqrt(avg(e * e))")} AS rmse, {_M("avg(CASE WHEN e = 0 THEN 1.0 ELSE 0.0 END)")} AS exact FROM e""",
    "batch_numbers": "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 12) AS INTEGER) AS batch FROM documents",
    "probability_histogram": "SELECT CAST(floor(l_discount / (0.101 / 20)) + 1 AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "coverage_summary": f"SELECT source, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS missing, {_M('count(l.doc_id) / CAST(count(*) AS DOUBLE)')} AS share FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
}
