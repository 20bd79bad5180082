"""Corrections, notes, files, previews and datasets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillgraph.functions import names as n, quality as q, text as tx
from quillgraph.operators import corrections as c, datasets as d, index, notes, segmentation as s
from quillgraph.plans import tables as t
from quillgraph.plans.tables import table
from quillgraph.sources import attachments as at

_M = t.MICRO.format


def metadata_refresh(spark, sf):
    """Parts take over what another list has of them."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("doi"))
    new = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("article_id"), F.when(F.col("p_partkey") % 4 != 0, F.upper("p_name")).alias("title"), F.lit(None).cast("int").alias("year"), F.col("p_type").alias("doi"))
    return c.refresh_metadata(p, new)


def reconcile_update(spark, sf):
    """Customers take identity keys of their orders; blank ones change nothing."""
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("article_id"), F.when(F.col("c_custkey") % 2 == 0, "old").alias("persistent_id"), F.lit("I0").alias("item_key"), F.lit("i0").alias("item_key_norm"),
        F.lit(None).cast("string").alias("attachment_key"), F.lit(None).cast("string").alias("attachment_key_norm"), F.when(F.col("c_custkey") % 5 == 0, "hand").otherwise("").alias("metadata_source"),
    )
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("article_id")).agg(F.max("o_orderkey").alias("k"))
    rows = o.select("article_id", F.concat(F.lit("1:"), "k").alias("persistent_id"), F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("K"), "k")).alias("item_key"), F.concat(F.lit("A"), "k").alias("attachment_key"))
    return c.reconcile_update(a, rows, "catalogue")


def stub_creation(spark, sf):
    """An article for each supplier that is asked for; every fourth is there already."""
    sup = table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    a = sup.where("s_suppkey % 4 = 0").select(F.concat(F.lit("catalogue::S"), "s_suppkey").alias("article_id"), none.alias("citekey"), none.alias("external_id"), none.alias("source_path"), F.lit("old").alias("title"))
    wanted = sup.select(F.col("s_name").alias("citekey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("S"), "s_suppkey")).otherwise("").alias("external_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("title"))
    return c.ensure_stubs(a, wanted)


def _references(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("reference_id"), F.col("o_custkey").alias("article_id"), F.concat_ws("|", F.lower("o_orderpriority"), F.col("o_custkey") % 50).alias("ref_key"))


def delete_references(spark, sf):
    keys = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("1-urgent|"), F.col("c_custkey") % 50).alias("ref_key"))
    return c.delete_references(_references(spark, sf), keys).select("reference_id", "ref_key")


def _repointed(spark, sf):
    r = _references(spark, sf)
    resolves = r.where("reference_id % 2 = 0").select("reference_id", (F.col("article_id") % 20).alias("target_id"))
    cites = r.select(F.col("article_id").alias("src"), (F.col("article_id") % 20 + 1).alias("dst")).distinct().withColumns({"method": F.lit("reference_title_match"), "score": F.lit(0.5)})
    orders = spark.range(0, 40).select(F.concat(F.lit("2-high|"), "id").alias("ref_key"), F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("citekey"))
    articles = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("article_id"), F.initcap("s_name").alias("citekey"))
    return c.repoint_references(r, resolves, cites, orders, articles)


def repoint_resolves(spark, sf):
    return _repointed(spark, sf)[0]


def repoint_cites(spark, sf):
    return _repointed(spark, sf)[1]


def move_edges(spark, sf):
    """Edges of merged articles: odd ones become the even one below."""
    e = t.cites(spark, sf)
    mapping = table(spark, sf, "documents").where("doc_id % 2 = 1").select(F.col("doc_id").alias("old"), (F.col("doc_id") - 1).alias("new"))
    return c.move_edges(e, mapping, "src", "dst")


def merge_preview(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    mapping = table(spark, sf, "supplier").where("s_suppkey > 10").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") % 10 + 1).alias("new"))
    return c.merge_preview(li, "l_suppkey", mapping)


def canonical_choice(spark, sf):
    """Of each customer's orders the one to keep, by ten ranks."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("article_id"), "o_custkey", F.when(k % 2 == 0, "p").alias("persistent_id"), F.when(k % 3 == 0, "i").otherwise("").alias("item_key"), (k % 5 == 0).alias("missing"),
        F.when(k % 7 == 0, "c").alias("citekey"), F.when(k % 11 == 0, "10.1/x").alias("doi"), F.when(k % 13 == 0, "C:\\lib\\Storage\\a.pdf").otherwise("b.pdf").alias("source_path"), F.lit("/storage/").alias("storage_mark"),
        (k % 4).alias("chunk_count"), (k % 6).alias("reference_count"), (k % 3).alias("cite_count"),
    )
    return c.canonical_choice(rows, "o_custkey").select("o_custkey", "article_id")


def page_chunks(spark, sf):
    """Word windows of every document with their first and last pages, twelve lines a page."""
    rows = index.page_windows(table(spark, sf, "documents"), "doc_id", per_page=12)
    return rows.select("doc_id", "chunk_index", "page_start", "page_end", F.md5("chunk_text").alias("text_md5"))


def sections_of_chunks(spark, sf):
    return d.sections_of_chunks(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "section", F.col("role").alias("label"), "start", "end")


def spaced_headings(spark, sf):
    """Short lines, eight lines apart at least."""
    rows = s.lines_of(table(spark, sf, "documents"), "doc_id").where(F.length("line") < 60)
    return d.spaced_out(rows, "doc_id", "line_no")


def title_index_join(spark, sf):
    """Articles against parts of the catalogue by title, the first record of each."""
    a = t.articles(spark, sf).select("article_id", F.col("title").alias("title_guess"))
    cat = t.articles(spark, sf).where("article_id % 3 = 1").select("title", F.col("article_id").alias("place"))
    return d.join_by_title(a, cat).select("article_id", F.coalesce("record.place", F.lit(-1)).alias("record_id"), "origin")


def preview_summary(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).alias("will_ingest"), (F.col("doc_id") % 2 == 0).alias("existing"), (F.col("lang") == "en").alias("has_metadata"))
    return d.preview_summary(rows, 150, F.col("doc_id"))


def citation_details(spark, sf):
    a = t.articles(spark, sf)
    title = F.when(F.col("article_id") % 6 == 0, F.concat("title", F.lit(", pp. 4"))).otherwise(F.col("title"))
    r = q.citation_details(
        title, F.substring("text", 1, 400), F.when(F.col("article_id") % 3 != 0, F.col("year")), F.when(F.col("article_id") % 2 == 0, F.array("author")), F.when(F.col("article_id") % 5 == 0, F.lit("10.1/x")),
        F.when(F.col("article_id") % 4 != 0, (F.col("article_id") % 8) / 5), F.when(F.col("article_id") % 7 == 0, "llm").otherwise("heuristic"), F.col("article_id") % 10 == 9,
    )
    return a.select("article_id", r.alias("r")).select("article_id", tx.micro(F.col("r.score")).alias("score"), "r.needs_review", F.array_join("r.reasons", ",").alias("reasons"))


def recognition_summary(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", q.recognition_summary(F.col("text"), F.col("doc_id") % 9, F.lit(2), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "too_short").otherwise("")).alias("summary"))


def filename_fields(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.concat(F.regexp_extract("p_name", "[a-zA-Z]+", 0), F.lit(1900) + F.col("p_partkey") % 120, F.lit("-"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit(",x")))
    path = F.concat(F.lit("/lib/"), name, F.lit(".pdf"))
    return table(spark, sf, "part").select("p_partkey", n.filename_fields(path).alias("f"), n.slug(F.concat(F.lit(" -"), "p_name", F.lit("! "))).alias("slug")).select("p_partkey", "f.author", "f.year", "f.title", "slug")


def note_matches(spark, sf):
    """Pages as notes: some with a marker and an attachment id, some with a hint and Markdown, at attachments and parents."""
    k = F.col("page_id")
    body = F.when(k % 3 == 0, F.concat(F.lit("<p>SCAN_NOTE_V2</p><p>attachment_id = "), F.when(k % 2 == 0, k).otherwise(k + 1), F.lit("</p>"))).when(k % 3 == 1, F.lit("<p># Head</p><p>- one</p>")).otherwise(F.lit(""))
    rows = table(spark, sf, "pages").select(
        k.alias("note_id"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("N"), k)).alias("note_key"), F.when(k % 5 == 0, F.floor(k / 4) * 4 + 1000000).otherwise(k).alias("parent_id"),
        F.when(k % 2 == 1, "Scan of it").otherwise("Other").alias("title"), F.concat(body, F.lit("<div>"), F.substring(F.regexp_replace(F.coalesce("html", F.lit("")), "[^a-z ]", ""), 1, 200), F.lit("</div>")).alias("html"),
    )
    items = table(spark, sf, "pages").select(k.alias("attachment_id"), (F.floor(k / 4) * 4 + 1000000).alias("parent_id"))
    return notes.match_notes(items, rows, "SCAN_NOTE_V", "scan").select("attachment_id", "note_id", "note_key")


def attachment_files(spark, sf):
    """Customers as attachments with paths of all kinds."""
    k = F.col("c_custkey")
    key = k.cast("string")
    raw = (
        F.when(k % 9 == 0, "").when(k % 9 == 1, F.concat(F.lit("storage:"), key)).when(k % 9 == 2, F.concat(F.lit("http://x/"), key)).when(k % 9 == 3, F.concat(F.lit("D:\\Papers\\"), key))
        .when(k % 9 == 4, F.concat(F.lit("D:/papers/deep/"), key)).when(k % 9 == 5, F.concat(F.lit("\\\\host\\"), key)).when(k % 9 == 6, F.concat(F.lit("E:\\"), key)).otherwise(F.concat(F.lit("/home/"), key))
    )
    rows = table(spark, sf, "customer").select(k.alias("c_custkey"), F.concat(F.lit("A"), key).alias("attachment_key"), F.concat(F.lit("1:"), key).alias("persistent_id"), raw.alias("raw_path"), F.when(k % 9 == 1, F.concat(F.lit("/store/"), key)).otherwise("").alias("path"))
    folders = F.array(*[F.lit(x) for x in ("/store/", "/map/", "/deep/", "/home/", "/over/")])
    files = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.explode(F.transform(folders, lambda f: F.concat(f, key))).alias("path"))
    overrides = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.when(k % 20 == 0, F.concat(F.lit("A"), key)).otherwise(F.concat(F.lit("1:"), key)).alias("key"), F.concat(F.lit("/over/"), key).alias("path"))
    mapping = spark.createDataFrame([("d:/papers", "/map"), ("D:\\Papers\\Deep\\", "/deep")], "prefix string, folder string")
    return at.resolve_attachments(rows, files, overrides, mapping).select("c_custkey", "file", "resolver", "issue_code")


def sidecar_files(spark, sf):
    """Parts as file stems, recognised text in two folders under equal or only similar stems."""
    p = table(spark, sf, "part")
    stems = p.select(F.col("p_name").alias("stem"))
    exact = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("/b/"), "p_name", F.lit("-"), "p_partkey").alias("path"), F.col("p_name").alias("stem"), F.lit(1).alias("folder_order"))
    near = p.where("p_partkey % 5 = 0").select(F.concat(F.lit("/a/"), "p_name", F.lit("-"), "p_partkey").alias("path"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("stem"), F.lit(0).alias("folder_order"))
    return at.locate_sidecars(stems, exact.unionByName(near))


def body_chunks(spark, sf):
    """Word windows of every document that don't cross its sections of 25 lines, ten lines a page."""
    rows = s.lines_of(table(spark, sf, "documents"), "doc_id", per_page=10).withColumn("section", F.floor(F.col("line_no") / 25).cast("int"))
    return s.section_windows(rows, "doc_id", "section").select("doc_id", "section", "chunk_index", "page_start", "page_end", F.md5("chunk_text").alias("text_md5"))


def reference_starts(spark, sf):
    """Where references may begin among the chunks of each document."""
    rows = t.chunks(spark, sf).withColumn("text", F.when(F.col("article_id") % 4 == 0, F.concat("chunk_text", F.lit(" References"))).when(F.col("article_id") % 4 == 1, F.concat("chunk_text", F.lit(" 1999 2000 2001 2002 2003 2004 2005 2006"))).otherwise(F.col("chunk_text")))
    return s.reference_starts(rows, "article_id", "chunk_index", "text")


def section_eval(spark, sf):
    """Guessed heading lines and starts of orders' lines against given ones."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("gold"), F.collect_set((F.col("l_partkey") % 7).cast("int")).alias("guess"), F.min("l_linenumber").cast("int").alias("start"), F.min((F.col("l_suppkey") % 5)).cast("int").alias("at"))
    rows = d.section_eval(li.withColumn("at", F.when(F.col("at") > 0, F.col("at"))), "start", "at", "gold", "guess")
    return rows.select("l_orderkey", "delta", "exact_match", *[tx.micro(F.col(f"heading_{x}")).alias(x) for x in ("precision", "recall", "f1")])


def parsing_eval(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("s"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 3).alias("es"), (F.col("o_custkey") % 3).alias("n"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 3).alias("en"))
    return d.parsing_eval(o.withColumn("s", F.when(F.col("s") < 3, F.col("s"))), "s", "es", "n", "en")


def reference_forms(spark, sf):
    """References in the forms that evaluation compares, and whether they are noise."""
    a = t.articles(spark, sf)
    raw = F.concat(F.when(F.col("article_id") % 9 == 0, "References ").otherwise("  "), "author", F.lit("  "), "title", F.when(F.col("article_id") % 3 == 0, " DOI: 10.1/X").when(F.col("article_id") % 3 == 1, " https://x.org/a?b").otherwise(""))
    return a.select("article_id", tx.eval_form(raw).alias("form"), tx.eval_canon(raw).alias("canon"), tx.is_marker(F.substring("title", 1, 1)).alias("marker"), q.is_noise_reference(raw, "(?i)x[.]org").alias("noise"), q.is_reasonable_reference(raw, F.col("title"), 400, 8).alias("reasonable"))


def recognised_references(spark, sf):
    """Each document as a recognised page below a line of references: three words a line, names and years between."""
    lines = F.regexp_replace(F.col("text"), r"(\S+\s+\S+\s+\S+)\s+", "$1\nSmith, A\n1998 title ")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("intro\nReferences\n"), lines).alias("text"))
    return s.split_recognised(docs, "doc_id").select("doc_id", "ref_index", F.md5("raw_text").alias("text_md5"))


def vector_overwrite(spark, sf):
    """Labels of a third of all vectors are written anew, with some of unknown ones."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    fresh = v.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label")).unionByName(v.select((-F.col("vec_id") - 1).alias("vec_id"), "label"))
    return index.overwrite_vectors(v, fresh, "vec_id", "label")


def ordered_references(spark, sf):
    """Line items of every seventh order, by order and line, with blanks for what is missing."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("raw"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey")).alias("year"))
    return d.ordered_references(li, table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "l_linenumber")


def macro_split_scores(spark, sf):
    """Means of the scores of all turns' sentences against those of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select(*[F.transform(tx.sentences(c), tx.eval_form).alias(n) for n, c in (("gold", F.col("text")), ("guess", F.lag("text").over(w)))])
    means = d.macro_scores(d.prf(rows, "gold", "guess"), "precision", "recall", "f1")
    return means.select("n", *[tx.micro(F.round(F.col(f"macro_{x}"), 9)).alias(f"macro_{x}") for x in ("precision", "recall", "f1")])


def fuzzy_split_scores(spark, sf):
    """Sentences of each turn against those of the turn before it, each matched once by similarity."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    # Dealt before its sentences are found, which is most of the work besides the matching, and is done once for a turn.
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text").repartition("conv_id")
    rows = d.with_forms(turns.select("conv_id", "turn", tx.sentences(F.col("text")).alias("gold")), "gold", "gold").withColumn("guess", F.lag("gold").over(w))
    return d.fuzzy_scores(rows, "gold", "guess").select("conv_id", "turn", "fuzzy_overlap", *[tx.micro(F.col(f"fuzzy_{x}")).alias(x) for x in ("precision", "recall", "f1")])


QUERIES = {
    f.__name__: f
    for f in (
        metadata_refresh, reconcile_update, stub_creation, delete_references, repoint_resolves, repoint_cites, move_edges, merge_preview, canonical_choice, page_chunks, sections_of_chunks,
        spaced_headings, title_index_join, preview_summary, citation_details, recognition_summary, filename_fields, note_matches, attachment_files, sidecar_files, vector_overwrite, ordered_references, fuzzy_split_scores, macro_split_scores,
        body_chunks, reference_starts, section_eval, parsing_eval, reference_forms, recognised_references,
    )
}
_REF = "r AS (SELECT o_orderkey AS reference_id, o_custkey AS article_id, lower(o_orderpriority) || '|' || o_custkey % 50 AS ref_key FROM orders)"
_AIMS = f"""{_REF}, a AS (SELECT r.*, s_suppkey AS target_id FROM r JOIN (SELECT unnest(range(0, 40)) AS id) i ON r.ref_key = '2-high|' || id JOIN supplier ON lower(s_name) = 'supplier#' || lpad(CAST(id AS VARCHAR), 9, '0'))"""
_NORM = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')".format
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(trim(coalesce({0}, '')), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')".format
_FORMS = "list_distinct(list_transform({0}, lambda s: lower(trim(regexp_replace(s, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')))))".format
SQL = {
    "macro_split_scores": f"""WITH x AS (SELECT conv_id, turn, {_SENTENCES("text")} AS g, {_SENTENCES("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS p FROM conversations),
y AS (SELECT {_FORMS("g")} AS g, {_FORMS("p")} AS p FROM x), z AS (SELECT len(g) AS g, len(p) AS p, len(list_intersect(g, p)) AS h FROM y),
w AS (SELECT CASE WHEN g + p = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE CAST(h AS DOUBLE) / p END AS precision, CASE WHEN g + p = 0 THEN 1.0 WHEN g = 0 THEN 0.0 ELSE CAST(h AS DOUBLE) / g END AS recall FROM z),
v AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM w)
SELECT count(*) AS n, {", ".join(_M(f"round(avg({c}), 9)") + f" AS macro_{c}" for c in ("precision", "recall", "f1"))} FROM v""",
    "recognised_references": r"""WITH d AS (SELECT doc_id, string_split('intro' || chr(10) || 'References' || chr(10) || regexp_replace(text, '(\S+\s+\S+\s+\S+)\s+', '\1' || chr(10) || 'Smith, A' || chr(10) || '1998 title ', 'g'), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: lower(trim(x))), 'references') AS a, list_position(list_transform(ls, lambda x: contains(lower(x), 'article continued from')), true) AS z FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, a, z FROM e),
c AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ') AS line FROM l WHERE i >= a AND (z IS NULL OR z <= a OR i < z - 1)),
k AS (SELECT *, regexp_matches(line, '^(?:19|20)[0-9]{2}[A-Za-z]?\b') AS y, regexp_matches(line, '^[A-Z].*\b(?:19|20)[0-9]{2}[A-Za-z]?\b') AS n, lead(regexp_matches(line, '^(?:19|20)[0-9]{2}[A-Za-z]?\b'), 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS yb
  FROM c WHERE line <> '' AND NOT regexp_full_match(line, '[0-9]{1,3}')),
g AS (SELECT *, yb AND regexp_matches(line, '^[A-Z][A-Za-z''`.-]+(?:,\s*[A-Z][A-Za-z .,''`&-]+)?(?:\s+and\s+[A-Z][A-Za-z .,''`&-]+)?$') AS au FROM k),
w AS (SELECT *, last_value(CASE WHEN au THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS author, sum(CASE WHEN NOT au AND (y OR n) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS entry FROM g),
t AS (SELECT doc_id, entry, regexp_replace(string_agg(CASE WHEN y THEN coalesce(author || ' ', '') || line ELSE line END, ' ' ORDER BY i), '^[ .;]+|[ .;]+$', '', 'g') AS raw FROM w WHERE NOT au AND entry > 0 GROUP BY 1, 2),
u AS (SELECT doc_id, arg_min(raw, entry) AS raw, min(entry) AS entry FROM t WHERE length(raw) >= 28 GROUP BY doc_id, lower(raw))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry) - 1 AS INTEGER) AS ref_index, md5(raw) AS text_md5 FROM u""",
    "metadata_refresh": """SELECT p_partkey AS article_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 0 THEN upper(p_name) ELSE p_name END AS title, p_size AS year,
  CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand END AS doi FROM part""",
    "reconcile_update": """WITH o AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT c_custkey AS article_id, CASE WHEN k IS NOT NULL THEN '1:' || k WHEN c_custkey % 2 = 0 THEN 'old' END AS persistent_id, CASE WHEN k % 3 <> 0 THEN 'K' || k ELSE 'I0' END AS item_key,
  CASE WHEN k % 3 <> 0 THEN 'k' || k ELSE 'i0' END AS item_key_norm, 'A' || k AS attachment_key, 'a' || k AS attachment_key_norm,
  CASE WHEN c_custkey % 5 = 0 THEN 'hand' WHEN k IS NOT NULL THEN 'catalogue' ELSE '' END AS metadata_source FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "stub_creation": """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'catalogue::S' || s_suppkey ELSE 'catalogue-citekey::' || regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') END AS article_id, s_name AS citekey,
  CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey END AS external_id, CASE WHEN s_suppkey % 2 = 0 THEN 'catalogue://S' || s_suppkey ELSE 'catalogue-citekey://' || s_name END AS source_path,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 4 = 0 THEN 'old' END AS title FROM supplier""",
    "delete_references": f"WITH {_REF} SELECT reference_id, ref_key FROM r WHERE ref_key NOT IN (SELECT '1-urgent|' || c_custkey % 50 FROM customer WHERE c_custkey % 3 = 0)",
    "repoint_resolves": f"WITH {_AIMS} SELECT reference_id, target_id FROM a UNION ALL SELECT reference_id, article_id % 20 FROM r WHERE reference_id % 2 = 0 AND reference_id NOT IN (SELECT reference_id FROM a)",
    "repoint_cites": f"""WITH {_AIMS}, e AS (SELECT DISTINCT article_id AS src, target_id AS dst FROM a), c AS (SELECT DISTINCT article_id AS src, article_id % 20 + 1 AS dst FROM r)
SELECT src, dst, 'manual_correction_citekey' AS method, CAST(1 AS DOUBLE) AS score FROM e UNION ALL SELECT src, dst, 'reference_title_match', 0.5 FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.dst)""",
    "move_edges": f"WITH {t.CITES} SELECT DISTINCT CASE WHEN src % 2 = 1 THEN src - 1 ELSE src END AS src, CASE WHEN dst % 2 = 1 THEN dst - 1 ELSE dst END AS dst FROM cites",
    "merge_preview": "SELECT l_suppkey % 10 + 1 AS new, count(DISTINCT l_suppkey) AS sources, count(*) AS edges FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 10) GROUP BY 1",
    "canonical_choice": """SELECT o_custkey, o_orderkey AS article_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 = 0 DESC, o_orderkey % 3 = 0 DESC, o_orderkey % 5 = 0, o_orderkey % 7 = 0 DESC, o_orderkey % 11 = 0 DESC,
  o_orderkey % 13 = 0 DESC, o_orderkey % 4 DESC, o_orderkey % 6 DESC, o_orderkey % 3 DESC, length(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS i FROM orders) WHERE i = 1""",
    "page_chunks": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, {t.WORDS.format("line")} AS ws FROM l),
x AS (SELECT doc_id, flatten(list(ws ORDER BY i)) AS ws, flatten(list(list_transform(ws, lambda v: i // 12 + 1) ORDER BY i)) AS ps FROM w GROUP BY 1),
c AS (SELECT *, unnest(range(0, CASE WHEN len(ws) <= 220 THEN 1 ELSE CAST(ceil((len(ws) - 220) / 175.0) AS BIGINT) + 1 END)) AS k FROM x WHERE len(ws) > 0)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(ps[k * 175 + 1] AS INTEGER) AS page_start, CAST(ps[least(len(ws), k * 175 + 220)] AS INTEGER) AS page_end, md5(array_to_string(ws[k * 175 + 1 : k * 175 + 220], ' ')) AS text_md5 FROM c""",
    "sections_of_chunks": """WITH g AS (SELECT conv_id, role AS label, min(turn) AS start, max(turn) AS "end" FROM conversations GROUP BY 1, 2)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY start, label) - 1 AS INTEGER) AS section, label, start, "end" FROM g""",
    "spaced_headings": """WITH RECURSIVE l AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> '' AND length(trim(line)) < 60),
k AS (SELECT doc_id, min(line_no) AS line_no FROM l GROUP BY 1 UNION ALL SELECT doc_id, (SELECT min(l.line_no) FROM l WHERE l.doc_id = k.doc_id AND l.line_no >= k.line_no + 8) FROM k WHERE k.line_no IS NOT NULL)
SELECT doc_id, line_no FROM k WHERE line_no IS NOT NULL""",
    "title_index_join": f"""WITH {t.ARTICLES}, k AS (SELECT {_NORM("title")} AS k, min(article_id) AS place FROM articles WHERE article_id % 3 = 1 GROUP BY 1)
SELECT article_id, coalesce(place, -1) AS record_id, CASE WHEN place IS NULL THEN 'heuristic_citation' ELSE 'catalogue_title' END AS origin FROM articles LEFT JOIN k ON k.k = {_NORM("title")} AND k.k <> ''""",
    "preview_summary": """WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
SELECT count(*) AS total_resolved, count(*) FILTER (place <= 150) AS total_previewed, count(*) > 150 AS truncated, count(*) FILTER (place <= 150 AND n_chars > 500) AS will_ingest,
  count(*) FILTER (place <= 150 AND doc_id % 2 = 0) AS existing, count(*) FILTER (place <= 150 AND lang = 'en') AS has_metadata FROM p""",
    "citation_details": rf"""WITH {t.ARTICLES}, s AS (SELECT article_id, trim(regexp_replace(CASE WHEN article_id % 6 = 0 THEN title || ', pp. 4' ELSE title END, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS t, trim(regexp_replace(substr(text, 1, 400), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS r FROM articles),
f AS (SELECT *, article_id % 3 = 0 AS ny, length(t) NOT BETWEEN 8 AND 240 AS wt, article_id % 2 = 1 AS na, regexp_matches(t, '(?i),[ \t]*pp\b|pp\.[ \t]*[0-9]|^[0-9]+([.][0-9]+)+$') AS br, len(regexp_extract_all(r, '[A-Za-z0-9][A-Za-z0-9''/-]*')) > 55 AS pr, article_id % 10 = 9 AS bad FROM s),
g AS (SELECT *, CASE WHEN ny THEN 0 ELSE 0.2 END + CASE WHEN wt THEN 0 ELSE 0.25 END + CASE WHEN na THEN 0 ELSE 0.2 END + CASE WHEN article_id % 5 = 0 THEN 0.15 ELSE 0 END + CASE WHEN article_id % 4 <> 0 THEN least(0.2, article_id % 8 / 5.0 * 0.2) ELSE 0 END
  + CASE WHEN article_id % 7 = 0 THEN 0.1 ELSE 0.05 END - CASE WHEN br THEN 0.2 ELSE 0 END - CASE WHEN pr THEN 0.2 ELSE 0 END AS x FROM f)
SELECT article_id, CASE WHEN bad THEN 0 ELSE {_M("greatest(0, least(1, CAST(round(x, 9) AS DOUBLE)))")} END AS score, bad OR ny OR wt OR br OR pr AS needs_review,
  CASE WHEN bad THEN 'invalid_reference_text' ELSE array_to_string(list_filter([CASE WHEN ny THEN 'missing_year' END, CASE WHEN wt THEN 'weak_title' END, CASE WHEN na THEN 'missing_authors' END, CASE WHEN br THEN 'truncated_title' END, CASE WHEN pr THEN 'prose_like_reference' END], lambda v: v IS NOT NULL), ',') END AS reasons FROM g""",
    "recognition_summary": r"""WITH x AS (SELECT doc_id, source, trim(text) AS t FROM documents), y AS (SELECT *, length(t) AS n, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS a, length(t) - length(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]+', '', 'g')) AS u FROM x)
SELECT doc_id, 'heuristic:' || source || ';lines=' || doc_id % 9 || ';pages=2;chars=' || n || ';tokens=' || len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9''-]*')) || ';alpha_ratio=' || printf('%.3f', floor(1000 * coalesce(a / nullif(CAST(n AS DOUBLE), 0), 0) + 0.5) / 1000)
  || ';suspect_ratio=' || printf('%.3f', floor(1000 * coalesce(u / nullif(CAST(n AS DOUBLE), 0), 0) + 0.5) / 1000) || ';native_reason=' || CASE WHEN doc_id % 2 = 0 THEN 'too_short' ELSE 'unknown' END AS summary FROM y""",
    "filename_fields": r"""WITH p AS (SELECT p_partkey, p_name, p_partkey % 3 <> 0 AS fits, regexp_extract(p_name, '[a-zA-Z]+') AS a, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), '') AS camel FROM part)
SELECT p_partkey, CASE WHEN fits THEN upper(a[1]) || lower(a[2:]) ELSE 'Unknown Author' END AS author, CASE WHEN fits THEN CAST(1900 + p_partkey % 120 AS INTEGER) END AS year,
  CASE WHEN fits THEN regexp_replace(regexp_replace(camel, '([a-z])([A-Z])', '\1 \2', 'g'), '^[ _,-]+|[ _,-]+$', '', 'g') || ', x' ELSE regexp_replace(p_name, '^[ _,-]+|[ _,-]+$', '', 'g') END AS title,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM p""",
    "note_matches": r"""WITH b AS (SELECT page_id AS k, length(trim(substr(regexp_replace(coalesce(html, ''), '[^a-z ]', '', 'g'), 1, 200))) AS n FROM pages),
z AS (SELECT k, CASE WHEN k % 5 = 0 THEN k // 4 * 4 + 1000000 ELSE k END AS owner, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN k ELSE k + 1 END END AS named,
  length(trim(CASE WHEN k % 3 = 0 THEN 'SCAN_NOTE_V2' || chr(10) || 'attachment_id = ' || CASE WHEN k % 2 = 0 THEN k ELSE k + 1 END || chr(10) WHEN k % 3 = 1 THEN '# Head' || chr(10) || '- one' || chr(10) ELSE '' END || substr(regexp_replace(coalesce(h.html, ''), '[^a-z ]', '', 'g'), 1, 200))) AS len
  FROM b JOIN pages h ON h.page_id = k WHERE k % 11 <> 0),
g AS (SELECT * FROM z WHERE len >= 120 AND (k % 3 = 0 OR (k % 3 = 1 AND k % 2 = 1))),
m AS (SELECT page_id AS attachment_id, 0 AS level, g.k FROM pages JOIN g ON owner = page_id UNION ALL SELECT page_id, 1, g.k FROM pages JOIN g ON owner = page_id // 4 * 4 + 1000000 WHERE named IS NULL OR named = page_id)
SELECT attachment_id, k AS note_id, 'N' || k AS note_key FROM (SELECT *, row_number() OVER (PARTITION BY attachment_id ORDER BY level, k) AS i FROM m) WHERE i = 1""",
    "attachment_files": """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS m, c_custkey % 4 <> 0 AS e, c_custkey % 10 = 0 AND c_custkey % 4 <> 0 AS o FROM customer)
SELECT k AS c_custkey, CASE WHEN m = 0 THEN NULL WHEN o THEN '/over/' || k WHEN NOT e THEN NULL WHEN m = 1 THEN '/store/' || k WHEN m = 3 THEN '/map/' || k WHEN m = 4 THEN '/deep/' || k WHEN m >= 7 THEN '/home/' || k END AS file,
  CASE WHEN m = 0 THEN '' WHEN o THEN 'attachment_override' WHEN m = 1 THEN 'local_storage' WHEN m = 2 THEN 'linked_url' WHEN m IN (3, 4) AND e THEN 'linked_path_map' WHEN m IN (3, 4, 5, 6) THEN 'linked_path' ELSE 'local_linked_path' END AS resolver,
  CASE WHEN m = 0 THEN 'missing_attachment_path' WHEN o THEN NULL WHEN m = 2 THEN 'linked_url' WHEN m = 5 THEN 'linked_unc_path' WHEN m = 6 THEN 'linked_windows_path' WHEN e THEN NULL WHEN m = 1 THEN 'storage_missing_local' WHEN m IN (3, 4) THEN 'linked_windows_path' ELSE 'local_path_missing' END AS issue_code FROM c""",
    "sidecar_files": """WITH p AS (SELECT DISTINCT p_name AS stem, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part),
f AS (SELECT '/b/' || p_name || '-' || p_partkey AS path, p_name AS stem, 1 AS o FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT '/a/' || p_name || '-' || p_partkey, upper(replace(p_name, ' ', '_')), 0 FROM part WHERE p_partkey % 5 = 0)
SELECT stem, path FROM (SELECT p.stem, path, row_number() OVER (PARTITION BY p.stem ORDER BY o, p.stem = f.stem DESC, path) AS i FROM p JOIN f ON regexp_replace(lower(f.stem), '[^a-z0-9]+', '', 'g') = k WHERE k <> '') WHERE i = 1""",
    "vector_overwrite": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings",
    "ordered_references": "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag ELSE '' END AS raw, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE -1 END AS year FROM lineitem WHERE l_orderkey % 7 = 0",
    "body_chunks": rf"""WITH l AS (SELECT doc_id, i // 25 AS section, i, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> ''),
w AS (SELECT doc_id, section, i, {t.WORDS.format("line")} AS ws FROM l),
x AS (SELECT doc_id, section, min(i) AS first, flatten(list(ws ORDER BY i)) AS ws, flatten(list(list_transform(ws, lambda v: i // 10 + 1) ORDER BY i)) AS ps FROM w GROUP BY 1, 2),
c AS (SELECT *, unnest(range(0, CASE WHEN len(ws) <= 220 THEN 1 ELSE CAST(ceil((len(ws) - 220) / 175.0) AS BIGINT) + 1 END)) AS k FROM x WHERE len(ws) > 0)
SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, k) - 1 AS INTEGER) AS chunk_index, CAST(ps[k * 175 + 1] AS INTEGER) AS page_start,
  CAST(ps[least(len(ws), k * 175 + 220)] AS INTEGER) AS page_end, md5(array_to_string(ws[k * 175 + 1 : k * 175 + 220], ' ')) AS text_md5 FROM c""",
    "reference_starts": rf"""WITH {t.ARTICLES}, {t.CHUNKS}, x AS (SELECT article_id, chunk_index, chunk_text || CASE article_id % 4 WHEN 0 THEN ' References' WHEN 1 THEN ' 1999 2000 2001 2002 2003 2004 2005 2006' ELSE '' END AS t FROM chunks)
SELECT article_id, CAST(coalesce(min(chunk_index) FILTER (regexp_matches(t, '(?i)(^|[^A-Za-z])(references cited|references|bibliography|works cited)([^A-Za-z]|$)')),
  max(chunk_index) FILTER (len(regexp_extract_all(t, '\b[0-9]{{4}}\b')) >= 8), greatest(0, count(*) - 6)) AS BIGINT) AS start FROM x GROUP BY 1""",
    "section_eval": f"""WITH o AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS g, list_distinct(list(l_partkey % 7)) AS p, min(l_linenumber) AS s, min(l_suppkey % 5) AS a FROM lineitem GROUP BY 1),
h AS (SELECT *, len(list_intersect(g, p)) AS h, CASE WHEN a > 0 THEN CAST(a - s AS INTEGER) END AS delta FROM o), m AS (SELECT *, h / CAST(len(p) AS DOUBLE) AS pr, h / CAST(len(g) AS DOUBLE) AS re FROM h)
SELECT l_orderkey, delta, coalesce(delta = 0, false) AS exact_match, {_M("pr")} AS precision, {_M("re")} AS recall, {_M("CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END")} AS f1 FROM m""",
    "parsing_eval": """WITH x AS (SELECT CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END AS s, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END AS es, o_custkey % 3 AS n, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END AS en FROM orders)
SELECT count(*) AS cases, count(*) FILTER (s IS NOT DISTINCT FROM es) AS starts, count(*) FILTER (n = en) AS counts, count(*) FILTER (n = en AND s IS NOT DISTINCT FROM es) AS passed FROM x""",
    "reference_forms": rf"""WITH {t.ARTICLES}, x AS (SELECT article_id, title, CASE WHEN article_id % 9 = 0 THEN 'References ' ELSE '  ' END || author || '  ' || title || CASE article_id % 3 WHEN 0 THEN ' DOI: 10.1/X' WHEN 1 THEN ' https://x.org/a?b' ELSE '' END AS raw FROM articles),
y AS (SELECT *, trim(regexp_replace(raw, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS sq, trim(regexp_replace(title, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS ti FROM x)
SELECT article_id, lower(sq) AS form, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(sq), '(^|[^a-z0-9_])doi: *', '\1 ', 'g'), 'https?://[^ ]+', ' ', 'g'), '[a-z0-9]+'), ' ') AS canon,
  regexp_matches(trim(title[1]), '^(\[[0-9]+\]|[0-9]+[.)]?|[A-Za-z]-[0-9]+)?$') AS marker, length(sq) < 12 OR contains(lower(sq), 'x.org') OR starts_with(lower(sq), 'references') AS noise,
  length(raw) BETWEEN 20 AND 400 AND length(ti) >= 8 AND NOT regexp_matches(ti, '(?i)https?://|www\.') AS reasonable FROM y""",
}
