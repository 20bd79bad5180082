"""Evidence, quality, keyword and text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillgraph.functions import quality as q, text as tx, vocabulary as v
from quillgraph.operators import asking as a, catalogue as cat, evidence as e, index, segmentation as s
from quillgraph.plans import tables as t
from quillgraph.session import stage

_M = t.MICRO.format
_HAVE = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9''-]*'))".format
_ASTOP = ", ".join(f"'{w}'" for w in v.ANSWER_STOPWORDS)
_INTENT = ", ".join(f"'{w}'" for w in v.INTENT_STOPWORDS)
_FACET = ", ".join(f"'{w}'" for w in v.FACET_STOPWORDS)
_QUESTION = ", ".join(f"'{w}'" for w in v.QUESTION_WORDS)
_GENERIC = ", ".join(f"'{w}'" for w in v.REWRITE_GENERIC)
_KSTOP = ", ".join(f"'{w}'" for w in v.KEYWORD_STOPWORDS)
WORDS = v.Vocabulary(families={"culture": ("the", "and"), "place": ("thing", "ention"), "artifact": ("that", "then")})

_ALLFAM = ", ".join(f"'{w}'" for ws in WORDS.families.values() for w in ws)


def _claims(spark, sf):
    """Each benchmark item against the ten chunks, of all documents, that hold its words most often."""
    chunks = t.chunks(spark, sf)
    b = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    # Articles of one id share their chunks' ids, and only then are counts summed over several rows.
    once = t.table(spark, sf, "documents").groupBy("doc_id").count().where("count > 1").isEmpty()
    near = stage(e.claim_chunks(b, chunks, 10) if once else e.claim_candidates(b, index.postings(chunks, "chunk_id"), 10), "near")
    # Ten chunks of a claim are few: they choose the texts before these meet anything else.
    texts = near.join(chunks, "chunk_id").join(t.articles(spark, sf).select("article_id", "title", "year"), "article_id")
    return b.join(texts, "claim_id")


def claim_match(spark, sf):
    rows = e.score_claims(_claims(spark, sf), 3)
    return rows.select("claim_id", "article_id", "chunk_id", "place", tx.micro(F.col("score")).alias("score"), "classification")


def _turns(spark, sf):
    """A user's turn with the assistant's next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.table(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def relevance_gate(spark, sf):
    rows = e.gate_relevance(_turns(spark, sf).withColumnRenamed("answer", "evidence"), v.ANSWER_STOPWORDS, WORDS)
    return rows.select("conv_id", "turn", "overlap", "families", "relevance", "usable")


def answer_audit(spark, sf):
    rows = e.audit_answers(_turns(spark, sf).withColumn("evidence", F.when(F.col("conv_id") % 5 != 0, F.col("question"))))
    return rows.select("conv_id", "turn", "supported", "unsupported", tx.micro(F.col("risk")).alias("risk"), "risk_label")


def text_quality_report(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", q.text_quality(F.col("text")).alias("r")).select("doc_id", "r.*")


def quality_metrics(spark, sf):
    """How the malformed flag agrees with the labels."""
    rows = text_quality_report(spark, sf).join(t.table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("malformed").alias("malformed"), F.sum("token_count").alias("tokens"))


def keyword_extract(spark, sf):
    """Seeds (title, journal, publisher) and the most frequent body tokens of each article."""
    rows = t.articles(spark, sf).withColumns({"journal": F.concat(F.lit("The "), "author"), "publisher": F.when(F.col("article_id") % 2 == 0, F.split("title", " ")[0]).otherwise(F.concat("title", F.lit("!")))})
    rows = cat.keywords(rows, "article_id", ("title", "journal", "publisher"), "text")
    return rows.select("article_id", "value", tx.micro(F.col("score")).alias("score"), "origin")


def _asked(spark, sf):
    """The first turn of each conversation as its question, and the assistant's turns of two in three as what was found."""
    c = t.table(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min("turn").alias("first"))
    found = c.join(first, "conv_id").where("turn > first and role = 'assistant' and conv_id % 3 <> 0").select("conv_id", F.col("turn").alias("position"), "text", F.col("role").alias("authors"))
    return first.select("conv_id", "question"), found


def grounded_answers(spark, sf):
    """What becomes of each conversation's question: nothing found, nothing relevant, or the evidence that passes."""
    rows = a.ground_answers(*_asked(spark, sf), "conv_id", vocabulary=WORDS)
    return rows.select("conv_id", "status", "fallback_reason", F.array_join("used", ",").alias("used"), F.array_join("excluded", ",").alias("excluded"), F.md5(F.array_join("snippets", "|")).alias("snippets_md5"))


def rewritten_questions(spark, sf):
    """Every user's turn as a search query, with expansions of two words."""
    c = t.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.initcap(F.substring_index("text", " ", 1)), F.lit(" "), "text", F.lit(" 1999")).alias("question"))
    rows = a.rewrite_questions(c, vocabulary=WORDS, expansions={"the": ("typology", "lithic", "the"), "thing": ("ceramic", "wares")})
    return rows.select("conv_id", "turn", "directive", "compact_query", "sane", F.md5("search_query").alias("search_md5"))


def normalized_keys(spark, sf):
    """Titles, DOIs, paths and look-up keys in canonical form."""
    a = t.articles(spark, sf)
    doi = F.concat(F.lit(" HTTPS://doi.org/10.1234/"), F.col("citekey"), F.lit("., "))
    path = F.concat(F.lit("C:\\lib\\"), F.col("citekey"), F.lit(".PDF"))
    return a.select("article_id", tx.normalize_title(F.col("title")).alias("title_norm"), tx.title_year_key(F.col("title"), F.col("year")).alias("title_year"), tx.normalize_doi(doi).alias("doi"), tx.path_stem(path).alias("stem"), tx.lookup_key(F.col("citekey")).alias("look_up"))


def reference_chunks(spark, sf):
    return t.chunks(spark, sf).where(tx.looks_like_references(F.col("chunk_text"))).select("chunk_id")


def html_note_text(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("text_md5"))


def years_and_dois(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.coalesce(tx.first_year(F.col("text")), F.lit(0)).alias("year"), tx.first_doi(F.concat(F.lit("see 10.1000/"), F.col("source"), F.lit("; and"))).alias("doi"))


def header_footer_strip(spark, sf):
    kept = s.strip_running_lines(s.lines_of(t.table(spark, sf, "documents"), "doc_id", per_page=8), "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


def reference_split(spark, sf):
    rows = s.split_references(s.lines_of(t.table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit("\nReferences\nlast"))), "doc_id"), "doc_id")
    return rows.groupBy("doc_id", "part").agg(F.count("*").alias("n"))


def citation_quality(spark, sf):
    """Scores of reference-like rows made of the documents."""
    a = t.articles(spark, sf)
    year = F.when(F.col("article_id") % 3 != 0, F.col("year"))
    raw = F.concat("author", F.lit(" "), "title", F.when(F.col("article_id") % 4 == 0, " http://x.org/").when(F.col("article_id") % 7 == 0, " All rights reserved").otherwise(""))
    score = q.citation_score(F.col("title"), raw, year, F.when(F.col("article_id") % 2 == 0, F.array("author")), F.when(F.col("article_id") % 5 == 0, F.lit("10.1/x")))
    return a.select("article_id", tx.micro(score).alias("score"), (score >= 0.35).alias("accepted"))


def markdown_sections(spark, sf):
    """Sections of documents whose every fifth line is made a heading."""
    rows = s.lines_of(t.table(spark, sf, "documents"), "doc_id")
    marked = rows.withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.col("line_no") / 5 % 3).cast("int") + 1), F.lit(" "), F.substring("line", 1, 20))).otherwise(F.regexp_replace("line", "^#+", "")))
    return s.sections(marked, "doc_id").select("doc_id", "section", "level", "start_line", "end_line")


_LINES = """lines AS (
  SELECT doc_id, CAST(floor(i / {0}) AS INTEGER) + 1 AS page, i AS line_no, trim(l) AS line
  FROM (SELECT doc_id, ls[i + 1] AS l, i FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split({1}, chr(10)) AS ls FROM documents))) WHERE trim(l) <> '')""".format
_TURNS = """turns AS (SELECT conv_id, turn, text AS question, answer FROM (
  SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""
_FAM = [f"list_intersect(asked, [{', '.join(repr(w) for w in ws)}])" for ws in WORDS.families.values()]
_REF = "(t <> '' AND (starts_with(t, 'references') OR starts_with(t, 'bibliography') OR starts_with(t, 'works cited') OR starts_with(t, 'literature cited') OR len(regexp_extract_all(t, 'doi')) >= 2 OR len(list_filter(regexp_extract_all(t, '[0-9a-z_]+'), lambda w: regexp_full_match(w, '(19|20)[0-9]{2}'))) >= 5))"
_AUDIT = f"list_filter({{0}}, lambda t: length(t) > 2 AND t NOT IN ({', '.join(repr(w) for w in v.STOPWORDS)}))"
QUERIES = {f.__name__: f for f in (grounded_answers, rewritten_questions, claim_match, relevance_gate, answer_audit, text_quality_report, quality_metrics, keyword_extract, normalized_keys, reference_chunks, html_note_text, years_and_dois, header_footer_strip, reference_split, citation_quality, markdown_sections)}
_TQ = r"""tq AS (SELECT doc_id, CAST(length(x) AS INTEGER) AS char_count, CAST(length(regexp_replace(x, '[^\p{L}]', '', 'g')) AS INTEGER) AS alpha_count,
    CAST(len(regexp_extract_all(x, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]')) AS INTEGER) AS suspect_count, CAST(len(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9''-]*')) AS INTEGER) AS token_count
  FROM (SELECT doc_id, trim(text) AS x FROM documents)),
tr AS (SELECT *, array_to_string(list_filter([CASE WHEN char_count < 200 THEN 'native_text_too_short' END, CASE WHEN token_count < 40 THEN 'native_token_count_too_low' END,
    CASE WHEN alpha_count / char_count < 0.45 THEN 'alpha_ratio_too_low' END, CASE WHEN suspect_count / char_count > 0.02 THEN 'suspect_char_ratio_too_high' END], lambda r: r IS NOT NULL), ',') AS rs FROM tq)"""
SQL = {
    "claim_match": f"""WITH {t.ARTICLES}, {t.CHUNKS}, {t.TOKENS},
near AS (SELECT item_id, chunk_id FROM (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY sum(n) DESC, chunk_id) AS i
  FROM (SELECT item_id, unnest(list_distinct({t.sql_tokens("text", f" AND t NOT IN ({_INTENT})")})) AS token FROM benchmark) JOIN tokens USING (token) GROUP BY 1, 2) WHERE i <= 10),
p AS (SELECT b.item_id AS claim_id, lower(b.text) AS cl, c.article_id, c.chunk_id, lower(a.title) AS ti, lower(c.chunk_text) AS tx, a.year,
    list_distinct({t.sql_tokens("b.text", f" AND t NOT IN ({_INTENT})")}) AS asked, {_HAVE("c.chunk_text")} AS own, {_HAVE("a.title")} AS heads
  FROM near n JOIN benchmark b ON b.item_id = n.item_id JOIN chunks c ON c.chunk_id = n.chunk_id JOIN articles a ON a.article_id = c.article_id),
f AS (SELECT *, list_filter(asked, lambda t: length(t) >= 4 AND t NOT IN ({_FACET})) AS crit, trim(tx) AS t, len(list_intersect(asked, own)) AS hits,
    list_transform(list_filter(regexp_extract_all(cl, '[0-9a-z_]+'), lambda w: regexp_full_match(w, '(19|20)[0-9]{{2}}')), lambda y: CAST(y AS INTEGER)) AS ys,
    list_filter(list_transform(regexp_extract_all(cl, '"([^"]+)"', 1), lambda p: trim(p)), lambda p: p <> '') AS ph FROM p),
g AS (SELECT *, CASE WHEN len(crit) > 0 THEN len(list_intersect(crit, list_concat(own, heads))) / len(crit) ELSE 0 END AS critical,
    CASE WHEN contains(cl, 'without') AND contains(cl, 'review') AND (contains(ti || ' ' || tx, 'human review') OR contains(ti || ' ' || tx, 'expert review')) THEN 0.35 ELSE 0.0 END AS contra FROM f),
h AS (SELECT *, CAST(0.9 AS DOUBLE) * CASE WHEN len(asked) > 0 THEN hits / len(asked) ELSE 0 END + CAST(0.2 AS DOUBLE) * CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, heads)) / len(asked) ELSE 0 END
    + CAST(0.55 AS DOUBLE) * CASE WHEN len(ph) > 0 THEN len(list_filter(ph, lambda p: contains(tx, p) OR contains(ti, p))) / len(ph) ELSE 0 END
    + CASE WHEN list_contains(ys, year) THEN 0.2 ELSE 0 END + least(CAST(0.25 AS DOUBLE), CAST(0.04 AS DOUBLE) * hits) + CAST(0.35 AS DOUBLE) * critical - CASE WHEN {_REF} THEN 0.45 ELSE 0 END
    - CASE WHEN contains(cl, 'archaeolog') AND NOT contains(ti || ' ' || tx, 'archaeolog') THEN 0.28 ELSE 0 END - contra AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, article_id ORDER BY score DESC, chunk_id) AS place FROM h),
c AS (SELECT claim_id, article_id, CASE WHEN score >= 0.95 AND critical >= 0.45 AND contra = 0 THEN 'direct_support' WHEN score >= 0.45 THEN 'adjacent_or_partial_support' ELSE 'not_supported' END AS classification FROM r WHERE place = 1)
SELECT claim_id, article_id, chunk_id, CAST(place AS INTEGER) AS place, {_M("score")} AS score, classification FROM r JOIN c USING (claim_id, article_id) WHERE place <= 3""",
    "relevance_gate": f"""WITH {_TURNS},
k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_ASTOP}))) AS asked,
  list_distinct(list_filter(regexp_extract_all(lower(answer), '[a-z0-9][a-z0-9-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_ASTOP}))) AS have FROM turns),
m AS (SELECT *, CAST(len(list_intersect(asked, have)) AS INTEGER) AS overlap, {" + ".join(f"CAST(len({f}) > 0 AS INTEGER)" for f in _FAM)} AS named, {" + ".join(f"CAST(len(list_intersect({f}, have)) > 0 AS INTEGER)" for f in _FAM)} AS families FROM k)
SELECT conv_id, turn, overlap, families, overlap + 2 * families AS relevance, overlap >= CASE WHEN named > 0 THEN 2 ELSE 1 END AND families >= least(2, named) AS usable FROM m""",
    "answer_audit": f"""WITH {_TURNS},
p AS (SELECT conv_id, turn, conv_id % 5 = 0 AS bare, {_AUDIT.format(_HAVE("CASE WHEN conv_id % 5 <> 0 THEN question ELSE '' END"))} AS cited,
  regexp_split_to_array(regexp_replace(trim(answer), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM turns),
s AS (SELECT conv_id, turn, bare, cited, list_filter(list_transform(ss, lambda x: {_AUDIT.format(_HAVE("x")).replace("lambda t:", "lambda t:")}), lambda y: len(y) > 0) AS said FROM p),
c AS (SELECT conv_id, turn, bare, len(said) AS n, len(list_filter(said, lambda y: NOT list_has_any(y, cited))) AS bad FROM s),
r AS (SELECT *, least(1.0, bad / CAST(greatest(1, n) AS DOUBLE) + CASE WHEN bare THEN 0.25 ELSE 0 END) AS risk FROM c)
SELECT conv_id, turn, CAST(n - bad AS INTEGER) AS supported, CAST(bad AS INTEGER) AS unsupported, {_M("risk")} AS risk, CASE WHEN risk < 0.25 THEN 'low' WHEN risk < 0.6 THEN 'medium' ELSE 'high' END AS risk_label FROM r""",
    "text_quality_report": f"WITH {_TQ} SELECT doc_id, char_count, alpha_count, suspect_count, token_count, rs <> '' AS malformed, CASE WHEN rs <> '' THEN rs ELSE 'native_text_looks_usable' END AS reason FROM tr",
    "quality_metrics": f"WITH {_TQ} SELECT quality, count(*) AS n, count(*) FILTER (rs <> '') AS malformed, CAST(sum(token_count) AS BIGINT) AS tokens FROM tr JOIN labels USING (doc_id) GROUP BY 1",
    "keyword_extract": f"""WITH {t.ARTICLES},
c AS (SELECT article_id, value, count(*) AS n FROM (SELECT article_id, unnest({t.sql_tokens("text")}) AS value FROM articles) WHERE length(value) >= 4 AND value NOT IN ({_KSTOP}) GROUP BY ALL),
s AS (SELECT article_id, list_filter(list_distinct(list_transform([title, 'The ' || author, CASE WHEN article_id % 2 = 0 THEN string_split(title, ' ')[1] ELSE title || '!' END], lambda x: array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' '))), lambda x: x <> '') AS seeds FROM articles),
m AS (SELECT *, max(n) OVER (PARTITION BY article_id) AS most FROM c),
p AS (SELECT m.*, len(seeds) AS k, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, value) AS place FROM m JOIN s USING (article_id) WHERE NOT list_contains(seeds, value))
SELECT article_id, value, {_M("least(0.9, 0.2 + n / CAST(most AS DOUBLE))")} AS score, 'heuristic_tokens' AS origin FROM p WHERE place <= 32 - k
UNION ALL SELECT article_id, unnest(seeds), 950000, 'metadata_seed' FROM s""",
    "grounded_answers": f"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS question, min(turn) AS first FROM conversations GROUP BY 1),
turns AS (SELECT c.conv_id, c.turn, question, c.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS i, 'assistant ' || c.text AS answer FROM conversations c JOIN f USING (conv_id) WHERE c.turn > first AND role = 'assistant' AND c.conv_id % 3 <> 0),
k AS (SELECT conv_id, i, text, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_ASTOP}))) AS asked,
  list_distinct(list_filter(regexp_extract_all(lower(answer), '[a-z0-9][a-z0-9-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_ASTOP}))) AS have FROM turns),
m AS (SELECT *, len(list_intersect(asked, have)) AS overlap, {" + ".join(f"CAST(len({f}) > 0 AS INTEGER)" for f in _FAM)} AS named, {" + ".join(f"CAST(len(list_intersect({f}, have)) > 0 AS INTEGER)" for f in _FAM)} AS families FROM k),
u AS (SELECT *, overlap >= CASE WHEN named > 0 THEN 2 ELSE 1 END AND families >= least(2, named) AS usable FROM m),
p AS (SELECT *, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS place FROM u),
g AS (SELECT conv_id, coalesce(string_agg('C' || i, ',' ORDER BY i) FILTER (usable), '') AS used, coalesce(string_agg('C' || i, ',' ORDER BY i) FILTER (NOT usable), '') AS excluded, coalesce(string_agg('[C' || i || '] ' || trim(text), '|' ORDER BY i) FILTER (usable AND place <= 3 AND trim(text) <> ''), '') AS snippets FROM p GROUP BY 1),
r AS (SELECT f.conv_id, CASE WHEN g.conv_id IS NULL THEN 'no_context' WHEN used = '' THEN 'irrelevant_context' ELSE 'failed' END AS status, coalesce(used, '') AS used, coalesce(excluded, '') AS excluded, coalesce(snippets, '') AS snippets FROM f LEFT JOIN g USING (conv_id))
SELECT conv_id, status, CASE status WHEN 'no_context' THEN 'no_retrieved_context' WHEN 'failed' THEN 'synthesis_unavailable' ELSE 'no_relevant_evidence' END AS fallback_reason, used, excluded, md5(snippets) AS snippets_md5 FROM r""",
    "rewritten_questions": rf"""WITH q AS (SELECT conv_id, turn, upper(split_part(text, ' ', 1)[1]) || lower(split_part(text, ' ', 1)[2:]) || ' ' || text || ' 1999' AS question FROM conversations WHERE role = 'user'),
c AS (SELECT *, regexp_replace(question, '[^A-Za-z0-9\- ]+', ' ', 'g') AS clean FROM q),
w AS (SELECT *, list_filter(regexp_extract_all(clean, '[A-Za-z][A-Za-z\-]{{2,}}'), lambda x: lower(x) NOT IN ({_QUESTION})) AS ws, regexp_extract_all(clean, '\b((?:19|20)[0-9]{{2}})\b', 1) AS ys FROM c),
x AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS low FROM w),
e AS (SELECT *, list_filter(list_concat(CASE WHEN list_contains(low, 'the') THEN ['typology', 'lithic', 'the'] ELSE [] END, CASE WHEN list_contains(low, 'thing') THEN ['ceramic', 'wares'] ELSE [] END), lambda x: NOT list_contains(low, x)) AS extra FROM x),
p AS (SELECT *, list_filter(ws, lambda x: regexp_matches(x[1], '[A-Z]')) AS au, ws[1:4] AS ti, list_concat(ws[5:10], extra[1:12]) AS co FROM e),
d AS (SELECT *, 'authors: ' || coalesce(nullif(array_to_string(au, ' '), ''), 'none') || ' | years: ' || coalesce(nullif(array_to_string(ys, ' '), ''), 'none') || ' | title_terms: ' || coalesce(nullif(array_to_string(ti, ' '), ''), 'none') || ' | content_terms: ' || coalesce(nullif(array_to_string(co, ' '), ''), 'none') AS directive,
  list_filter(list_concat(au, ys, ti, co), lambda x: lower(x) NOT IN ('and', 'or', 'not')) AS ps FROM p),
o AS (SELECT *, list_filter(ps, lambda x, i: list_position(list_transform(ps, lambda y: lower(y)), lower(x)) = i) AS once FROM d),
s AS (SELECT *, coalesce(nullif(array_to_string(once, ' '), ''), trim(question)) AS compact_query FROM o),
k AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_ASTOP}))) AS asked,
  list_distinct(list_filter(regexp_extract_all(lower(compact_query), '[a-z0-9][a-z0-9-]+'), lambda t: length(t) >= 3 AND t NOT IN ({_ASTOP}))) AS have FROM s),
m AS (SELECT *, {" + ".join(f"CAST(len({f}) > 0 AS INTEGER)" for f in _FAM)} AS named, {" + ".join(f"CAST(len(list_intersect({f}, have)) > 0 AS INTEGER)" for f in _FAM)} AS met,
  list_filter(asked, lambda x: x IN ({_ALLFAM}) AND x NOT IN ({_GENERIC})) AS crit FROM k),
z AS (SELECT *, len(list_filter(have, lambda x: x NOT IN ({_GENERIC}))) > 0 AND met >= named AND (len(crit) = 0 OR len(list_intersect(crit, have)) >= greatest(1, least(2, len(crit)))) AND len(have) >= greatest(2, least(3, len(asked))) AS sane FROM m)
SELECT conv_id, turn, directive, compact_query, sane, md5(CASE WHEN sane THEN compact_query ELSE trim(question) END) AS search_md5 FROM z""",
    "normalized_keys": f"""WITH {t.ARTICLES}, n AS (SELECT *, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS tn, array_to_string(regexp_extract_all(strip_accents(lower(title)), '[a-z0-9]+'), ' ') AS tf FROM articles)
SELECT article_id, tn AS title_norm, CASE WHEN tf <> '' THEN tf || '|' || year END AS title_year, '10.1234/' || lower(citekey) AS doi, citekey AS stem, regexp_replace(lower(citekey), '[^a-z0-9]+', '', 'g') AS look_up FROM n""",
    "reference_chunks": f"WITH {t.ARTICLES}, {t.CHUNKS} SELECT chunk_id FROM (SELECT chunk_id, trim(lower(chunk_text)) AS t FROM chunks) WHERE {_REF}",
    "html_note_text": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<br[ /]*>|</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)),
  '&amp;?', '&', 'g'), '[ \t\xa0]+\n', chr(10), 'g'))) AS text_md5 FROM p""",
    "years_and_dois": "SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text, '(^|[^0-9A-Za-z_])((19|20)[0-9]{2})([^0-9A-Za-z_]|$)', 2) AS INTEGER), 0) AS year, regexp_replace('10.1000/' || source || ';', '[.;,]+$', '') AS doi FROM documents",
    "header_footer_strip": f"""WITH {_LINES(8, "text")},
a AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS norm, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS down FROM lines),
b AS (SELECT doc_id, norm FROM a WHERE up <= 3 OR down <= 3 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2),
m AS (SELECT a.*, NOT (regexp_matches(norm, '^(page )?[0-9]{{1,4}}$') OR regexp_matches(norm, '^[ivxlcdm]{{1,8}}$')) AND NOT (b.norm IS NOT NULL AND (up <= 3 OR down <= 3)) AS keep FROM a LEFT JOIN b USING (doc_id, norm)),
n AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY doc_id) AS kept, count(*) OVER (PARTITION BY doc_id) AS n FROM m)
SELECT doc_id, count(*) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM n WHERE keep OR kept = 0 OR kept < floor(n * 0.35) GROUP BY 1""",
    "reference_split": f"""WITH {_LINES(40, "text || chr(10) || 'References' || chr(10) || 'last'")},
h AS (SELECT *, min(line_no) FILTER (regexp_matches(lower(line), '^(references|bibliography|works cited|literature cited)[ :.]*$')) OVER (PARTITION BY doc_id) AS cut FROM lines)
SELECT doc_id, CASE WHEN line_no >= cut THEN 'references' ELSE 'main' END AS part, count(*) AS n FROM h GROUP BY ALL""",
    "citation_quality": f"""WITH {t.ARTICLES},
x AS (SELECT article_id, length(trim(title)) AS n, lower(author || ' ' || title || CASE WHEN article_id % 4 = 0 THEN ' http://x.org/' WHEN article_id % 7 = 0 THEN ' All rights reserved' ELSE '' END) AS low FROM articles),
s AS (SELECT article_id, least(1.0, greatest(0.0, CASE WHEN n BETWEEN 8 AND 260 THEN 0.5 WHEN n BETWEEN 6 AND 340 THEN 0.2 ELSE 0 END + CASE WHEN article_id % 3 <> 0 THEN 0.25 ELSE 0 END + CASE WHEN article_id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN article_id % 5 = 0 THEN 0.15 ELSE 0 END
  - CASE WHEN contains(low, 'all rights reserved') THEN 0.5 ELSE 0 END - CASE WHEN contains(low, 'http://') THEN 0.1 ELSE 0 END)) AS score FROM x)
SELECT article_id, {_M("score")} AS score, score >= 0.35 AS accepted FROM s""",
    "markdown_sections": f"""WITH {_LINES(40, "text")},
h AS (SELECT doc_id, line_no, CAST(line_no / 5 AS INTEGER) % 3 + 1 AS level FROM lines WHERE line_no % 5 = 0 AND regexp_matches(substr(line, 1, 20), '[^ ]')),
e AS (SELECT h.doc_id, h.line_no, h.level, min(n.line_no) AS nxt FROM h LEFT JOIN h n ON n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.level <= h.level GROUP BY ALL),
l AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS section, level, CAST(line_no AS INTEGER) AS start_line, CAST(coalesce(nxt - 1, last) AS INTEGER) AS end_line FROM e JOIN l USING (doc_id)""",
}
