"""Corrections of a stored library: metadata, stubs, deleted and re-pointed references, moved edges. New tables come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions import names as n, text as tx


def _given(c: Column) -> Column:
    """A value, or null where it is blank."""
    return F.when(F.trim(c.cast("string")) != "", c)


def refresh_metadata(articles: DataFrame, updates: DataFrame, key: str = "article_id") -> DataFrame:
    """``articles`` with each value that ``updates`` has and that isn't null; one update a key."""
    shared = [c for c in updates.columns if c != key and c in articles.columns]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in shared])
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c) for c in articles.columns]
    return articles.join(new, key, "left").select(*kept)


def reconcile_update(articles: DataFrame, rows: DataFrame, source: str, key: str = "article_id") -> DataFrame:
    """Identity keys of matched articles: the persistent id is taken over, item and attachment keys only where they aren't
    blank, with their lower-case forms; ``metadata_source`` is set where it was blank. One row a key in ``rows``:
    key, persistent_id, item_key, attachment_key."""
    new = rows.select(key, F.col("persistent_id").alias("_p"), _given(F.col("item_key")).alias("_i"), _given(F.col("attachment_key")).alias("_a"), F.lit(True).alias("_hit"))
    joined = articles.join(new, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {
        "persistent_id": F.when(hit, F.col("_p")).otherwise(F.col("persistent_id")),
        "item_key": F.coalesce("_i", "item_key"),
        "item_key_norm": F.coalesce(F.lower("_i"), "item_key_norm"),
        "attachment_key": F.coalesce("_a", "attachment_key"),
        "attachment_key_norm": F.coalesce(F.lower("_a"), "attachment_key_norm"),
        "metadata_source": F.when(hit & _given(F.col("metadata_source")).isNull(), F.lit(source)).otherwise(F.col("metadata_source")),
    }
    return joined.withColumns(out).select(*articles.columns)


def ensure_stubs(articles: DataFrame, wanted: DataFrame, prefix: str = "catalogue") -> DataFrame:
    """``articles`` with an article for each wanted record (citekey, external_id and any metadata columns).

    Its id is made of the external id, or of the citekey's slug. One that is there keeps citekey, external id and source path
    where it has them; given metadata replaces its own. Several records of one id count as the one of the least citekey.
    """
    outside = _given(F.trim("external_id"))
    ident = F.coalesce(F.concat(F.lit(f"{prefix}::"), outside), F.concat(F.lit(f"{prefix}-citekey::"), n.slug(F.col("citekey"))))
    path = F.coalesce(F.concat(F.lit(f"{prefix}://"), outside), F.concat(F.lit(f"{prefix}-citekey://"), F.col("citekey")))
    rest = [c for c in wanted.columns if c not in ("citekey", "external_id")]
    rows = wanted.select(ident.alias("article_id"), "citekey", outside.alias("external_id"), path.alias("source_path"), *[_given(F.col(c)).alias(c) for c in rest])
    one = rows.groupBy("article_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "article_id"]), "citekey").alias("r")).select("article_id", "r.*")
    known = ("citekey", "external_id", "source_path")
    joined = articles.join(one.select("article_id", *[F.col(c).alias(f"_new_{c}") for c in (*known, *rest)]), "article_id", "full")
    out = []
    for c in articles.columns:
        if c in known:
            out.append(F.coalesce(c, f"_new_{c}").alias(c))
        else:
            out.append(F.coalesce(f"_new_{c}", c).alias(c) if c in rest else F.col(c))
    return joined.select(*out)


def delete_references(references: DataFrame, keys: DataFrame, key: str = "ref_key") -> DataFrame:
    """References whose key isn't to be deleted."""
    return references.join(keys.select(key).distinct(), key, "left_anti").select(*references.columns)


def repoint_references(references: DataFrame, resolves: DataFrame, cites: DataFrame, orders: DataFrame, articles: DataFrame, method: str = "manual_correction_citekey") -> tuple[DataFrame, DataFrame]:
    """(resolves, cites) after every reference with an ordered key points to the article of the ordered citekey.

    ``references``: reference_id, article_id, ref_key; ``resolves``: reference_id, target_id; ``cites``: src, dst, method, score;
    ``orders``: ref_key, citekey; ``articles``: article_id, citekey. Citekeys meet whatever their case, of several articles the
    least; orders without an article change nothing. Edges that are there become manual ones with score 1.
    """
    known = articles.where("citekey is not null").groupBy(F.lower("citekey").alias("_k")).agg(F.min("article_id").alias("target_id"))
    aims = orders.select("ref_key", F.lower("citekey").alias("_k")).join(known, "_k").groupBy("ref_key").agg(F.min("target_id").alias("target_id"))
    moved = references.join(aims, "ref_key").select("reference_id", F.col("article_id").alias("src"), "target_id")
    now = resolves.join(moved.select("reference_id").distinct(), "reference_id", "left_anti").select("reference_id", "target_id")
    edges = moved.select("src", F.col("target_id").alias("dst")).distinct()
    manual = edges.select("src", "dst", F.lit(method).alias("method"), F.lit(1.0).alias("score"))
    kept = cites.join(edges, ["src", "dst"], "left_anti").select("src", "dst", "method", "score")
    return now.unionByName(moved.select("reference_id", "target_id").distinct()), kept.unionByName(manual)


def move_edges(edges: DataFrame, mapping: DataFrame, *ends: str) -> DataFrame:
    """``edges`` with ``mapping(old, new)`` applied to the named columns, each row once; self links stay."""
    out = edges
    for i, end in enumerate(ends):
        out = out.join(mapping.select(F.col("old").alias(end), F.col("new").alias(f"_new{i}")), end, "left").withColumn(end, F.coalesce(f"_new{i}", end)).drop(f"_new{i}")
    return out.select(*edges.columns).distinct()


def merge_preview(edges: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """A dry run: (new, sources, edges) for each key that others would be merged into."""
    return edges.join(mapping.select(F.col("old").alias(key), "new"), key).groupBy("new").agg(F.count_distinct(key).alias("sources"), F.count("*").alias("edges"))


def canonical_choice(articles: DataFrame, group: str) -> DataFrame:
    """The article to keep of each group: ten ranks in order, then the least id.

    With a persistent id, with an item key, not missing, with a citekey, with a DOI, from managed storage, more chunks, more
    references, more citations either way, a shorter id. Columns: article_id, persistent_id, item_key, missing, citekey, doi,
    source_path, storage_mark (what a managed path holds), chunk_count, reference_count, cite_count.
    """
    from quillgraph.operators.graph import canonical_pick

    has = lambda c: F.desc(_given(F.col(c)).isNotNull())
    stored = F.lower(F.replace(F.coalesce("source_path", F.lit("")), F.lit("\\"), F.lit("/"))).contains(F.col("storage_mark"))
    order = (
        has("persistent_id"), has("item_key"), F.asc(F.coalesce("missing", F.lit(False))), has("citekey"), F.desc(tx.normalize_doi(F.col("doi")).isNotNull()),
        F.desc(stored), F.desc("chunk_count"), F.desc("reference_count"), F.desc("cite_count"), F.asc(F.length(F.col("article_id").cast("string"))), F.asc("article_id"),
    )
    return canonical_pick(articles, group, *order)
