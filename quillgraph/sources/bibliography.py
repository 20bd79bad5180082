"""Readers of bibliographic catalogues: JSON exports, entity-attribute-value tables, corrections, tolerant JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillgraph.functions import text as tx

RECORD = (
    "_id string, title string, citekey string, doi string, journal string, publisher string, year string, published struct<year:string>,"
    " author array<struct<first:string,last:string,formatted:string>>, attachments array<struct<filename:string>>"
)


def _filled(*columns: Column) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + (F.coalesce(c.cast("string"), F.lit("")) != "").cast("int")
    return total


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per attachment of a JSON export (an array of records): names, authors, year and a completeness score."""
    raw = spark.read.schema(RECORD).option("multiLine", True).json(path)
    name = lambda a: F.when(F.coalesce(a["formatted"], F.lit("")) != "", a["formatted"]).otherwise(F.concat_ws(" ", a["first"], a["last"]))
    authors = F.filter(F.transform(F.coalesce("author", F.array().cast("array<struct<first:string,last:string,formatted:string>>")), lambda a: F.trim(name(a))), lambda a: a != "")
    rows = raw.select(
        F.col("_id").alias("record_id"), "title", "citekey", tx.normalize_doi(F.col("doi")).alias("doi"), "journal", "publisher",
        F.regexp_extract(F.coalesce("published.year", "year", F.lit("")), "(19|20)[0-9]{2}", 0).try_cast("int").alias("year"), authors.alias("authors"),
        F.explode_outer("attachments").alias("file"),
    )
    score = _filled(*[F.col(c) for c in ("title", "citekey", "doi", "journal", "publisher", "year", "record_id")]) + F.size("authors")
    filename = F.element_at(F.split(F.replace(F.col("file.filename"), F.lit("\\"), F.lit("/")), "/"), -1)
    return rows.withColumns({"score": score, "filename": filename, "name_key": tx.lookup_key(tx.path_stem(F.col("file.filename")))}).drop("file")


def best_by(rows: DataFrame, key: str) -> DataFrame:
    """One record per key: the most complete, of equals the one with the least record id."""
    return rows.where(F.coalesce(key, F.lit("")) != "").withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "record_id"))).where("_place = 1").drop("_place")


def read_catalogue_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Attachments of a catalogue kept as entity-attribute-value tables, with their parents' fields and creators.

    ``tables``: items(itemID, key), itemAttachments(itemID, parentItemID, path, contentType), itemData(itemID, fieldID, valueID),
    fields(fieldID, fieldName), itemDataValues(valueID, value), itemCreators(itemID, creatorID, orderIndex), creators(creatorID,
    firstName, lastName). Only PDF attachments with a parent are kept: a path's ending beats the content type.
    """
    a = tables["itemAttachments"]
    path, kind = F.lower(F.coalesce("path", F.lit(""))), F.lower(F.coalesce("contentType", F.lit("")))
    pdf = path.endswith(".pdf") | (~path.rlike("\\.[a-z0-9]{1,5}$") & (kind == "application/pdf"))
    attached = a.where(pdf & F.col("parentItemID").isNotNull()).select("itemID", "parentItemID", "path")
    values = tables["itemData"].join(tables["fields"], "fieldID").join(tables["itemDataValues"], "valueID")
    named = ("title", "DOI", "date", "publicationTitle", "publisher")
    fields = values.groupBy(F.col("itemID").alias("parentItemID")).agg(*[F.max(F.when(F.col("fieldName") == n, F.col("value"))).alias(n) for n in named])
    people = tables["itemCreators"].join(tables["creators"], "creatorID")
    name = F.trim(F.concat_ws(" ", "firstName", "lastName"))
    creators = people.groupBy(F.col("itemID").alias("parentItemID")).agg(F.transform(F.array_sort(F.collect_list(F.struct("orderIndex", name.alias("n")))), lambda x: x["n"]).alias("authors"))
    keys = tables["items"].select("itemID", F.col("key").alias("attachment_key"))
    parents = tables["items"].select(F.col("itemID").alias("parentItemID"), F.col("key").alias("parent_key"))
    out = attached.join(keys, "itemID").join(parents, "parentItemID", "left").join(fields, "parentItemID", "left").join(creators, "parentItemID", "left")
    return out.select(
        F.concat(F.lit("1:"), "parent_key").alias("persistent_id"), "attachment_key", "parent_key", "path", "title", tx.normalize_doi(F.col("DOI")).alias("doi"),
        tx.first_year(F.col("date")).alias("year"), F.col("publicationTitle").alias("journal"), "publisher", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines and lines that are no JSON are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_corrections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corrections, invalid, conflicts) of a CSV of reference_key, valid and citekey, whatever the header's case.

    ``valid`` F marks a reference to be removed. A key with several citekeys is a conflict and no correction.
    """
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    field = lambda n: F.trim(F.col(f"`{by[n]}`")) if n in by else F.lit(None).cast("string")
    rows = raw.select(F.lower(field("reference_key")).alias("reference_key"), F.upper(field("valid")).alias("valid"), field("citekey").alias("citekey")).where("reference_key <> ''")
    invalid = rows.where("valid = 'F'").select("reference_key").distinct()
    keyed = rows.where("coalesce(valid, '') <> 'F' and citekey <> ''").groupBy("reference_key").agg(F.count_distinct(F.lower("citekey")).alias("n"), F.min("citekey").alias("citekey"))
    return keyed.where("n = 1").drop("n"), invalid, keyed.where("n > 1").select("reference_key")
