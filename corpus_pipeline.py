"""Corpus preparation in five stages; each works on all that its predecessor kept.

1. quality: a model of ``labels.quality`` scores every text; documents below 0.5 go.
2. near_duplicates: of each class of linked SimHash fingerprints one row stays, that of the smallest id. Fingerprints are
   of five-word shingles; the bits that may differ are those of a similarity of 0.8 and a little less, see ``NEAR``.
3. decontamination: documents with a benchmark passage go.
4. personal_data: identifiers become their kind in brackets; ``n_chars`` follows the text.
5. segmentation: two sampled segmentations of each text, one row for each, with their pieces' ids.

Stage 2 chooses by row: rows without a ``doc_id``, or with a repeated one, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.llm._places import placed
from quillgraph.llm.decontaminate import find_benchmark_passages
from quillgraph.llm.pii import find_personal_data, redact
from quillgraph.llm.quality import fit_documents, score
from quillgraph.llm.segmentations import sample_segmentations
from quillgraph.llm.simhash import near_duplicate_classes
from quillgraph.session import stage


#: Two texts of equal length with Jaccard similarity 0.8 of their shingles are 27 degrees apart: 9.7 of 64 and 19.4 of 128
#: bits differ on average. 11 and 23 bits leave room for chance.
NEAR = {"width": 5, "radius": 11, "parts": 2, "wide": 23}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    model = fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, out="_score").where("_score >= 0.5").drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the least id, of ties the least hash of its text, then the first place."""
    rows, _ = placed(docs)
    at = {name: F.col(f"c{i}") for i, name in enumerate(docs.columns)}
    row = F.struct(at["doc_id"].isNull().alias("unnamed"), at["doc_id"].alias("id"), F.xxhash64(at["text"]).alias("hash"), "file", "at")
    classes = near_duplicate_classes(rows.select(row.alias("row"), at["text"].alias("text")), key="row", **NEAR)
    kept = classes.where(F.col("row").eqNullSafe(F.col("component"))).select("row.file", "row.at")
    return rows.join(kept, ["file", "at"], "left_semi").select(*[c.alias(name) for name, c in at.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_benchmark_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).drop("matches")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data in them."""
    clean = redact(find_personal_data(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return sample_segmentations(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("segmentation", segmentation),
]

#: SQL can express neither the fitted model nor the sampled segmentations.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
