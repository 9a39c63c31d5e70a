"""The corpus pipeline: quality, exact and near duplicates, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) over the rows that the stage before
kept; what it returns is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm.bpe import encode_documents
from splitboard.llm.common import discard, shared_dir, table
from splitboard.llm.exact_dedup import content_sort
from splitboard.llm.minhash import near_duplicates
from splitboard.llm.mixing import mix_sources
from splitboard.llm.quality import quality
from splitboard.llm.queries import QUALITY_HELD_OUT, held_out, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    Each row is judged by its text alone: null and empty texts by the score of no
    terms, repeated rows alike, and a score of just 0.3 stays.
    """
    scored = quality(docs, table(spark, sf_dir, "labels"), held_out(QUALITY_HELD_OUT))
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least identifier of each group of equal texts.

    One row of each text stays: of repeated rows one, and a row without identifier
    only if no equal text has one. Rows are found again by the digest of the text and
    a tag from the identifier, so a large group of copies is spread.
    """
    tag = F.xxhash64("doc_id").alias("_tag")
    kept = content_sort(docs).where("kept").select(F.col("text_sha256").alias("_digest"), tag)
    rows = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"), tag)
    return rows.join(kept, ["_digest", "_tag"], "left_semi").dropDuplicates(["_digest", "_tag"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles.

    Rows that share an identifier are one document; those without one stay together
    if any of them is its own component.
    """
    kept = near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Rows of one source that share an identifier, or have none, share a decision.
    """
    copies = mix_sources(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copies").distinct()
    joined = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, one row for each copy; a null or empty text has none, a null identifier stays null."""
    return encode_documents(docs, vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("tokens", encode),
]

#: Nearest neighbours and BPE are beyond SQL. Tests hold the duplicate and mixing stages against brute force, quality against labels and tokens by their lengths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's folder is deleted once the next one is written, the last one's when the
    application ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    discard(spark, before, at_exit=True)
    return docs
