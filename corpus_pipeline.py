"""A corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go,
personal data is replaced by its kind, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import decontaminate, jaccard, pieces, pii, toxicity
from shardloom.llm.graph import written

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay.  The model learns from `labels` of the given folder (ids outside the held-out fold); null and
    empty texts, null ids and repeated rows are scored like any other row.  No labels or no documents: nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (80 % of their five-word shingles in common) the one with the smallest doc_id stays.

    Rows of one id stay or go together; texts without words are linked with nothing; rows without an id stay."""
    return jaccard.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of `benchmark` stay: no 13 words (or 80 % of a shorter item) of which 80 % are equal.

    Null and empty texts stay; rows that repeat each other stay or go together; no items: nothing goes."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets, and n_chars follows the text; no row goes, and a null text stays null."""
    clean = pii.redact(docs, pii.train())
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows doc_id, part, ids, row: the pieces of every document, giant ones in several parts; `row` tells giant texts of one id apart.

    A null or empty text is one row without ids."""
    return pieces.encode(docs, pieces.load(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("pieces", encode),
]

#: The stages learn models and find components; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
