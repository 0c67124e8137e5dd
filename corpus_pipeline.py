"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, and returns the columns of ``documents``; the
last returns the pieces of the packed sequences. ``run`` writes every stage below the shared
checkpoint folder and reads it again, so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsmith.llm import jaccard, packing, pii, quality, toxicity
from gridsmith.llm.common import with_maybe
from gridsmith.session import cut_lineage

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the additive quality model accepts."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, _labels(spark, sf_dir)))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the factorization machine does not find toxic."""
    return toxicity.keep_civil(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of similar documents the one with the smallest id.

    Documents without words have no group and stay; rows with one id are one document and stay
    or go together; rows without an id stay.
    """
    gone = cut_lineage(jaccard.similar_documents(docs).where("component_id <> doc_id").select("doc_id").distinct())
    # Texts that surely stay are not shuffled.
    known = with_maybe(docs.select(*COLUMNS), "doc_id", gone)
    stay = known.where("maybe").join(gone, "doc_id", "left_anti").unionByName(known.where("NOT maybe"))
    return stay.select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every document, with the personal data in it replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", keep_one_of_each),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

# The stages learn, follow links and search packings: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
