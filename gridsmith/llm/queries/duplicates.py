"""Near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import read
from ..hamming import near_vectors
from ..jaccard import similar_documents
from .registry import query


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(read(spark, folder, "documents"))


@query("op1_embedding_near_dedup")
def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read(spark, folder, "embeddings"))
