"""Classifiers: quality and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import quality, toxicity
from ..common import read
from .registry import query


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, folder, "labels")))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, folder, "labels")))
