"""Fingerprints, personal data and licenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import read
from ..fingerprints import fingerprint_documents
from ..licenses import scan_licenses
from ..pii import find_personal_data
from .registry import query


@query("op10_document_fingerprints")
def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(read(spark, folder, "documents"))


@query("op8_pii")
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(read(spark, folder, "documents"))


@query("op4_license_scans")
def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: their source and language are their directories."""
    docs = read(spark, folder, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan_licenses(files, keep_text=False)
