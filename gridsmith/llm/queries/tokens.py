"""Tokenizing and packing. The tokenizer files are found by the package that holds them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..bpe import encode_documents
from ..common import read
from ..packing import pack_documents
from .registry import query

TOKENIZER = "word_bpe_49k.json"


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
