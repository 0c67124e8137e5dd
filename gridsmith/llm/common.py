"""Words, shingles, held-out folds and exact-copy groups shared by the operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

SHINGLE = 5
# Bits that tell which keys are surely not in a table, half a million words at most.
BITS = 1 << 25
SPACES = "[\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased words between ASCII blanks; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, name: str, size: int = SHINGLE) -> DataFrame:
    """Add ``name``: the distinct 64-bit hashes of the shingles of ``text``.

    A text of fewer than ``size`` words has one shingle, the whole sequence; without words none.
    """
    hashes = f"__{name}_words"
    df = df.withColumn(hashes, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    h = F.col(hashes)
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))
    value = (
        F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < size, F.array(F.xxhash64(h)))
        .otherwise(F.array_distinct(runs))
    )
    return df.withColumn(name, value).drop(hashes)


def fold(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, docs: DataFrame, key: str, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most some ``rows`` (key, label, weight) of each class, outside the held-out fold.

    Only labels of rows that ``docs`` holds are counted and thinned, so a stage whose predecessor
    rejected many labelled rows learns from the others.

    A documented bound for fitting a classifier: a class with more rows is thinned by a hash of
    the key, and ``weight`` says how many labelled rows each stands for. Rows with a null key, a
    null label or a label other than 0 and 1 are not learnt from; repeated rows count once.
    """
    usable = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where("key IS NOT NULL AND label IN (0, 1)")
        .where(fold(F.col("key"), folds) != held_out)
        .distinct()
    )
    usable = cut_lineage(usable.join(docs.select(F.col(key).alias("key")), "key", "left_semi"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    every = {value: max(1, -(-n // rows)) for value, n in counts.items()}
    step = F.when(F.col("label") == 1, every.get(1, 1)).otherwise(every.get(0, 1))
    return usable.where(F.pmod(F.xxhash64("key", F.lit(17)), step) == 0).withColumn("weight", step.cast("double"))


def with_maybe(df: DataFrame, key: str, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """Add ``name``: false where the whole number ``key`` is surely none of ``keys[key]``, a written table.

    A bit per hash of a key, 16 to 32 bits a key and ``BITS`` at most; beyond, more rows may be
    one. The words that hold bits are joined by broadcast, so no row of ``df`` is shuffled.
    """
    size = max(1 << 10, min(BITS, 1 << (16 * keys.count()).bit_length()))
    place = F.xxhash64(F.col(key).cast("bigint"), F.lit(29)).bitwiseAND(F.lit(size - 1).cast("bigint"))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    bits = cut_lineage(keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    held = df.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return held.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).select(*df.columns, name)


def release_memory() -> None:
    """Give freed memory back to the system: a worker process outlives its task, and the next one may be the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass
