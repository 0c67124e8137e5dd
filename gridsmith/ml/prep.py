"""Feature preparation and train/test splits."""

from __future__ import annotations

import math

from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.base import Estimator, Transformer
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import ref
from ..functions.ordered import mode_table, quantile_table
from ..functions.sampling import HASH_BITS, row_hash
from ..session import attach

# Share of rows held back and the seed.
TEST_SIZE = 0.2
SEED = 42

_CELL_BITS = 36  # 2**16 hash cells per label


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def make_preprocessor(
    df: DataFrame, numeric: list[str], categorical: list[str] | None = None, output: str = "features"
) -> list[Estimator | Transformer]:
    """Stages of an ML pipeline: median impute and standardise numbers, fill and one-hot labels.

    Missing values become the exact median or the most frequent label, both taken when the
    stages are made; labels met later for the first time give zeros. Helper columns start with ``__``.
    """
    categorical = categorical or []
    if not numeric and not categorical:
        raise ValueError("no feature columns")
    casts = []
    medians = quantile_table(df, numeric, [0.5]).first() if numeric else {}
    for column in numeric:
        middle = medians[column][0] if medians[column] is not None and medians[column][0] is not None else 0.0
        value = f"nanvl(CAST({_quoted(column)} AS DOUBLE), CAST(NULL AS DOUBLE))"
        casts.append(f"coalesce({value}, CAST('{middle!r}' AS DOUBLE)) AS {_quoted('__num_' + column)}")
    for column in categorical:
        best = mode_table(df.select(ref(column).cast("string").alias(column)), column).first()
        label = (best["mode"] if best and best["mode"] is not None else "").replace("\\", "\\\\").replace("'", "\\'")
        casts.append(f"coalesce(CAST({_quoted(column)} AS STRING), '{label}') AS {_quoted('__cat_' + column)}")
    stages: list[Estimator | Transformer] = [SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")]
    parts = []
    if numeric:
        filled = [f"__num_{c}" for c in numeric]
        stages += [
            VectorAssembler(inputCols=filled, outputCol="__numbers"),
            StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        ]
        parts.append("__scaled")
    if categorical:
        filled = [f"__cat_{c}" for c in categorical]
        index = [f"__idx_{c}" for c in categorical]
        hot = [f"__hot_{c}" for c in categorical]
        stages += [
            StringIndexer(inputCols=filled, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            # The last index is the one for unknown labels; dropping it leaves zeros for them.
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return stages


def split(
    df: DataFrame, keys: list[str], test: float = TEST_SIZE, seed: int = SEED, stratify: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key columns: the same rows whatever the partitioning."""
    marked = with_test_flag(df, keys, test, seed, stratify)
    return marked.where(~F.col("__is_test")).drop("__is_test"), marked.where("__is_test").drop("__is_test")


def with_test_flag(
    df: DataFrame, keys: list[str], test: float = TEST_SIZE, seed: int = SEED, stratify: str | None = None
) -> DataFrame:
    """Add ``__is_test``. With ``stratify`` each label gives exactly ceil(test · n) rows.

    The stratified cut is a hash value per label. It is found by counting hash cells, then
    ranking only the rows of the one cell that holds it, so that a label with most of the
    rows is not ranked in one task.
    """
    if not 0 < test < 1:
        raise ValueError("the test share lies between 0 and 1")
    hashed = df.withColumn("__hash", row_hash(keys, seed))
    if stratify is None:
        limit = int(math.floor(test * 2**HASH_BITS))
        return hashed.withColumn("__is_test", F.col("__hash") < limit).drop("__hash")
    narrow = hashed.select(ref(stratify).alias("__label"), "__hash")
    narrow = narrow.withColumn("__cell", F.expr(f"shiftright(__hash, {_CELL_BITS})"))
    cells = narrow.groupBy("__label", "__cell").agg(F.count("*").alias("n"))
    label = W.partitionBy("__label")
    cells = cells.withColumn("upto", F.sum("n").over(label.orderBy("__cell").rowsBetween(W.unboundedPreceding, 0)))
    cells = cells.withColumn("want", F.ceil(F.lit(test) * F.sum("n").over(label)))
    cut = cells.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    cut = cut.select("__label", "__cell", (F.col("want") - F.col("upto") + F.col("n")).alias("rank"))
    inside = attach(narrow, cut, ["__label", "__cell"], "inner")
    ranked = inside.withColumn("at", F.row_number().over(W.partitionBy("__label", "__cell").orderBy("__hash")))
    limits = ranked.where("at = rank").select(F.col("__label").alias(stratify), F.col("__hash").alias("__limit"))
    joined = attach(hashed, limits, [stratify])
    return joined.withColumn("__is_test", F.col("__hash") <= F.col("__limit")).drop("__hash", "__limit")
