"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit shingle hashes of a text.
The sketch of a union is made from the sketches alone, so parts can be merged; a set of fewer
than ``k`` shingles is held whole and every estimate on it is exact. Everything here is a
column expression.

Nulls and texts without words have the empty sketch. Two empty sketches resemble each other
fully, an empty and another one not at all; the empty set is contained in every set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import with_shingles

K = 128


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Add the sketch of the column ``text`` as ``name``, an array of longs."""
    raw = f"__{name}_set"
    df = with_shingles(df, text, raw)
    return df.withColumn(name, F.slice(F.array_sort(F.col(raw)), 1, k)).drop(raw)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def _shared(union: Column, a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(union, a), b))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sides hold."""
    union = merged(a, b, k)
    size = F.size(union)
    return F.when(size == 0, F.lit(1.0)).otherwise(_shared(union, a, b) / size)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the set of ``a`` that is also in the set of ``b``."""
    union = merged(a, b, k)
    own = F.size(F.array_intersect(union, a))
    exact = F.size(a) == 0
    return F.when(exact, F.lit(1.0)).when(own == 0, F.lit(0.0)).otherwise(_shared(union, a, b) / own)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    kth = F.element_at(sketch, k).cast("double")
    share = (kth + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def as_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits per hash, in the order of the sketch."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(
    df: DataFrame, key: str, columns: dict[str, str], rows_per_bucket: int = 2000, max_buckets: int = 50_000
) -> tuple[DataFrame, Window]:
    """Lay rows out by descending ``key`` so that a window can look at the following row.

    Returns the rows with ``__bucket`` and ``__extra``, and the window. Buckets are ranges of
    the key cut at every key whose hash falls into a fixed share, so one shuffle brings
    neighbours together, whatever the keys look like. The first row of each bucket is also
    dealt to the bucket before it (and the very first one to the last), marked ``__extra``:
    drop those rows after looking. Only the cuts (``max_buckets`` or so keys) reach the
    driver. Rows with one key are ordered by ``columns``, a null key comes last.
    """
    keys = df.select(F.col(key).cast("bigint").alias("key"))
    total = keys.count()
    every = max(rows_per_bucket, total // max_buckets)
    cuts = sorted(
        r[0]
        for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).where("key IS NOT NULL").distinct().collect()
    )
    steps = max(1, len(cuts)).bit_length()
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")

        def bucket_of(column: Column) -> Column:
            # Binary search: how many cuts are at most the key.
            found = F.aggregate(
                F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
                F.lit(0),
                lambda at, step: F.when(
                    (at + step <= len(cuts)) & (F.try_element_at(bounds, F.least(at + step, F.lit(len(cuts)))) <= column),
                    at + step,
                ).otherwise(at),
            )
            return F.when(column.isNull(), F.lit(-1)).otherwise(found)
    else:

        def bucket_of(column: Column) -> Column:
            return F.when(column.isNull(), F.lit(-1)).otherwise(F.lit(0))

    heads = sorted(
        (r["bucket"], r["first"])
        for r in keys.groupBy(bucket_of(F.col("key")).alias("bucket")).agg(F.max("key").alias("first")).collect()
    )
    # The bucket with the next larger keys also gets this bucket's first row; the lowest
    # bucket closes the circle with the first row of the highest.
    extra = [(first, heads[i + 1][0] if i + 1 < len(heads) else heads[0][0]) for i, (_, first) in enumerate(heads)]
    table = df.sparkSession.createDataFrame(extra, "first bigint, other int")
    names = [c for c in columns if c != key]
    placed = df.select(F.col(key).cast("bigint").alias(key), *[F.expr(columns[c]).alias(c) for c in names])
    placed = placed.withColumn("__bucket", bucket_of(F.col(key)))
    # One row per bucket, so at most some max_buckets rows: a proven bound for the broadcast.
    placed = placed.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("extra"))
    copy = F.struct(F.col("other").alias("bucket"), F.lit(1).alias("extra"))
    placed = placed.withColumn("__to", F.explode(F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    placed = placed.select(key, *names, F.col("__to.bucket").alias("__bucket"), F.col("__to.extra").alias("__extra"))
    window = Window.partitionBy("__bucket").orderBy(
        "__extra", F.col(key).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in names]
    )
    return placed, window


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every text, and its edited text, and compare them.

    The edited text is the text with its last floor(n / 2) code points replaced by the first
    as many of the next document, by descending key; the document after the last is the first.
    A null text is empty. Rows with one key follow each other by text. An empty table gives no
    rows; other columns of ``docs`` are not read.
    """
    rows, window = with_next(docs, key, {"__text": f"coalesce(`{text}`, '')"})
    rows = rows.withColumn("__next", F.lead("__text").over(window))
    size = F.char_length("__text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumn(
        "__edited",
        F.concat(F.left(F.col("__text"), size - half), F.left(F.coalesce(F.col("__next"), F.lit("")), half)),
    ).drop("__next")
    rows = rows.withColumn("n_chars", size.cast("bigint"))
    rows = with_sketch(rows, "__text", "__own", k)
    rows = rows.withColumn("__follower", F.lead("__own").over(window)).where("__extra = 0")
    rows = with_sketch(rows, "__edited", "__changed", k)
    own, changed, follower = F.col("__own"), F.col("__changed"), F.coalesce(F.col("__follower"), F.col("__own"))
    return rows.select(
        key,
        "n_chars",
        F.sha2(F.col("__edited"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        resemblance(own, changed, k).alias("near_edited"),
        resemblance(own, follower, k).alias("near_next"),
        containment(own, changed, k).alias("contained_in_edited"),
        distinct_shingles(own, k).alias("n_shingles"),
    )
