"""Joins of two tables on shared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref
from .filters import preview

JOIN_KINDS = ("left", "right", "outer", "inner", "cross")


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | None = None,
    how: str = "inner",
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_left", "_right"),
) -> DataFrame:
    """Equi-join on columns both tables have; other shared names get the suffixes.

    Null keys match null keys unless ``null_safe`` is off. An unknown ``how`` means inner.
    The strategy is left to the optimizer and AQE. A full join is built as a left join
    plus the unmatched right rows, because AQE can split hot keys in those two but not in
    a native full join.
    """
    how = how.lower()
    how = how if how in JOIN_KINDS else "inner"
    keys = [] if how == "cross" else ([on] if isinstance(on, str) else list(on or []))
    if how != "cross" and not keys:
        raise ValueError("name at least one column to join on")
    shared = {c for c in common_columns(left, right) if c not in keys}
    left_names = {c: c + suffixes[0] if c in shared else c for c in left.columns}
    right_names = {c: c + suffixes[1] if c in shared else c for c in right.columns if c not in keys}
    l = left.select(*[ref(c).alias(n) for c, n in left_names.items()])
    r = right.select(
        *[ref(k).alias(f"__right_key_{i}") for i, k in enumerate(keys)],
        *[ref(c).alias(n) for c, n in right_names.items()],
    )
    if how == "cross":
        return l.crossJoin(r)

    def matched(a: DataFrame, b: DataFrame):
        term = None
        for i, key in enumerate(keys):
            x, y = a[f"`{key}`"], b[f"__right_key_{i}"]
            equal = x.eqNullSafe(y) if null_safe else x == y
            term = equal if term is None else term & equal
        return term

    def shaped(df: DataFrame, from_right: bool) -> DataFrame:
        columns = []
        for original, name in left_names.items():
            if from_right and original in keys:
                columns.append(ref(f"__right_key_{keys.index(original)}").alias(name))
            else:
                columns.append(ref(name))
        return df.select(*columns, *map(ref, right_names.values()))

    if how != "outer":
        return shaped(l.join(r, matched(l, r), how), how == "right")
    kept = shaped(l.join(r, matched(l, r), "left"), False)
    # One row per key: a key with many left rows must not land in one task of the anti join.
    keys_left = l.select(*map(ref, keys)).distinct()
    alone = r.join(keys_left, matched(keys_left, r), "left_anti")
    types = {f.name: f.dataType for f in l.schema.fields}
    padded = alone.select(
        *[
            (
                ref(f"__right_key_{keys.index(original)}")
                if original in keys
                else F.lit(None).cast(types[name])
            ).alias(name)
            for original, name in left_names.items()
        ],
        *map(ref, right_names.values()),
    )
    return kept.unionByName(padded)


def preview_join(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", n: int = 100,
    order_by: list[str] | None = None,
) -> DataFrame:
    return preview(join_tables(left, right, on, how), n, order_by)
