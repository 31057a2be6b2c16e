"""Null-safe joins on equal column names and key assertions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RIGHT = "__right"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where a null key matches a null key, as grouping does.

    No broadcast hint: a local relation or a small shuffle output is broadcast on Spark's
    own size check, anything larger is shuffled and split by adaptive skew handling.
    """
    renamed = right.withColumnsRenamed({k: k + _RIGHT for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[k + _RIGHT]) for k in keys])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right"):
        both = {k: F.coalesce(F.col(k), F.col(k + _RIGHT)) for k in keys}
        joined = joined.withColumns(both)
    return joined.drop(*[k + _RIGHT for k in keys])


def attach_scalars(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Add the columns of a one-row frame to every row through a scalar subquery."""
    names = names or tuple(one_row.columns)
    value = one_row.select(F.struct(*names)).scalar()
    return df.withColumn("__scalars", value).select(
        *df.columns, *[F.col("__scalars").getField(n).alias(n) for n in names]
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged; raise when a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate lookup keys in {list(keys)}: {[tuple(r)[:-1] for r in twice]}")
    return df


def level_values(df: DataFrame, column: str, max_levels: int = 10_000) -> list:
    """Distinct non-null values of a category, sorted; raises beyond ``max_levels`` because
    a category with more values is an identifier and belongs in a frame."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "row_id") -> DataFrame:
    """Running number of each row within its (small) group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
