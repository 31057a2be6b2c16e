"""Ranks and quantiles of unbounded groups without one task per group.

Equal values are counted first. The counted values are range-partitioned by group and value,
with bounds Spark samples from the data, and each value keeps the number of its range. Range
totals give the number of smaller values, and only the inside of a range is sorted: a group
holding most of the data is spread over many ranges of even size, wherever its values lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.operators.keys import join_on
from surveyframe.session import stored


def in_ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` stored with the number of the range that holds (keys, value) as ``__bucket``.

    Ranges are ordered by key, then value. The number is stored because it belongs to this
    partitioning; the stored table is what all later steps read.
    """
    placed = df.repartitionByRange(*[F.col(k) for k in keys], F.col(value))
    return stored(placed.withColumn("__bucket", F.spark_partition_id()))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per key and distinct value with its number of rows and range."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    kept = df.where(F.col(value).isNotNull())
    if weight:
        kept = kept.where(F.col(weight) > 0)
    counts = kept.groupBy(*keys, value).agg(n.cast("bigint").alias("__n"))
    return in_ranges(counts, keys, value)


def bucket_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before each range and rows in the whole group. The windows hold one row per group
    and range: without keys, as many rows as there are partitions."""
    totals = counts.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__in_bucket"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.withColumns(
        {
            "__before": F.sum("__in_bucket").over(running) - F.col("__in_bucket"),
            "__total": F.sum("__in_bucket").over(group),
        }
    )


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, n_before, total, __bucket): how many rows of the group are smaller."""
    keys = list(keys)
    counts = value_counts(df, keys, value, weight)
    placed = join_on(counts, bucket_offsets(counts, keys), keys + ["__bucket"])
    inside = (
        Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.col("__before") + F.sum("__n").over(inside) - F.col("__n")
    return placed.select(
        *keys, value, F.col("__n").alias("n"), before.alias("n_before"), F.col("__total").alias("total"), "__bucket"
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for any group size.

    Only the ranges that contain a wanted rank are sorted.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value, weight)
    offsets = bucket_offsets(counts, keys)
    position = {name: (F.col("__total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = lambda rank, start, end: (rank >= start) & (rank < end)
    hit = F.lit(False)
    for at in position.values():
        for rank in (F.floor(at), F.ceil(at)):
            hit = hit | wanted(rank, F.col("__before"), F.col("__before") + F.col("__in_bucket"))
    placed = join_on(counts, offsets.where(hit), keys + ["__bucket"])
    inside = (
        Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = placed.withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
    start, end = F.col("__end") - F.col("__n"), F.col("__end")
    ends = []
    for name, at in position.items():
        ends.append(F.max(F.when(wanted(F.floor(at), start, end), F.col(value))).alias(f"__lo_{name}"))
        ends.append(F.max(F.when(wanted(F.ceil(at), start, end), F.col(value))).alias(f"__hi_{name}"))
    picked = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), *ends)
    low = lambda name: F.col(f"__lo_{name}").cast("double")
    step = lambda name: F.col(f"__hi_{name}").cast("double") - low(name)
    quantile = lambda name, at: low(name) + (at - F.floor(at)) * step(name)
    return picked.select(*keys, *[quantile(name, at).alias(name) for name, at in position.items()])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, rank): mid-rank of each distinct value."""
    ranks = ranked_values(df, keys, value, weight)
    return ranks.select(*keys, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Largest ``value`` among rows of the group ordered at or before this one, where
    ``order`` is a value column with distinct entries per group, in the ranges of
    ``ranked_values`` if ``df`` still has them."""
    keys = list(keys)
    placed = df if "__bucket" in df.columns else in_ranges(df, keys, order)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(*keys, "__bucket").agg(F.max(value).alias("__top"))
    tops = tops.withColumn("__earlier", F.max("__top").over(earlier)).drop("__top")
    inside = (
        Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = join_on(placed, tops, keys + ["__bucket"])
    here = F.max(value).over(inside)
    return joined.withColumn(out, F.greatest(here, F.coalesce(F.col("__earlier"), here))).drop("__bucket", "__earlier")
