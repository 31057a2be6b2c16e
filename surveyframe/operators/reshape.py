"""Wide/long reshaping and completion with explicit zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.operators.keys import join_on


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per listed column that exists; null cells are kept."""
    present = [c for c in columns if c in df.columns]
    return df.unpivot(list(ids), present, name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    levels: Sequence,
    value: Column,
    fill: float | int | None = 0,
) -> DataFrame:
    """One column per listed level; the level list is explicit, so no extra job runs."""
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(value)
    return wide if fill is None else wide.fillna(fill, subset=[str(v) for v in levels])


def to_wide_many(
    df: DataFrame, ids: Sequence[str], name: str, levels: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Several value columns at once, named ``value_level``."""
    cells = [
        F.max(F.when(F.col(name) == level, F.col(v))).alias(f"{v}_{level}") for v in values for level in levels
    ]
    return df.groupBy(*ids).agg(*cells)


def complete(
    cells: DataFrame,
    ids: Sequence[str],
    levels: Sequence[str | tuple],
    category: Sequence[str],
    value: str,
    frame: DataFrame | None = None,
    fill: int = 0,
) -> DataFrame:
    """Every id × level combination, the value where observed and ``fill`` elsewhere.

    ``cells`` holds one row per id and category. The observed cells of an id are gathered
    in a map (never larger than ``levels``) and the level list is exploded against it, so
    no row is paired with another. Ids come from ``frame``, or from ``cells`` when it is
    not given; the second choice has no row for an id without any observation.
    """
    category = list(category)
    rows = [v if isinstance(v, tuple) else (v,) for v in levels]
    key = F.struct(*[F.col(c) for c in category])
    observed = cells.groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct(key.alias("key"), F.col(value).alias("value")))).alias("__seen")
    )
    if frame is not None:
        observed = join_on(frame.select(*ids).distinct(), observed, list(ids), "left")
    options = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(category, row)]) for row in rows])
    grid = observed.withColumn("__level", F.explode(options))
    seen = F.try_element_at(F.col("__seen"), F.col("__level"))
    return grid.select(
        *ids,
        *[F.col("__level").getField(c).alias(c) for c in category],
        F.coalesce(seen, F.lit(fill)).alias(value),
    )


def missing_cells(df: DataFrame, ids: Sequence[str], category: str, levels: Sequence[str]) -> DataFrame:
    """Id × level combinations with no row: one aggregation per id, nothing else emitted."""
    seen = df.groupBy(*ids).agg(F.collect_set(category).alias("__seen"))
    absent = F.array_except(F.array(*[F.lit(v) for v in levels]), F.col("__seen"))
    return seen.select(*ids, F.explode(absent).alias(category))
