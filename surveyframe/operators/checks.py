"""Data-quality checks; each gives one row (check, ok, n_bad, message)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.operators import explore
from surveyframe.operators.joins import reconcile
from surveyframe.operators.reshape import missing_cells

# Thresholds of the checks.
MAX_VARIANCE_RATIO = 1.5
MAX_ZERO_PERCENT = 50
MAX_CONDITION = 30.0


def multiple_metadata(tidy: DataFrame) -> DataFrame:
    """Surveys with more than one combination of their descriptive columns."""
    columns = ["survey_id", "site", "pair", "type", "period", "date"]
    return tidy.select(*columns).distinct().groupBy("survey_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_guilds(tidy: DataFrame) -> DataFrame:
    """Rows without guild per species."""
    return tidy.where(F.col("guild").isNull()).groupBy("species").agg(F.count(F.lit(1)).alias("n"))


def invalid_counts(tidy: DataFrame, count: str = "count") -> DataFrame:
    c = F.col(count)
    return tidy.where(c.isNull() | (c < 0) | (c != F.floor(c)))


def duplicate_cells(df: DataFrame, keys: Sequence[str] = ("survey_id", "species")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def repeated_observers(surveys: DataFrame) -> DataFrame:
    return surveys.where(F.col("n_observer_rows") > F.col("n_observers"))


def verdict(bad: DataFrame, name: str, passed: str, failed: str) -> DataFrame:
    """One report row from the frame of offending rows."""
    n = F.count(F.lit(1))
    return bad.agg(
        F.lit(name).alias("check"),
        (n == 0).alias("ok"),
        n.alias("n_bad"),
        F.when(n == 0, F.lit(passed)).otherwise(F.concat(n.cast("string"), F.lit(" " + failed))).alias("message"),
    )


def check_report(
    tidy: DataFrame,
    guilds: DataFrame,
    totals: DataFrame,
    species: Sequence[str],
    cell: Sequence[str] = ("pair", "type", "period", "guild"),
    designs: DataFrame | None = None,
) -> DataFrame:
    """All row-level checks of a cleaned count table as one frame; ``designs`` (the result of
    ``design_support``) adds the check of the candidate designs."""
    surveys = tidy.select("survey_id", "n_observer_rows", "n_observers", "researchers").distinct()
    groups = explore.count_distribution(guilds, ["pair", "type", "guild"])
    differing = reconcile(tidy, guilds, ["survey_id", "guild"], "count", "count").where(
        F.col("difference").isNull() | (F.col("difference") != 0)
    )
    rows = [
        verdict(multiple_metadata(tidy), "survey_key", "each survey has one site, date and type", "surveys have several"),
        verdict(missing_guilds(tidy), "guild", "every species has a guild", "species lack a guild"),
        verdict(invalid_counts(tidy), "counts", "counts are whole and not negative", "invalid count rows"),
        verdict(duplicate_cells(tidy), "duplicates", "one row per survey and species", "duplicated cells"),
        verdict(missing_cells(tidy, ["survey_id"], "species", species), "missing_cells", "every cell is present", "cells are absent"),
        verdict(differing, "reconcile", "species sums equal guild sums", "guild sums differ"),
        verdict(repeated_observers(surveys), "observers", "no repeated observer rows", "surveys repeat an observer"),
        verdict(groups.where(F.col("variance_to_mean") > MAX_VARIANCE_RATIO), "overdispersion", "no strong overdispersion", "groups are overdispersed"),
        verdict(groups.where(F.col("zero_percent") >= MAX_ZERO_PERCENT), "zeros", "no group is half zeros", "groups are half zeros"),
        verdict(explore.extremes(totals, ["pair", "type"]), "extremes", "no extreme survey", "extreme surveys"),
        verdict(explore.weak_cells(guilds, cell), "weak_cells", "all cells have support", "weak cells"),
    ]
    if designs is not None:
        rows.append(verdict(designs.where(~F.col("acceptable")), "designs", "every design can be estimated", "designs are deficient or near it"))
    return reduce(lambda a, b: a.unionByName(b), rows)
