"""Counts with implicit zeros: a frame of surveys and the counts that were seen, never their product.

A model of zero-filled counts needs, per cell and covariate value, the number of zeros: the surveys of the cell less
those with a count. Both are grouped counts, so the zero rows come as weights and the survey × category grid is never made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.models import families
from surveyframe.operators.keys import join_on


def weighted_counts(
    observed: DataFrame, surveys: DataFrame, of_survey: Sequence[str], of_category: Sequence[str], y: str, x: str | None = None,
    categories: DataFrame | None = None,
) -> DataFrame:
    """(of_survey, of_category, x, y, n): counts with the number of survey × category pairs that have them.

    ``observed`` has one row per survey and category seen, ``surveys`` one per survey, both with the columns
    ``of_survey`` and ``x``. Rows of ``observed`` without a count, or with zero, are zeros like those that are not there.
    ``categories`` lists the category combinations (with any of the ``of_survey`` columns as extra keys to restrict
    them); without it they are those with a count somewhere in the cell, so all-zero cells do not appear.
    """
    keys = [*of_survey, *of_category]
    x_col = F.col(x).cast("double") if x else F.lit(0.0)
    seen = observed.where(F.col(y) > 0).groupBy(*keys, x_col.alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    every = surveys.where(x_col.isNotNull()).groupBy(*of_survey, x_col.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n_surveys"))
    if categories is None:
        cells = seen.select(*keys).distinct()
    else:
        missing = [k for k in of_survey if k not in categories.columns]
        if missing:
            # Cells of the surveys carry the list of categories: at most cells x categories rows come of it.
            shared = [k for k in of_survey if k in categories.columns]
            lists = categories.select(*shared, *of_category).distinct().groupBy(*shared).agg(F.collect_set(F.struct(*of_category)).alias("__all"))
            at = every.select(*of_survey).distinct()
            at = join_on(at, lists, shared) if shared else at.withColumn("__all", lists.select("__all").scalar())
            cells = at.select(*of_survey, F.explode("__all").alias("__c")).select(*of_survey, "__c.*")
        else:
            cells = categories.select(*keys).distinct()
    counted = seen.groupBy(*keys, "x").agg(F.sum("n").alias("n_seen"))
    grid = join_on(cells, every, list(of_survey))
    zeros = join_on(grid, counted, [*keys, "x"], "left")
    zeros = zeros.select(*keys, "x", F.lit(0.0).alias("y"), (F.col("n_surveys") - F.coalesce("n_seen", F.lit(0.0))).alias("n"))
    return seen.unionByName(zeros.where(F.col("n") > 0))


def weighted_checks(rows: DataFrame, family: str, by: Sequence[str], n_par: int) -> DataFrame:
    """Pearson dispersion and zero test of weighted rows (mu, phi, y, n), per group of ``by``."""
    mu, phi, y, n = F.col("mu"), F.col("phi"), F.col("y"), F.col("n")
    p0 = families.zero_probability(family, mu, phi)
    out = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(n * F.pow(y - mu, 2) / families.variance(family, mu, phi)).alias("chisq"),
        F.sum(F.when(y == 0, n).otherwise(0.0)).alias("zeros"), F.sum(n * p0).alias("expected_zeros"), F.sum(n * p0 * (1 - p0)).alias("__v"),
    )
    z = F.try_divide(F.col("zeros") - F.col("expected_zeros"), F.sqrt("__v"))
    return out.withColumns({"dispersion": F.try_divide("chisq", F.col("n") - n_par), "zero_z": z}).drop("__v")
