"""Lookup joins with rejects, reconciliation, nearest dates and time-ordered hold-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.operators.keys import assert_unique, join_on


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], check: bool = True) -> DataFrame:
    """Left join to a lookup whose key is unique."""
    if check:
        assert_unique(lookup, on)
    return df.join(lookup, list(on), "left")


def matched(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the lookup, with its columns."""
    return df.join(lookup, list(on), "inner")


def rejected(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows ``matched`` leaves out."""
    return df.join(lookup, list(on), "left_anti")


def reconcile(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: str, total: str) -> DataFrame:
    """Sum of parts beside the stated total; a side without a partner has no difference."""
    sums = parts.groupBy(*keys).agg(F.sum(part).alias("part_sum"))
    stated = totals.select(*keys, F.col(total).alias("stated_total"))
    both = join_on(sums, stated, list(keys), "full")
    return both.withColumn("difference", F.col("part_sum") - F.col("stated_total"))


def nearest_gaps(df: DataFrame, group: Sequence[str], kind: str, date: str, kinds: tuple[str, str]) -> DataFrame:
    """Per distinct (group, kind, date): days to the nearest date of the other of two kinds.

    Works on distinct dates, so the ordered window holds at most one row per calendar day
    whatever the number of surveys behind it. ``n`` counts those surveys. A group with a
    single kind returns nothing.
    """
    group = list(group)
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    count = lambda k: F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).cast("bigint")
    days = df.where(F.col(date).isNotNull() & F.col(kind).isin(*kinds)).groupBy(*group, date).agg(
        *[count(k).alias(f"__n{i}") for i, k in enumerate(kinds)]
    )
    days = days.withColumn("__day", day)
    ordered = Window.partitionBy(*group).orderBy("__day")
    back = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = lambda i: F.when(F.col(f"__n{i}") > 0, F.col("__day"))
    days = days.withColumns(
        {f"__{side}{i}": f(seen(i)).over(w) for i in (0, 1) for side, f, w in (("back", F.max, back), ("ahead", F.min, ahead))}
    )
    gap = lambda i: F.least(F.col("__day") - F.col(f"__back{i}"), F.col(f"__ahead{i}") - F.col("__day"))
    sides = F.array(
        *[
            F.struct(F.lit(k).alias("focal_type"), gap(1 - i).alias("nearest_gap_days"), F.col(f"__n{i}").alias("n"))
            for i, k in enumerate(kinds)
        ]
    )
    focal = days.select(*group, F.col(date).alias("focal_date"), F.inline(sides))
    return focal.where((F.col("n") > 0) & F.col("nearest_gap_days").isNotNull())


def nearest_dates(df: DataFrame, group: Sequence[str], kind: str, date: str, kinds: tuple[str, str]) -> DataFrame:
    """One row per survey with the days to the nearest date of the other kind."""
    gaps = nearest_gaps(df, group, kind, date, kinds).drop("n")
    focal = df.select(*group, F.col(kind).alias("focal_type"), F.col(date).alias("focal_date"))
    return join_on(focal, gaps, [*group, "focal_type", "focal_date"])


def match_summary(gaps: DataFrame, group: Sequence[str], within: Mapping[str, int]) -> DataFrame:
    """Summary of ``nearest_gaps``, weighted by the surveys behind each date."""
    from surveyframe.operators.ordering import exact_quantiles

    keys = [*group, "focal_type"]
    share = lambda days: F.sum(F.when(F.col("nearest_gap_days") <= days, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")
    basic = gaps.groupBy(*keys).agg(
        F.sum("n").alias("n_dates"),
        F.max("nearest_gap_days").cast("bigint").alias("maximum_nearest_gap_days"),
        *[share(days).alias(name) for name, days in within.items()],
    )
    median = exact_quantiles(gaps, keys, "nearest_gap_days", {"median_nearest_gap_days": 0.5}, weight="n")
    return join_on(basic, median, keys)


def time_holdout(df: DataFrame, site: str, date: str, survey: str, share: float = 0.8) -> DataFrame:
    """Distinct surveys with ``test`` = among the last part of their site in time order.

    Dates are counted first; a calendar bounds the ordered window per site. Only surveys of
    the one date where the split falls are numbered, by survey key.
    """
    surveys = df.select(site, survey, date).distinct()
    days = surveys.groupBy(site, date).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(site)
    running = whole.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.withColumns({"__upto": F.sum("__n").over(running), "__all": F.sum("__n").over(whole)})
    days = days.withColumn("__cut", F.floor(F.lit(share) * F.col("__all")))
    placed = join_on(surveys, days, [site, date])
    before = F.col("__upto") - F.col("__n")
    split_here = (before < F.col("__cut")) & (F.col("__upto") > F.col("__cut"))
    plain = placed.where(~split_here).withColumn("test", before >= F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(site, date).orderBy(survey))
    tied = placed.where(split_here).withColumn("test", before + rank > F.col("__cut"))
    return plain.unionByName(tied).select(site, survey, date, "test")


def split_by_key(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not listed, rows whose key is listed)."""
    return df.join(keys, list(on), "left_anti"), df.join(keys, list(on), "left_semi")


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Row with the smallest order values per group, as a mergeable minimum; null orders last."""
    ranked = [e for c in order for e in (F.col(c).isNull().alias(f"__no_{c}"), F.col(c))]
    row = F.min(F.struct(*ranked, *[c for c in keep if c not in order])).alias("__row")
    return df.groupBy(*group).agg(row).select(*group, *[F.col("__row").getField(c).alias(c) for c in keep])


def linear_map(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the line through the distinct (x, y) pairs."""
    pairs = df.select(x, y).distinct()
    return pairs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def date_grid(df: DataFrame, group: Sequence[str], date: str, n: int) -> DataFrame:
    """``n`` evenly spaced points from first to last date of each group.

    ``day`` counts (fractional) days since 1970-01-01.
    """
    day: Column = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    ends = df.groupBy(*group).agg(F.min(day).alias("__first"), F.max(day).alias("__last"))
    step = (F.col("__last") - F.col("__first")) / F.lit(float(n - 1))
    return ends.select(
        *group, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "__first", step.alias("__step")
    ).select(*group, "i", (F.col("__first") + F.col("i") * F.col("__step")).alias("day"))
