"""Data frames behind the figures; nothing is drawn here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_stage_proportions(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed juvenile share per survey and species, where anything was seen."""
    of = lambda stage: F.sum(F.when(F.col("life_stage") == stage, F.col("stage_count")).otherwise(0)).alias(stage)
    wide = frame.groupBy(*by).agg(of("juvenile"), of("adult"))
    total = F.col("juvenile") + F.col("adult")
    seen = wide.withColumn("total_count", total).where(F.col("total_count") > 0)
    return seen.withColumn("raw_juvenile_prop", F.col("juvenile") / F.col("total_count"))


def timeline_frame(surveys: DataFrame, deployments: DataFrame) -> DataFrame:
    """Survey points and, per group, the event that divides them."""
    points = surveys.select("pair", "site", "type", "date", F.lit("survey").alias("kind"))
    events = deployments.where(F.col("deployment_date").isNotNull()).select(
        "pair", F.col("deployment_date").alias("date"), F.lit("event").alias("kind")
    )
    return points.unionByName(events, allowMissingColumns=True)


def trajectory_frame(fit, df: DataFrame, keys: Sequence[str], scale: DataFrame, n: int = 100) -> DataFrame:
    """Evenly spaced dates per trajectory with the predicted mean and its band.

    ``scale`` is the one-row line (slope, intercept, origin_day) from days to the model's
    time variable.
    """
    from surveyframe.models import glm
    from surveyframe.operators.joins import date_grid
    from surveyframe.operators.keys import attach_scalars

    grid = attach_scalars(date_grid(df, keys, "date", n), scale)
    x = F.col("intercept") + F.col("slope") * (F.col("day") - F.col("origin_day"))
    grid = grid.withColumn("date_s", x).drop("slope", "intercept", "origin_day")
    return glm.predict(fit, grid, "date_s")


def time_line(df: DataFrame) -> DataFrame:
    """slope, intercept and origin_day of the map from dates to ``date_s``."""
    from surveyframe.operators.joins import linear_map
    from surveyframe.operators.keys import attach_scalars

    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    origin = df.agg(F.min(day - F.col("date_num")).cast("double").alias("origin_day"))
    return attach_scalars(linear_map(df, "date_num", "date_s"), origin)


def diversity_frame(fit, df: DataFrame, deployments: DataFrame, scale: DataFrame, n: int = 100) -> DataFrame:
    """Evenly spaced dates per pair and type with period, predicted diversity and band."""
    from surveyframe.functions.scalars import BAND_Z, period_flag
    from surveyframe.operators.joins import date_grid
    from surveyframe.operators.keys import attach_scalars

    grid = attach_scalars(date_grid(df, ["pair", "type"], "date", n), scale).join(deployments, "pair", "left")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor("day").cast("int"))
    grid = grid.select(
        "pair", "type", "i", "day", period_flag(day, "deployment_date").alias("period"),
        (F.col("intercept") + F.col("slope") * (F.col("day") - F.col("origin_day"))).alias("date_s"),
    )
    band = BAND_Z * F.col("se")
    return fit.predict(grid).withColumns({"lower": F.col("predicted") - band, "upper": F.col("predicted") + band})


def balance_frame(stage_contrasts: DataFrame) -> DataFrame:
    """Juvenile to adult ratio from the adult to juvenile one, on the log2 scale."""
    from surveyframe.functions.scalars import invert_ratio

    ratio, low, high = invert_ratio("ratio", "ratio_lower", "ratio_upper")
    out = stage_contrasts.select("type", "pair", ratio.alias("ratio"), low.alias("lower"), high.alias("upper"))
    return out.withColumns({f"log2_{c}": F.log2(c) for c in ("ratio", "lower", "upper")})


def balance_segments(balance: DataFrame, types: Sequence[str]) -> DataFrame:
    """Both types' ratios of a pair on one row: the ends of its connecting line."""
    from surveyframe.operators.reshape import to_wide_many

    return to_wide_many(balance, ["pair"], "type", types, ["log2_ratio"])


def species_frame(proportions: DataFrame, stage_contrasts: DataFrame, composition: DataFrame) -> DataFrame:
    """Model proportions per species with bounds from the stage ratio and the p of the
    composition contrast. Ratios are adult to juvenile, so bounds are inverted first."""
    from surveyframe.functions.scalars import invert_ratio, odds_to_prop

    _, low, high = invert_ratio("ratio", "ratio_lower", "ratio_upper")
    bounds = stage_contrasts.select(
        F.col("model").alias("species"), "type", "pair",
        odds_to_prop(low).alias("juvenile_prop_lower"), odds_to_prop(high).alias("juvenile_prop_upper"),
    )
    tests = composition.select(F.col("model").alias("species"), "pair", "p_value", (F.col("p_value") < 0.05).alias("significant"))
    return proportions.join(bounds, ["species", "type", "pair"], "left").join(tests, ["species", "pair"], "left")
