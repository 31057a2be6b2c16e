"""Hold-out comparison: fit on one part of the surveys, predict the other, compare errors on the log scale."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.models import glm, mixed, smooth
from surveyframe.models.diagnostics import over_effects
from surveyframe.operators.joins import split_by_key
from surveyframe.session import checkpointed

#: (training rows, rows to predict) to the latter with a column ``predicted``.
Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def _mean(rows: DataFrame, fit: mixed.MixedFit, mu: str) -> DataFrame:
    """``predicted``: mean over new clusters, whose effects are unknown, and the zero share."""
    per = fit.models.select("model", "sigma")
    name = mixed.interaction_key(fit.model_by) if fit.model_by else F.lit("model")
    placed = rows.withColumn("__model", name).join(per.withColumnsRenamed({"model": "__model", "sigma": "__sigma"}), "__model")
    mean = (1 - F.col("zi")) * over_effects(lambda m: m, F.col(mu), F.col("__sigma"))
    return placed.withColumn("predicted", mean).drop("__model", "__sigma")


def mixed_line(keys: Sequence[str], y: str, cluster: str, x: str, family: str = "nb2", **options) -> Predictor:
    """A line per cell with a random intercept per cluster, averaged over the effect."""

    def predict(train: DataFrame, test: DataFrame) -> DataFrame:
        fit = mixed.fit_mixed(train, keys, y, cluster, x, family, **options)
        return _mean(glm.fitted_rows(test, fit, x=x), fit, "mu")

    return predict


def mixed_smooth(keys: Sequence[str], y: str, cluster: str, x: str, family: str = "nb2", **options) -> Predictor:
    """A smooth per cell around the clusters' effects: the effects, dispersion and zero shares are those of
    the line, each row enters the smooth with its cluster's posterior effect as a fixed part."""

    def predict(train: DataFrame, test: DataFrame) -> DataFrame:
        fit = mixed.fit_mixed(train, keys, y, cluster, x, family, **options)
        effects = fit.clusters.select(F.col("cluster").alias(cluster), F.col("m").alias("__effect"))
        coef, knots = smooth.fit_smooth(train.join(effects, cluster, "left"), keys, x, y, fit, offset="__effect")
        rows = smooth.predict_smooth(coef, knots, glm.fitted_rows(test, fit, x=x), keys, x, "__smooth")
        return _mean(rows, fit, "__smooth").drop("__smooth")

    return predict


def holdout(
    df: DataFrame, test_keys: DataFrame, key: Sequence[str], y: str, models: Mapping[str, Predictor], baseline: str
) -> DataFrame:
    """(model, log_rmse, difference_pct): every model fitted without the surveys in ``test_keys`` and measured on them."""
    train, test = (checkpointed(part) for part in split_by_key(df, test_keys, list(key)))
    parts = [predict(train, test).select(F.lit(name).alias("model"), F.col(y), "predicted") for name, predict in models.items()]
    errors = glm.log_rmse(reduce(lambda a, b: a.unionByName(b), parts), y, "predicted", ["model"])
    return glm.compare_errors(errors, "model", baseline)
