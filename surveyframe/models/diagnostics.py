"""Residual checks of fitted count models, as aggregations over the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.scalars import interaction_key
from surveyframe.functions.special import (
    binomial_cdf,
    chi2_upper_tail,
    count_steps,
    kolmogorov_tail,
    normal_cdf,
    normal_two_sided,
)
from surveyframe.models import families, glm
from surveyframe.models.contrasts import holm
from surveyframe.operators.ordering import ranked_values
from surveyframe.session import stored

# Fixed value: seed of the randomised residuals.
SEED = 42


#: Nodes of an effect's distribution in marginal probabilities.
NODES = 15


def _effect_nodes(count: int = NODES) -> list[tuple[float, float]]:
    """Standard normal nodes and their weights."""
    at, weight = np.polynomial.hermite_e.hermegauss(count)
    return [(float(a), float(w / math.sqrt(2 * math.pi))) for a, w in zip(at, weight)]


def over_effects(value, mu, sigma: Column | None):
    """Mean of ``value(mu)`` over a normal effect on the log scale; ``value(mu)`` itself without one."""
    if sigma is None:
        return value(mu)
    parts = [F.lit(w) * value(mu * F.exp(sigma * F.lit(u))) for u, w in _effect_nodes()]
    return reduce(lambda a, b: a + b, parts)


def marginal_moments(family: str, zi: Column, mu: Column, phi: Column, sigma: Column | None) -> tuple[Column, Column]:
    """Mean and variance of a count with a zero share and a normal effect on the log scale."""
    mean = over_effects(lambda m: m, mu, sigma)
    square = over_effects(lambda m: families.variance(family, m, phi) + m * m, mu, sigma)
    mean, square = (1 - zi) * mean, (1 - zi) * square
    return mean, square - mean * mean


def pit_residuals(rows: DataFrame, family: str, key: Sequence[str], y: str, seed: int = SEED, sigma: str | None = None) -> DataFrame:
    """Randomised quantile residual ``u`` of rows with mu, phi and zi.

    u lies between F(y-1) and F(y); the place between them is a hash of the row key and the
    seed, so it does not depend on partitioning. ``sigma`` names the deviation of a normal effect on the log
    scale, over which F is averaged; residuals of one cluster then still depend on each other. ``gaussian`` rows have mu and the variance phi,
    and no draw: u is F(y).
    """
    if family == "gaussian":
        return rows.withColumn("u", normal_cdf((F.col(y) - F.col("mu")) / F.sqrt("phi")))
    effect = None if sigma is None else F.col(sigma)
    zi = F.col("zi")
    at = lambda name: F.when(F.col(y) >= 0, zi + (1 - zi) * F.col("__steps").getField(name))
    rows = rows.withColumn("__steps", count_steps(family, y, "mu", "phi", effect, _effect_nodes()))
    low = F.when(F.col(y) <= 0, 0.0).otherwise(zi + (1 - zi) * F.col("__steps").getField("below"))
    draw = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(2**53))
    return rows.withColumn("u", low + draw * (at("upto") - low)).drop("__steps")


def ks_uniform(df: DataFrame, u: str = "u", by: Sequence[str] = ()) -> DataFrame:
    """Largest distance between the values' distribution and the uniform one, per group of ``by``."""
    ranks = ranked_values(df, list(by), u)
    above = (F.col("n_before") + F.col("n")) / F.col("total") - F.col(u)
    below = F.col(u) - F.col("n_before") / F.col("total")
    out = ranks.groupBy(*by).agg(F.max(F.greatest(above, below)).alias("statistic"), F.max("total").alias("n"))
    return out.withColumn("p_value", kolmogorov_tail("statistic", "n"))


def pearson_dispersion(rows: DataFrame, family: str, y: str, n_par: int | Column, by: Sequence[str] = (), sigma: str | None = None) -> DataFrame:
    """Sum of squared Pearson residuals over the residual degrees of freedom, and its upper-tail p, per group of ``by``.

    Means and variances include a zero share (column zi, if there is one) and, with ``sigma``, a normal effect.
    ``n_par`` is a number or a column that is constant in a group.
    """
    zi = F.col("zi") if "zi" in rows.columns else F.lit(0.0)
    mean, variance = marginal_moments(family, zi, F.col("mu"), F.col("phi"), None if sigma is None else F.col(sigma))
    square = F.pow(F.col(y) - mean, 2) / variance
    used = F.lit(n_par) if isinstance(n_par, int) else F.max(n_par)
    out = rows.groupBy(*by).agg(F.sum(square).alias("chisq"), (F.count(F.lit(1)) - used).alias("df"))
    out = out.withColumn("dispersion", F.try_divide("chisq", "df"))
    return out.withColumn("p_value", chi2_upper_tail("chisq", "df"))


def zero_test(rows: DataFrame, family: str, y: str, by: Sequence[str] = (), sigma: str | None = None) -> DataFrame:
    """Observed zeros against the sum of the model's zero probabilities, per group of ``by``."""
    p0 = over_effects(lambda m: families.zero_probability(family, m, F.col("phi")), F.col("mu"), None if sigma is None else F.col(sigma))
    p0 = F.col("zi") + (1 - F.col("zi")) * p0
    out = rows.withColumn("__p0", p0).groupBy(*by).agg(
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("bigint").alias("observed"),
        F.sum("__p0").alias("expected"),
        F.sum(F.col("__p0") * (1 - F.col("__p0"))).alias("variance"),
    )
    out = out.withColumn("z", F.try_divide(F.col("observed") - F.col("expected"), F.sqrt("variance")))
    return out.withColumn("p_value", normal_two_sided("z"))


def outlier_test(residuals: DataFrame, u: str = "u", draws: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """Rows outside the range of ``draws`` simulations: two-sided binomial test of their
    number against its expectation 2 / (draws + 1) per row, per group of ``by``."""
    edge = 1.0 / (draws + 1)
    out = residuals.groupBy(*by).agg(
        F.sum(F.when((F.col(u) < edge) | (F.col(u) > 1 - edge), 1).otherwise(0)).cast("bigint").alias("outliers"),
        F.count(u).alias("n"),
    )
    p = F.lit(2 * edge)
    lower, upper = binomial_cdf("outliers", "n", p), 1 - binomial_cdf(F.col("outliers") - 1, "n", p)
    out = out.withColumns({"__low": lower, "__high": upper})
    return out.withColumns({"expected": F.col("n") * p, "p_value": F.least(F.lit(1.0), 2 * F.least("__low", "__high"))}).drop("__low", "__high")


def health_table(df: DataFrame, fit, key: Sequence[str], y: str, x: str | None = None) -> DataFrame:
    """One row per model of a mixed fit: how it ended, the effects' deviation, boundary flags, and the p of
    uniformity, dispersion, zeros and outliers, all models in the same passes."""
    per = fit.models.select("model", "sigma", "n_par", "loglik", "converged", "positive_definite", "at_boundary", "at_bound", "max_score")
    name = interaction_key(fit.model_by) if fit.model_by else F.lit("model")
    rows = glm.fitted_rows(df, fit, y, x).withColumn("model", name).join(per.select("model", "sigma", "n_par"), "model")
    rows = stored(pit_residuals(rows, fit.family, key, y, sigma="sigma").select("model", y, "mu", "phi", "zi", "sigma", "n_par", "u"))
    p = lambda table, out, *more: table.select("model", F.col("p_value").alias(out), *more)
    found = p(ks_uniform(rows, by=["model"]), "uniformity_p")
    found = found.join(p(pearson_dispersion(rows, fit.family, y, F.col("n_par"), ["model"], "sigma"), "dispersion_p", "dispersion"), "model")
    found = found.join(p(zero_test(rows, fit.family, y, ["model"], "sigma"), "zero_p"), "model")
    found = found.join(p(outlier_test(rows, by=["model"]), "outlier_p", "outliers"), "model")
    return per.join(found, "model", "left").withColumnRenamed("sigma", "cluster_sd")


def durbin_watson(df: DataFrame, series: Sequence[str], time: str, residual: str, width: float = 366.0) -> DataFrame:
    """Lag-one autocorrelation statistic per series ordered by ``time``, and its normal p.

    Residuals of one time are averaged first, so that rows sharing a time have no order to choose.

    A series is cut into stretches of ``width`` time units; differences inside a stretch and
    across stretch borders are added, so a long series is not ordered in one task.
    """
    series = list(series)
    steps = df.where(F.col(residual).isNotNull()).groupBy(*series, time).agg(F.avg(residual).alias(residual))
    rows = steps.withColumn("__part", F.floor(F.col(time) / width))
    inside = Window.partitionBy(*series, "__part").orderBy(time)
    rows = rows.withColumn("__d", F.col(residual) - F.lag(residual).over(inside))
    e = F.col(residual)
    parts = rows.groupBy(*series, "__part").agg(
        F.sum(F.col("__d") * F.col("__d")).alias("__d2"),
        F.count(F.lit(1)).alias("__n"),
        F.sum(e).alias("__s"),
        F.sum(e * e).alias("__ss"),
        F.min_by(residual, time).alias("__first"),
        F.max_by(residual, time).alias("__last"),
    )
    gap = F.col("__first") - F.lag("__last").over(Window.partitionBy(*series).orderBy("__part"))
    added = F.coalesce("__d2", F.lit(0.0)) + F.coalesce(F.col("__gap") * F.col("__gap"), F.lit(0.0))
    sums = parts.withColumn("__gap", gap).groupBy(*series).agg(
        F.sum("__n").alias("__n"), F.sum(added).alias("__d2"), F.sum("__s").alias("__s"), F.sum("__ss").alias("__ss")
    )
    around = F.col("__ss") - F.col("__s") * F.col("__s") / F.col("__n")
    dw = F.when((F.col("__n") > 2) & (around > 1e-12), F.try_divide(F.col("__d2"), around))
    n = F.col("__n").cast("double")
    spread = F.sqrt(2 * (2 * n - 4 - 4 / n) / (n * n - 1))
    out = sums.select(*series, F.col("__n").alias("n"), dw.alias("dw"), F.when(n > 3, spread).alias("__sd"))
    z = F.try_divide(F.col("dw") - 2, F.col("__sd"))
    return out.withColumn("p_value", normal_two_sided(z)).drop("__sd")


def temporal_autocorrelation(df: DataFrame, series: Sequence[str], time: str, residual: str) -> DataFrame:
    """Test per series with p adjusted over all of them."""
    return holm(durbin_watson(df, series, time, residual), "p_value")


