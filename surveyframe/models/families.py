"""Count families on the log link: score, information and likelihood of a row as columns.

``nb2`` has variance mu + mu^2/phi, ``nb1`` has mu + phi*mu. Derivatives in phi are taken
in log(phi).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.special import digamma, lgamma, trigamma

FAMILIES = ("poisson", "nb1", "nb2")


def loglik(family: str, y: Column, mu: Column, phi: Column) -> Column:
    """Log-likelihood of a count; a mean of zero is raised to a tiny positive value."""
    mu = F.greatest(mu, F.lit(1e-300))
    base = -lgamma(y + 1)
    if family == "poisson":
        return base + y * F.ln(mu) - mu
    if family == "nb2":
        return base + lgamma(y + phi) - lgamma(phi) + phi * F.ln(phi) + y * F.ln(mu) - (y + phi) * F.ln(mu + phi)
    size = mu / phi
    return base + lgamma(y + size) - lgamma(size) - size * F.log1p(phi) + y * (F.ln(phi) - F.log1p(phi))


def zero_probability(family: str, mu: Column, phi: Column) -> Column:
    if family == "poisson":
        return F.exp(-mu)
    if family == "nb2":
        return F.exp(-phi * F.log1p(mu / phi))
    return F.exp(-mu / phi * F.log1p(phi))


def variance(family: str, mu: Column, phi: Column) -> Column:
    if family == "poisson":
        return mu
    return mu + mu * mu / phi if family == "nb2" else mu * (1 + phi)


def with_derivatives(df: DataFrame, family: str, with_phi: bool = True) -> DataFrame:
    """Add mu, d1 (d/d eta), w (expected information), obs (observed information) and, for
    the negative binomials, up, hp (first and second d/d log phi) and cp (cross term).

    Needs columns y, eta, phi. Columns are added step by step so shared parts are computed once.
    """
    for step in _derivative_steps(family, with_phi):
        df = df.withColumns(step)
    return df


@lru_cache
def _derivative_steps(family: str, with_phi: bool) -> list[dict[str, Column]]:
    """The added columns in order. Built once: iterations reuse the expressions."""
    y, mu, phi = F.col("y"), F.col("mu"), F.col("phi")
    steps = [{"mu": F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("eta"))))}]
    no_phi = {"up": F.lit(0.0), "hp": F.lit(-1.0), "cp": F.lit(0.0)}
    if family == "poisson":
        return [*steps, {"d1": y - mu, "w": mu, "obs": mu, **no_phi}]
    if family == "nb2":
        steps.append({"q": 1 + mu / phi})
        means = {"d1": (y - mu) / F.col("q"), "w": mu / F.col("q"), "obs": mu / F.col("q")}
        if not with_phi:
            return [*steps, {**means, **no_phi}]
        t = mu + phi
        up = phi * (digamma(y + phi) - digamma(phi) + F.ln(phi) + 1 - F.ln(t) - (y + phi) / t)
        tri = trigamma(y + phi) - trigamma(phi) + 1 / phi - 2 / t + (y + phi) / (t * t)
        steps.append({**means, "up": up, "tri": tri, "cp": F.lit(0.0)})
        return [*steps, {"hp": F.col("up") + phi * phi * F.col("tri")}]
    s, k = F.col("s"), 1 + phi
    steps.append({"s": mu / phi})
    steps.append({"psi": digamma(y + s) - digamma(s) - F.log1p(phi), "psi1": trigamma(y + s) - trigamma(s)})
    a, b = F.col("psi"), F.col("psi1")
    first = -s / phi * a - s / k + y * (1 / phi - 1 / k)
    second = (
        2 * s / (phi * phi) * a + s / phi * (b * s / phi + 1 / k) + s / phi / k + s / (k * k) - y / (phi * phi) + y / (k * k)
    )
    steps.append(
        {
            "d1": s * a,
            "w": mu / k,
            "obs": -(s * a + s * s * b),
            "up": phi * first,
            "hp": phi * first + phi * phi * second,
            "cp": phi * (-s / phi * a - s * (b * s / phi + 1 / k)),
        }
    )
    return steps
