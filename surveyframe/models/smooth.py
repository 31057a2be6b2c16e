"""Penalised smooth trend per cell: line plus two broken-line pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.models import glm
from surveyframe.operators.keys import join_on
from surveyframe.operators.ordering import exact_quantiles
from surveyframe.session import checkpointed, stored, stored_with_max

# Fixed value: size of the basis.
BASIS = 4
PENALTIES = tuple(10.0 ** (k / 2) for k in range(-4, 13))


def basis(x: Column, knots: Sequence[float]) -> list[Column]:
    return [F.lit(1.0), x, *[F.greatest(x - float(k), F.lit(0.0)) for k in knots]]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per cell: the penalty with the smallest generalised cross-validation score and its
    coefficients. Input is one row of sums per cell."""
    pairs = [(i, j) for i in range(BASIS) for j in range(i, BASIS)]
    for pdf in batches:
        m = len(pdf)
        g = np.zeros((m, BASIS, BASIS))
        for i, j in pairs:
            g[:, i, j] = g[:, j, i] = pdf[f"g{i}_{j}"]
        r = pdf[[f"r{i}" for i in range(BASIS)]].to_numpy(float)
        zz, n = pdf["zz"].to_numpy(float), pdf["n"].to_numpy(float)
        best = np.full(m, np.inf)
        beta, lam, edf = np.zeros((m, BASIS)), np.zeros(m), np.zeros(m)
        penalty = np.diag([0.0, 0.0] + [1.0] * (BASIS - 2))
        ridge = np.eye(BASIS) * 1e-8 * np.maximum(g[:, 0, 0], 1e-8)[:, None, None]
        for value in PENALTIES:
            inverse = np.linalg.inv(g + value * penalty + ridge)
            b = np.einsum("mij,mj->mi", inverse, r)
            free = np.einsum("mij,mji->m", inverse, g)
            rss = zz - 2 * np.einsum("mi,mi->m", b, r) + np.einsum("mi,mij,mj->m", b, g, b)
            score = n * rss / np.maximum(n - free, 1e-6) ** 2
            take = score < best
            best[take], beta[take], lam[take], edf[take] = score[take], b[take], value, free[take]
        old = pdf[[f"b{i}" for i in range(BASIS)]].to_numpy(float)
        out = pdf[[c for c in pdf.columns if c.startswith("key_")]].copy()
        for i in range(BASIS):
            out[f"b{i}"] = beta[:, i]
        out["phi"], out["lam"], out["edf"], out["n"] = pdf["phi"].to_numpy(), lam, edf, n
        out["step"] = np.abs(beta - old).max(axis=1)
        yield out


def fit_smooth(
    df: DataFrame, keys: Sequence[str], x: str, y: str, start: glm.CellFit, rounds: int = 30, tolerance: float = 1e-5, offset: str | None = None
) -> tuple[DataFrame, list[float]]:
    """(coefficients per cell, knots): penalised iteration on the log link with the family
    and dispersion of ``start``. Knots are the thirds of all x. Each round is one
    aggregation of basis products per cell; a cell's system has four unknowns. ``offset`` names a
    known part of each row's linear predictor, such as its cluster's effect. Cells without a count keep their
    starting line. Coefficients have ``converged`` per cell; cells may trade between two penalties of
    the grid, so those that still move after ``rounds`` are marked, not hidden."""
    keys = list(keys)
    fixed = F.coalesce(F.col(offset), F.lit(0.0)) if offset else F.lit(0.0)
    rows = checkpointed(glm.model_rows(df.withColumn("__fixed", fixed), [*keys, "__fixed"], y, x))
    thirds = exact_quantiles(rows, [], "x", {"k1": 1 / 3, "k2": 2 / 3}, weight="n").first()
    knots = [thirds["k1"], thirds["k2"]]
    names = {f"key_{i}": k for i, k in enumerate(keys)}
    coef = start.coef.select(*keys, F.col("a").alias("b0"), F.col("b").alias("b1"), F.lit(0.0).alias("b2"), F.lit(0.0).alias("b3"), "phi")
    kinds = dict(coef.dtypes)
    schema = ", ".join([f"{i} {kinds[k]}" for i, k in names.items()] + [f"b{i} double" for i in range(BASIS)]) + ", phi double, lam double, edf double, n double, step double"
    for _ in range(rounds):
        joined = join_on(rows, coef.select(*keys, "b0", "b1", "b2", "b3", "phi"), keys)
        c = basis(F.col("x"), knots)
        joined = joined.withColumns({f"c{i}": e for i, e in enumerate(c)})
        eta = sum((F.col(f"b{i}") * F.col(f"c{i}") for i in range(1, BASIS)), F.col("b0") + F.col("__fixed"))
        joined = joined.withColumn("eta", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)))
        joined = joined.withColumn("mu", F.exp("eta"))
        w = {"poisson": F.col("mu"), "nb2": F.col("mu") / (1 + F.col("mu") / F.col("phi")), "nb1": F.col("mu") / (1 + F.col("phi"))}[start.family]
        joined = joined.withColumns({"w": F.col("n") * w, "zeta": F.col("eta") - F.col("__fixed") + (F.col("y") - F.col("mu")) / F.col("mu")})
        sums = joined.groupBy(*[F.col(k).alias(i) for i, k in names.items()]).agg(
            *[F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(BASIS) for j in range(i, BASIS)],
            *[F.sum(F.col("w") * F.col(f"c{i}") * F.col("zeta")).alias(f"r{i}") for i in range(BASIS)],
            F.sum(F.col("w") * F.col("zeta") * F.col("zeta")).alias("zz"), F.sum("n").alias("n"), F.max("phi").alias("phi"),
            *[F.max(f"b{i}").alias(f"b{i}") for i in range(BASIS)],
        )
        solved = sums.mapInPandas(_solve, schema).withColumnsRenamed(names)
        coef, step = stored_with_max(solved, "step")
        if step < tolerance:
            break
    return stored(coef.withColumn("converged", F.col("step") < tolerance)), knots


def predict_smooth(coef: DataFrame, knots: Sequence[float], grid: DataFrame, keys: Sequence[str], x: str, out: str = "smooth_mean") -> DataFrame:
    joined = join_on(grid, coef.select(*keys, "b0", "b1", "b2", "b3"), list(keys))
    eta = sum((F.col(f"b{i}") * c for i, c in enumerate(basis(F.col(x).cast("double"), knots))), F.lit(0.0))
    return joined.withColumn(out, F.exp(eta)).drop("b0", "b1", "b2", "b3")
