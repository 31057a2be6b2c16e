"""Linear contrasts of coefficients, marginal averages, ratios and joint tests.

Everything is a join of three long frames: coefficients (model, term, estimate, df),
covariances (model, term_i, term_j, value) and weights (contrast columns, term, weight).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.scalars import significance_label, trajectory_label
from surveyframe.functions.special import chi2_upper_tail, t_975, t_two_sided
from surveyframe.operators.keys import attach_scalars, join_on
from surveyframe.operators.ordering import ranked_values, running_max
from surveyframe.session import literal_frame

def _term_join(coef: DataFrame, weights: DataFrame) -> list[str]:
    return ["model", "term"] if "model" in weights.columns else ["term"]


def contrast(coef: DataFrame, vcov: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """Estimate, standard error, interval and two-sided p of each weighted sum; all null where a
    used coefficient or its variance is unknown.

    ``by`` names the contrast columns of ``weights``. Without a model column in the weights
    every model is contrasted alike.
    """
    by = list(by)
    keys = _term_join(coef, weights)
    used = weights.select(*by, *keys, "weight")
    model = [k for k in keys if k == "model"]
    terms = used.join(coef.select("model", "term", "estimate", "df"), keys)
    product = F.col("weight") * F.col("estimate")
    value = terms.groupBy("model", *by).agg(F.sum(product).alias("estimate"), F.count(product).alias("__known"), F.min("df").alias("df"))
    wanted = used.groupBy(*by, *model).agg(F.count(F.lit(1)).alias("__wanted"))
    value = join_on(value, wanted, [*by, *model]) if by or model else attach_scalars(value, wanted)
    spread = contrast_covariance(vcov, weights, by, diagonal=True)
    out = join_on(value, spread, ["model", *by], "left")
    sure = (F.col("__known") == F.col("__wanted")) & (F.col("__pairs") == F.col("__wanted")) & (F.col("__gaps") == 0)
    out = out.withColumns({"estimate": F.when(sure, F.col("estimate")), "se": F.when(sure, F.sqrt("variance"))}).drop(
        "variance", "__known", "__wanted", "__pairs", "__gaps"
    )
    out = out.withColumn("statistic", F.try_divide("estimate", "se"))
    reach = t_975("df") * F.col("se")
    return out.withColumns(
        {"lower": F.col("estimate") - reach, "upper": F.col("estimate") + reach, "p_value": t_two_sided("statistic", "df")}
    )


def contrast_covariance(vcov: DataFrame, weights: DataFrame, by: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Covariance of contrasts: variances only, or (model, group..., row_i, row_j, value)
    where ``by`` ends with the row number inside a joint test."""
    by = list(by)
    model = ["model"] if "model" in weights.columns else []
    left = weights.select(*by, *model, F.col("term").alias("term_i"), F.col("weight").alias("wi"))
    right = weights.select(*by, *model, F.col("term").alias("term_j"), F.col("weight").alias("wj"))
    half = left.join(vcov, [*model, "term_i"])
    part = F.sum(F.col("wi") * F.col("wj") * F.col("value"))
    gaps = F.count_if(F.col("value").isNull() | F.col("wi").isNull() | F.col("wj").isNull())
    if diagonal:
        return join_on(half, right, [*by, *model, "term_j"]).groupBy("model", *by).agg(
            part.alias("variance"), F.count_if(F.col("term_i") == F.col("term_j")).alias("__pairs"), gaps.alias("__gaps")
        )
    group, row = by[:-1], by[-1]
    half = half.withColumnRenamed(row, "row_i")
    right = right.withColumnRenamed(row, "row_j")
    joined = join_on(half, right, [*group, *model, "term_j"])
    return joined.groupBy("model", *group, "row_i", "row_j").agg(F.when(gaps == 0, part).alias("value"))


def cell_weights(
    coef: DataFrame, part: str, by: Sequence[str], change: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Weights over the cells of a fit, cells inside a group averaged equally.

    ``change`` maps a factor to (from, to): one factor gives a difference, two give a
    difference of differences. Without it the result is the plain average per group. Where a
    cell or a whole side is absent the weights are null, and so is the contrast.
    """
    change = change or {}
    cells = coef.where(F.col("part") == part)
    sign = F.lit(1.0)
    for factor, (start, end) in change.items():
        cells = cells.where(F.col(factor).isin(start, end))
        sign = sign * F.when(F.col(factor) == end, 1.0).otherwise(-1.0)
    group = ["model", *by, *change]
    size = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    # Equal weights compare like with like only where every group has all the cells, and a
    # difference needs both ends of every factor.
    full = size.groupBy("model").agg(F.max("__size").alias("__full"))
    corners = size.groupBy("model", *by).agg(F.count(F.lit(1)).alias("__corners"), F.min("__size").alias("__least"))
    corners = join_on(corners, full, ["model"])
    joined = join_on(join_on(cells, size, group), corners, ["model", *by])
    whole = (F.col("__corners") == 2 ** len(change)) & (F.col("__least") == F.col("__full"))
    return joined.select("model", *by, "term", F.when(whole, sign / F.col("__size")).alias("weight"))


def as_ratio(contrasts: DataFrame) -> DataFrame:
    """Log-scale contrasts as ratios with their bounds."""
    return contrasts.withColumns(
        {
            "ratio": F.exp("estimate"),
            "ratio_se": F.exp("estimate") * F.col("se"),
            "ratio_lower": F.exp("lower"),
            "ratio_upper": F.exp("upper"),
            "significance": significance_label("p_value"),
        }
    )


def labelled(contrasts: DataFrame, p: str = "p_value") -> DataFrame:
    return contrasts.withColumn("trajectory", trajectory_label("estimate", p))


def holm(df: DataFrame, p: str, family_by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """Step-down adjusted p inside each family. Equal p share the first of their places, so
    the steps run over distinct values; no family is gathered in one task."""
    family = list(family_by)
    places = ranked_values(df, family, p)
    places = places.withColumn("__stepped", (F.col("total") - F.col("n_before")) * F.col(p))
    stepped = running_max(places, family, p, "__stepped", "__top").select(
        *family, p, F.least(F.lit(1.0), F.col("__top")).alias(out)
    )
    return join_on(df, stepped, [*family, p], "left")


# --- joint tests ---------------------------------------------------------------------------


def term_tests(spark: SparkSession, levels: Mapping[str, Sequence[str]], part: str = "intercept", marginal: bool = False) -> DataFrame:
    """Weights of the joint test of every main effect and interaction over a full grid of
    factor levels: (test, row, term, weight).

    Treatment coding tests a term at the first level of the other factors, ``marginal``
    averages over them.
    """
    names = list(levels)
    rows = []
    for mask in product([0, 1], repeat=len(names)):
        if not any(mask):
            continue
        matrices = []
        for name, on in zip(names, mask):
            k = len(levels[name])
            if on:
                matrices.append(np.hstack([-np.ones((k - 1, 1)), np.eye(k - 1)]))
            else:
                matrices.append(np.full((1, k), 1.0 / k) if marginal else np.eye(1, k))
        full = matrices[0]
        for m in matrices[1:]:
            full = np.kron(full, m)
        test = ":".join(n for n, on in zip(names, mask) if on)
        for i, row in enumerate(full):
            for cell, w in zip(product(*levels.values()), row):
                if w:
                    rows.append((test, i, f"{'.'.join(cell)}:{part}", float(w)))
    return literal_frame(spark, rows, "test string, row int, term string, weight double")


def wald(coef: DataFrame, vcov: DataFrame, tests: DataFrame) -> DataFrame:
    """Chi-square, degrees of freedom and p of each (model, test)."""
    keys = _term_join(coef, tests)
    product = F.col("weight") * F.col("estimate")
    values = tests.join(coef.select("model", "term", "estimate"), keys).groupBy("model", "test", "row").agg(
        F.when(F.count_if(product.isNull()) == 0, F.sum(product)).alias("value")
    )
    cov = contrast_covariance(vcov, tests, ["test", "row"])
    rows = values.select("model", "test", F.col("row").alias("row_i"), F.lit(None).cast("int").alias("row_j"), "value")
    system = rows.unionByName(cov.select("model", "test", "row_i", "row_j", "value"))
    solved = system.groupBy("model", "test").applyInPandas(_chi_square, "model string, test string, chisq double, df bigint")
    return solved.withColumn("p_value", chi2_upper_tail("chisq", "df")).withColumn("significance", significance_label("p_value"))


def _chi_square(pdf: pd.DataFrame) -> pd.DataFrame:
    """q' C^-1 q of one test: a system of at most a few dozen rows."""
    vector = pdf[pdf["row_j"].isna()].sort_values("row_i")
    square = pdf[pdf["row_j"].notna()].pivot(index="row_i", columns="row_j", values="value").sort_index(axis=0).sort_index(axis=1)
    q, c = vector["value"].to_numpy(float), square.to_numpy(float)
    usable = len(q) == c.shape[0] and np.isfinite(q).all() and np.isfinite(c).all()
    chisq = float(q @ np.linalg.pinv(c) @ q) if usable else None
    df = int(np.linalg.matrix_rank(c)) if usable else None
    out = pd.DataFrame({"model": [pdf["model"].iloc[0]], "test": [pdf["test"].iloc[0]], "chisq": [chisq], "df": [df]})
    return out.astype({"chisq": "Float64", "df": "Int64"})
