"""Result tables derived from model predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.scalars import format_p, signif
from surveyframe.functions.special import t_975, t_two_sided
from surveyframe.models import contrasts as C
from surveyframe.models import glm


def stage_proportions(means: DataFrame, by: Sequence[str], response: str = "response") -> DataFrame:
    """Juvenile and adult responses side by side with their shares."""
    of = lambda stage: F.sum(F.when(F.col("life_stage") == stage, F.col(response))).alias(stage)
    wide = means.groupBy(*by).agg(of("juvenile"), of("adult"))
    wide = wide.withColumn("total", F.col("juvenile") + F.col("adult"))
    return wide.withColumns(
        {
            "juvenile_prop": F.try_divide("juvenile", "total"),
            "adult_prop": F.try_divide("adult", "total"),
        }
    )


def coef_table(coef: DataFrame, digits: int = 3) -> DataFrame:
    """Coefficients for print: three significant figures, interval and p as text."""
    reach = t_975("df") * F.col("se")
    text = lambda c: signif(c, digits).cast("string")
    bounds = F.concat(F.lit("["), text(F.col("estimate") - reach), F.lit(", "), text(F.col("estimate") + reach), F.lit("]"))
    p = format_p(t_two_sided(F.col("estimate") / F.col("se"), F.col("df")))
    return coef.select(
        F.col("term").alias("effect"), signif("estimate", digits).alias("estimate"), signif("se", digits).alias("se"),
        bounds.alias("ci"), p.alias("p_value"),
    )


@dataclass(frozen=True)
class ContrastTable:
    """One wanted table: groups, optional (from, to) per changed factor, and how p is treated."""

    by: Sequence[str]
    change: Mapping[str, tuple[str, str]] | None = None
    adjust: bool = False
    label: bool = False
    ratio: bool = False


def contrast_tables(
    fit, part: str, wanted: Mapping[str, ContrastTable], model_by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """The wanted contrasts of a fit's intercepts or slopes under the caller's names.

    ``adjust`` makes the p of a table one family, ``label`` names the direction of a slope
    (by the adjusted p where there is one), ``ratio`` leaves the log scale.
    """
    coef, vcov = glm.coefficients(fit, model_by), glm.covariance(fit, model_by)
    out = {}
    for name, table in wanted.items():
        found = C.contrast(coef, vcov, C.cell_weights(coef, part, table.by, table.change), table.by)
        if table.adjust:
            found = C.holm(found, "p_value")
        if table.label:
            found = C.labelled(found, "p_adjusted" if table.adjust else "p_value")
        out[name] = C.as_ratio(found) if table.ratio else found
    return out


def predicted_stages(fit, by: Sequence[str]) -> DataFrame:
    """Predicted stage counts with their band, one row per cell."""
    return glm.predict(fit, fit.coef.select(*by, "life_stage"))
