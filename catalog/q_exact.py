"""Fits, tests and grid means whose results have a closed form, so that SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.q_models import CELL, LEVELS, STEP, _diversity, _guilds, _stages
from catalog.registry import query, r
from surveyframe.models import contrasts as C
from surveyframe.models import glm, mixed
from surveyframe.models.gram import ModelSpec, fit_gaussian, mean_weights, reference_grid
from surveyframe.session import literal_frame

TYPES = ModelSpec([("type",)], LEVELS)
TYPE_PERIODS = ModelSpec([("type",), ("period",), ("type", "period")], LEVELS)

_GUILD_CELLS = "SELECT pair, type, guild, ln(avg(count)) AS est, 1 / sum(count) AS v FROM gc GROUP BY pair, type, guild"


@query("predict_cells", f"""
SELECT pair, type, guild, round(est, 6) AS link, round(sqrt(v), 6) AS link_se, round(exp(est), 6) AS conditional_mean,
 round(exp(est - 1.96 * sqrt(v)), 6) AS lower, round(exp(est + 1.96 * sqrt(v)), 6) AS upper, round(exp(est), 6) AS mean
FROM ({_GUILD_CELLS})""", ["gc"])
def _(spark, sf):
    g = _guilds(spark, sf)
    return glm.predict(glm.closed_form(g, CELL, "count"), g.select(*CELL).distinct())


@query("trend_moments", """
SELECT pair, type, guild, count(*) AS n, round(CAST(sum(count) AS DOUBLE), 2) AS total, round(sum(count * date_s), 2) AS moment FROM gc GROUP BY pair, type, guild""", ["gc"], places=2)
def _(spark, sf):
    """A Poisson line is the one whose fitted counts have the sum and the time moment of the observed ones."""
    g = _guilds(spark, sf)
    rows = glm.fitted_rows(g, glm.fit_cells(g, CELL, "count", "date_s", "poisson"), x="date_s")
    return rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("mu").alias("total"), F.sum(F.col("mu") * F.col("date_s")).alias("moment"))


_SCORES = f"""(SELECT survey_id, pair, type, guild, sum(count - exp(est)) * any_value(v) AS u FROM gc JOIN ({_GUILD_CELLS}) USING (pair, type, guild) GROUP BY ALL)"""
_NAME = "pair || '.' || type || '.' || guild || ':intercept'"


@query("sandwich_cells", f"""
SELECT * FROM (WITH s AS (SELECT survey_id, {_NAME} AS term, u FROM {_SCORES}), t AS (SELECT DISTINCT term FROM s),
p AS (SELECT x.term AS term_i, y.term AS term_j, sum(x.u * y.u) AS value FROM s x JOIN s y ON x.survey_id = y.survey_id GROUP BY ALL)
SELECT a.term AS term_i, b.term AS term_j, {r('coalesce(value, 0.0)', 9)} AS value FROM t a CROSS JOIN t b LEFT JOIN p ON p.term_i = a.term AND p.term_j = b.term)""", ["gc"], places=9)
def _(spark, sf):
    """Errors of cell means robust to what the rows of a survey share."""
    g = _guilds(spark, sf)
    return mixed.sandwich(g, glm.closed_form(g, CELL, "count"), "survey_id", "count").select("term_i", "term_j", "value")


_LINE = """(SELECT species, 'pair' AS test, pair, est AS e, v FROM c WHERE type = 'Natural'
  UNION ALL SELECT species, 'type:pair', pair, sum(CASE WHEN type = 'Artificial' THEN est ELSE -est END), sum(v) FROM c GROUP BY species, pair)"""
_ACROSS = ", ".join(f"max(CASE WHEN pair = 'pair_{k}' THEN {c} END) AS {c}{k}" for k in range(3) for c in "ev")


@query("wald_cells", f"""
SELECT * FROM (WITH c AS (SELECT species, type, pair, ln(avg(stage_count)) AS est, 1.0 / sum(stage_count) AS v FROM sframe GROUP BY species, type, pair),
w AS (SELECT species, test, {_ACROSS} FROM {_LINE} GROUP BY species, test),
d AS (SELECT species, test, ((v0 + v2) * (e1 - e0) ** 2 - 2 * v0 * (e1 - e0) * (e2 - e0) + (v0 + v1) * (e2 - e0) ** 2) / ((v0 + v1) * (v0 + v2) - v0 * v0) AS chisq FROM w)
SELECT species AS model, test, round(chisq, 4) AS chisq, 2 AS df, {r('exp(-chisq / 2)', 4)} AS p_value FROM d
UNION ALL SELECT species, 'type', round(sum(CASE WHEN type = 'Artificial' THEN est ELSE -est END) ** 2 / sum(v), 4), 1, NULL
FROM c WHERE pair = 'pair_0' GROUP BY species)""", ["sframe"], places=4)
def _(spark, sf):
    """Joint tests per species; with two degrees of freedom p is exp(-chisq / 2)."""
    fit = glm.closed_form(_stages(spark, sf), ["species", "type", "pair"], "stage_count")
    tests = C.term_tests(spark, {"type": fx.TYPES, "pair": fx.PAIRS})
    found = C.wald(glm.coefficients(fit, ["species"]), glm.covariance(fit, ["species"]), tests)
    return found.select("model", "test", "chisq", "df", F.when(F.col("df") == 2, F.col("p_value")).alias("p_value"))


_TYPE_SUMS = "(SELECT type, count(*) AS n, avg(shannon) AS m, var_pop(shannon) AS s FROM divs GROUP BY type)"


@query("gaussian_types", f"""
SELECT 'intercept' AS term, round(max(CASE WHEN type = 'Natural' THEN m END), 6) AS estimate, round(sqrt(max(CASE WHEN type = 'Natural' THEN s / n END)), 6) AS se,
 CAST(sum(n) - 4 AS DOUBLE) AS df FROM {_TYPE_SUMS}
UNION ALL SELECT 'type=Artificial', {r("sum(CASE WHEN type = 'Artificial' THEN m ELSE -m END)")}, round(sqrt(sum(s / n)), 6), CAST(sum(n) - 4 AS DOUBLE) FROM {_TYPE_SUMS}""", ["divs"])
def _(spark, sf):
    """Means of two types with a variance each."""
    return fit_gaussian(_diversity(spark, sf), TYPES, "shannon", "type").coefficients(spark).drop("model")


@query("variance_types", f"""
SELECT model, round(loglik, 4) AS loglik, n_par, round(2 * n_par - 2 * loglik, 4) AS aic FROM (
  SELECT 'constant' AS model, -0.5 * sum(n) * (ln(2 * pi() * sum(n * s) / sum(n)) + 1) AS loglik, 3 AS n_par FROM {_TYPE_SUMS}
  UNION ALL SELECT 'by_type', sum(-0.5 * n * (ln(2 * pi() * s) + 1)), 4 FROM {_TYPE_SUMS})""", ["divs"], places=4)
def _(spark, sf):
    """One variance against one per type, by likelihood."""
    div = _diversity(spark, sf)
    fits = {name: fit_gaussian(div, TYPES, "shannon", by).stats for name, by in (("constant", None), ("by_type", "type"))}
    rows = [(name, s["loglik"], s["n_par"], s["aic"]) for name, s in fits.items()]
    return literal_frame(spark, rows, "model string, loglik double, n_par bigint, aic double")


_PERIOD_SUMS = """(SELECT type, period, n, m, sum(n * s) OVER (PARTITION BY type) / sum(n) OVER (PARTITION BY type) / n AS v, sum(n) OVER () - 6 AS df
  FROM (SELECT type, period, count(*) AS n, avg(shannon) AS m, var_pop(shannon) AS s FROM divs GROUP BY type, period))"""


@query("grid_means", f"""
SELECT type || ' ' || period AS name, round(m, 6) AS estimate, round(sqrt(v), 6) AS se, CAST(df AS DOUBLE) AS df FROM {_PERIOD_SUMS}
UNION ALL SELECT 'types apart ' || period, {r("sum(CASE WHEN type = 'Artificial' THEN m ELSE -m END)")}, round(sqrt(sum(v)), 6), CAST(max(df) AS DOUBLE) FROM {_PERIOD_SUMS} GROUP BY period
UNION ALL SELECT 'type x period', {r("sum(CASE WHEN (type = 'Artificial') = (period = 'Post') THEN m ELSE -m END)")}, round(sqrt(sum(v)), 6), CAST(max(df) AS DOUBLE) FROM {_PERIOD_SUMS}""", ["divs"])
def _(spark, sf):
    """Marginal means and contrasts over the reference grid of a model that is saturated in type and period."""
    fit = fit_gaussian(_diversity(spark, sf), TYPE_PERIODS, "shannon", "type")
    grid = reference_grid(spark.range(1), TYPE_PERIODS)
    parts = [
        mean_weights(grid, TYPE_PERIODS, ["type", "period"]).withColumn("name", F.concat_ws(" ", "type", "period")),
        mean_weights(grid, TYPE_PERIODS, ["period"], STEP).withColumn("name", F.concat(F.lit("types apart "), "period")),
        mean_weights(grid, TYPE_PERIODS, [], {**STEP, "period": ("Pre", "Post")}).withColumn("name", F.lit("type x period")),
    ]
    first, *rest = (p.select("name", "term", "weight") for p in parts)
    for part in rest:
        first = first.unionByName(part)
    return C.contrast(fit.coefficients(spark), fit.covariance(spark), first, ["name"]).select("name", "estimate", "se", "df")
