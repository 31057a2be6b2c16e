"""Model, diagnostic, contrast and figure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog.views  # noqa: F401
from catalog.registry import query, r
from catalog import fixtures as fx
from surveyframe.models import contrasts as C
from surveyframe.models import diagnostics as D
from surveyframe.models import glm, mixed, smooth
from surveyframe.models.holdout import holdout, mixed_line, mixed_smooth
from surveyframe.models.gram import ModelSpec, design_columns, design_support, fit_gaussian, gram, mean_weights, reference_grid
from surveyframe.models.sparse import weighted_counts
from surveyframe.operators.diversity import diversity
from surveyframe.operators.joins import time_holdout
from surveyframe.operators.keys import attach_scalars
from surveyframe.plans import clean, figures, results
from surveyframe.session import checkpointed

LEVELS = {"type": fx.TYPES, "period": fx.PERIODS, "pair": fx.PAIRS, "guild": ["browse", "convert", "fault"]}
CELL = ["pair", "type", "guild"]
STAGE_CELL = ["life_stage", "type", "pair"]
SHANNON = ModelSpec([("type",), ("date_s",), ("period",), ("type", "date_s"), ("type", "period"), ("pair",)], LEVELS)
SLOPES = ModelSpec([("type",), ("date_s",), ("type", "date_s"), ("pair",)], LEVELS)


def _guilds(spark, sf):
    return checkpointed(clean.guild_counts(fx.tidy(spark, sf)))


def _totals(spark, sf):
    return checkpointed(clean.survey_totals(clean.guild_counts(fx.tidy(spark, sf))))


def _diversity(spark, sf):
    ids = ["survey_id", "site", "pair", "type", "period", "date", "date_num", "date_s"]
    return checkpointed(diversity(fx.tidy(spark, sf), ids))


def _stages(spark, sf):
    return checkpointed(fx.stage_counts_frame(spark, sf))


# --- closed forms and sums ----------------------------------------------------------------

_DESIGN = {
    "intercept": "1.0", "type=Artificial": "CASE WHEN type = 'Artificial' THEN 1.0 ELSE 0 END", "date_s": "date_s",
    "type=Artificial:date_s": "CASE WHEN type = 'Artificial' THEN date_s ELSE 0 END",
    "pair=pair_1": "CASE WHEN pair = 'pair_1' THEN 1.0 ELSE 0 END", "pair=pair_2": "CASE WHEN pair = 'pair_2' THEN 1.0 ELSE 0 END",
    "count": "count",
}
_PAIRS = [(i, j) for a, i in enumerate(_DESIGN) for j in list(_DESIGN)[a:]]


@query("gram_matrix", " UNION ALL ".join(
    f"SELECT '{i}' AS i, '{j}' AS j, {r(f'CAST(sum(({_DESIGN[i]}) * ({_DESIGN[j]})) AS DOUBLE)', 4)} AS value FROM gc" for i, j in _PAIRS), ["gc"], places=4)
def _(spark, sf):
    columns = dict(zip(SLOPES.names(), design_columns(SLOPES)))
    return gram(clean.guild_counts(fx.tidy(spark, sf)), {**columns, "count": F.col("count")})


@query("design_support")
def _(spark, sf):
    full = [("type",), ("pair",), ("date_s",), ("type", "pair"), ("type", "date_s"), ("pair", "date_s"), ("type", "pair", "date_s")]
    specs = {
        "type*pair*date + guild": ModelSpec([*full, ("guild",)], LEVELS),
        "type*(date + period) + pair + guild": ModelSpec([*SHANNON.terms, ("guild",)], LEVELS),
        "type*pair*date + period + guild": ModelSpec([*full, ("period",), ("guild",)], LEVELS),
    }
    return design_support(_guilds(spark, sf), specs)


_CELLS = """SELECT pair, type, guild, count(*) AS n, sum(count) AS total, ln(avg(count)) AS est, 1 / sum(count) AS v,
 sum(count) * ln(avg(count)) - sum(count) - sum(lgamma(count + 1)) AS ll FROM gc GROUP BY pair, type, guild"""


@query("poisson_cells", f"SELECT pair, type, guild, n, round(est, 6) AS estimate, round(sqrt(v), 6) AS se, round(ll, 4) AS loglik FROM ({_CELLS})", ["gc"], places=6)
def _(spark, sf):
    cells = glm.poisson_cells(clean.guild_counts(fx.tidy(spark, sf)), CELL, "count")
    return cells.withColumn("loglik", F.round("loglik", 4))


@query("trend_start", f"""
SELECT pair, type, guild, round(regr_intercept(ln(1 + count), date_s), 6) AS a, {r('regr_slope(ln(1 + count), date_s)')} AS b FROM gc GROUP BY pair, type, guild""", ["gc"])
def _(spark, sf):
    rows = glm.model_rows(clean.guild_counts(fx.tidy(spark, sf)), CELL, "count", "date_s")
    return glm.trend_start(rows, CELL)


def _aic_sql(name, by):
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT '{name}' AS model, sum(ll) AS loglik, count(*) AS n_par FROM (
      SELECT sum(count) * ln(avg(count)) - sum(count) - sum(lgamma(count + 1)) AS ll FROM gc {group})"""


@query("aic_table", "SELECT model, round(loglik, 3) AS loglik, n_par, round(-2 * loglik + 2 * n_par, 3) AS aic, "
       "round(-2 * loglik + 2 * n_par - min(-2 * loglik + 2 * n_par) OVER (), 3) AS delta_aic FROM ("
       + " UNION ALL ".join(_aic_sql(n, b) for n, b in (("type", "type"), ("pair_type", "pair, type"), ("cell", "pair, type, guild"))) + ")",
       ["gc"], places=3)
def _(spark, sf):
    models = {"type": ["type"], "pair_type": ["pair", "type"], "cell": CELL}
    return glm.poisson_aic(clean.guild_counts(fx.tidy(spark, sf)), "count", models)


@query("log_rmse", """
SELECT model, round(e, 6) AS log_rmse, CASE WHEN model = 'type' THEN 0.0 ELSE round(100 * (e - max(CASE WHEN model = 'type' THEN e END) OVER ()) / max(CASE WHEN model = 'type' THEN e END) OVER (), 6) END AS difference_pct
FROM (SELECT 'type' AS model, sqrt(avg(pow(ln(1 + count) - ln(1 + m), 2))) AS e FROM (SELECT count, avg(count) OVER (PARTITION BY type) AS m FROM gc)
      UNION ALL SELECT 'cell', sqrt(avg(pow(ln(1 + count) - ln(1 + m), 2))) FROM (SELECT count, avg(count) OVER (PARTITION BY pair, type, guild) AS m FROM gc))""", ["gc"])
def _(spark, sf):
    g = _guilds(spark, sf)
    parts = []
    for name, keys in (("type", ["type"]), ("cell", CELL)):
        rows = glm.fitted_rows(g, glm.closed_form(g, keys, "count")).withColumn("model", F.lit(name))
        parts.append(glm.log_rmse(rows, "count", "mean", ["model"]))
    return glm.compare_errors(parts[0].unionByName(parts[1]), "model", "type")


# --- fits ----------------------------------------------------------------------------------


def _guild_fit(spark, sf, family="nb2", **kw):
    g = _guilds(spark, sf)
    return g, glm.fit_cells(g, CELL, "count", "date_s", family, **kw)


def _survey_fit(spark, sf, family="nb2"):
    """Guild trends with a random intercept per survey and a zero share per guild."""
    g = _guilds(spark, sf)
    return g, mixed.fit_mixed(g, CELL, "count", "survey_id", "date_s", family, zi_by=["guild"])


@query("trend_fit")
def _(spark, sf):
    _, fit = _guild_fit(spark, sf)
    return fit.coef.select(*CELL, "a", "b", "phi", "v00", "v01", "v11", "loglik", "definite")


@query("trend_fit_nb1")
def _(spark, sf):
    totals = _totals(spark, sf)
    fit = glm.fit_cells(totals, ["pair", "type"], "count", "date_s", "nb1")
    return fit.coef.select("pair", "type", "a", "b", "phi", "v00", "v01", "v11", "load0", "load1", "loglik")


@query("family_comparison")
def _(spark, sf):
    totals = _totals(spark, sf)
    fits = {f: glm.fit_cells(totals, ["pair", "type"], "count", "date_s", f) for f in ("poisson", "nb1", "nb2")}
    return glm.compare(spark, fits)


@query("nb_dispersion")
def _(spark, sf):
    frame = _stages(spark, sf)
    fit = glm.closed_form(frame, STAGE_CELL, "stage_count")
    rows = glm.fitted_rows(frame, fit).groupBy("type", "mu", F.col("stage_count").cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    return glm.fit_dispersion(rows, "nb2", ["type"]).select("type", "phi", "loglik", "n")


@query("zi_em")
def _(spark, sf):
    _, fit = _guild_fit(spark, sf, zi_by=["guild"])
    return fit.coef.select(*CELL, "a", "b", "phi", "zi", "loglik")


@query("gaussian_groupvar")
def _(spark, sf):
    fit = fit_gaussian(_diversity(spark, sf), SHANNON, "shannon", "type")
    return fit.coefficients(spark)


@query("variance_comparison")
def _(spark, sf):
    div = _diversity(spark, sf)
    from surveyframe.session import literal_frame

    rows = []
    for name, by in (("constant", None), ("by_type", "type")):
        f = fit_gaussian(div, SHANNON, "shannon", by)
        rows.append((name, f.stats["loglik"], f.stats["n_par"], f.stats["aic"]))
    return literal_frame(spark, rows, "model string, loglik double, n_par bigint, aic double")


@query("mixed_intercept")
def _(spark, sf):
    return mixed.effect_table(_survey_fit(spark, sf)[1])


@query("mixed_errors")
def _(spark, sf):
    """Standard errors of all parameters: lines, dispersion, zero shares and the effects' deviation."""
    _, fit = _survey_fit(spark, sf)
    errors = fit.vcov.where(F.col("term_i") == F.col("term_j"))
    return errors.select("term_i", F.sqrt("value").alias("se"), F.lit(fit.stats["converged"]).alias("converged"), F.lit(fit.stats["at_boundary"]).alias("at_boundary"))


@query("mixed_crossed")
def _(spark, sf):
    fit = mixed.fit_crossed(_stages(spark, sf), STAGE_CELL, "stage_count", "survey_id", "species", "nb2", phi_by=["type"])
    return mixed.effect_table(fit)


@query("sandwich")
def _(spark, sf):
    g, fit = _guild_fit(spark, sf)
    return mixed.sandwich(g, fit, "survey_id", "count", "date_s")


@query("smooth_trend")
def _(spark, sf):
    g, fit = _guild_fit(spark, sf)
    coef, _ = smooth.fit_smooth(g, CELL, "date_s", "count", fit)
    return coef.select(*CELL, "b0", "b1", "b2", "b3", "lam", "edf", "n")


@query("predict_grid")
def _(spark, sf):
    g, fit = _survey_fit(spark, sf)
    return glm.predict(fit, g.select("survey_id", *CELL, "date_s"), "date_s")


@query("holdout_compare")
def _(spark, sf):
    g = _guilds(spark, sf)
    test = time_holdout(g, "site", "date", "survey_id").where("test").select("survey_id")
    models = {
        "line": mixed_line(CELL, "count", "survey_id", "date_s", zi_by=["guild"]),
        "smooth": mixed_smooth(CELL, "count", "survey_id", "date_s", zi_by=["guild"]),
    }
    return holdout(g, test, ["survey_id"], "count", models, "line")


def _species_fit(spark, sf):
    """One model per species, each with a random intercept per survey, fitted together."""
    frame = _stages(spark, sf)
    return frame, mixed.fit_mixed(frame, ["species", *STAGE_CELL], "stage_count", "survey_id", None, "nb2", model_by=["species"])


@query("fit_by_species")
def _(spark, sf):
    _, fit = _species_fit(spark, sf)
    per = fit.models.select(F.col("model").alias("species"), "sigma", "loglik")
    return fit.coef.join(per, "species").select("species", *STAGE_CELL, "a", "phi", F.sqrt("v00").alias("se"), "n", "total", "sigma", "loglik")


@query("fit_summary")
def _(spark, sf):
    totals = _totals(spark, sf)
    fits = {f: glm.fit_cells(totals, ["pair", "type"], "count", "date_s", f) for f in ("nb1", "nb2")}
    return glm.fit_summary(spark, fits)


@query("species_health")
def _(spark, sf):
    """Per species: convergence, the survey effect's deviation, and four residual tests in the same passes."""
    frame, fit = _species_fit(spark, sf)
    return D.health_table(frame, fit, ["survey_id", "species", "life_stage"], "stage_count")


@query("sparse_zeros", """
SELECT species, life_stage, type, pair, count(*) AS n, sum(stage_count) AS total, round(CASE WHEN sum(stage_count) > 0 THEN ln(avg(stage_count)) END, 6) AS estimate,
 round(CASE WHEN sum(stage_count) > 0 THEN 1 / sqrt(sum(stage_count)) END, 6) AS se, count(*) FILTER (WHERE stage_count = 0) AS zeros
FROM sframe GROUP BY species, life_stage, type, pair""", ["sframe"])
def _(spark, sf):
    """Cell means of the zero-filled counts without filling them: zeros are weights."""
    staged = fx.stored_stages(spark, sf)
    counts = staged.groupBy("survey_id", "type", "pair", "species", "life_stage").agg(F.sum("stage_count").alias("stage_count"))
    levels = staged.select("species").distinct().withColumn("life_stage", F.explode(F.array(F.lit("juvenile"), F.lit("adult"))))
    rows = checkpointed(weighted_counts(counts, staged.select("survey_id", "type", "pair").distinct(), ["type", "pair"], ["species", "life_stage"], "stage_count", categories=levels))
    cell = ["species", *STAGE_CELL]
    zeros = rows.groupBy(*cell).agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).cast("bigint").alias("zeros"), F.sum(F.col("n") * F.col("y")).cast("bigint").alias("total"))
    return glm.poisson_cells(rows, cell, "y", weight="n").drop("loglik").join(zeros, cell)


@query("coef_table")
def _(spark, sf):
    return results.coef_table(fit_gaussian(_diversity(spark, sf), SHANNON, "shannon", "type").coefficients(spark))


# --- diagnostics -----------------------------------------------------------------------------


@query("pit_residuals")
def _(spark, sf):
    g, fit = _guild_fit(spark, sf, zi_by=["guild"])
    rows = glm.fitted_rows(g, fit, x="date_s")
    return D.pit_residuals(rows, "nb2", ["survey_id", "guild"], "count").select("survey_id", "guild", "count", "mu", "u")


@query("outlier_test")
def _(spark, sf):
    totals = _totals(spark, sf)
    fit = glm.fit_cells(totals, ["pair", "type"], "count", "date_s", "nb1")
    residuals = D.pit_residuals(glm.fitted_rows(totals, fit, x="date_s"), "nb1", ["survey_id"], "count")
    return D.outlier_test(residuals)


@query("residual_autocorrelation")
def _(spark, sf):
    g, fit = _guild_fit(spark, sf)
    residuals = D.pit_residuals(glm.fitted_rows(g, fit, x="date_s"), "nb2", ["survey_id", "guild"], "count")
    return D.temporal_autocorrelation(residuals, ["site", "guild"], "date_num", "u")


@query("ks_uniform", """
SELECT round(max(greatest(upto / CAST(n AS DOUBLE) - u, u - below / CAST(n AS DOUBLE))), 6) AS statistic, max(n) AS n FROM (
  SELECT u, count(*) OVER (ORDER BY u) AS upto, count(*) OVER (ORDER BY u) - count(*) OVER (PARTITION BY u) AS below, count(*) OVER () AS n
  FROM (SELECT (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS u FROM orders))""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_totalprice")
    ends = o.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    u = (F.col("o_totalprice") - F.col("low")) / (F.col("high") - F.col("low"))
    return D.ks_uniform(attach_scalars(o, ends).select(u.alias("u"))).drop("p_value")


_SMU = "(SELECT *, avg(stage_count) OVER (PARTITION BY species, life_stage, type) AS mu FROM sframe)"


@query("pearson_dispersion", f"""
SELECT round(sum(pow(stage_count - mu, 2) / mu), 4) AS chisq, count(*) - 20 AS df, round(sum(pow(stage_count - mu, 2) / mu) / (count(*) - 20), 4) AS dispersion
FROM {_SMU}""", ["sframe"], places=4)
def _(spark, sf):
    frame = _stages(spark, sf)
    fit = glm.closed_form(frame, ["species", "life_stage", "type"], "stage_count")
    return D.pearson_dispersion(glm.fitted_rows(frame, fit), "poisson", "stage_count", 20).drop("p_value")


@query("zero_test", f"""
SELECT observed, round(expected, 4) AS expected, round(v, 4) AS variance, round((observed - expected) / sqrt(v), 4) AS z FROM (
  SELECT count(*) FILTER (WHERE stage_count = 0) AS observed, sum(exp(-mu)) AS expected, sum(exp(-mu) * (1 - exp(-mu))) AS v FROM {_SMU})""", ["sframe"], places=4)
def _(spark, sf):
    frame = _stages(spark, sf)
    fit = glm.closed_form(frame, ["species", "life_stage", "type"], "stage_count")
    return D.zero_test(glm.fitted_rows(frame, fit), "poisson", "stage_count").drop("p_value")


@query("durbin_watson", """
SELECT site, guild, count(*) AS n, CASE WHEN count(*) > 2 AND sum(count * count) - sum(count) * sum(count) / count(*) > 1e-12
  THEN round(sum(d * d) / (sum(count * count) - sum(count) * sum(count) / count(*)), 6) END AS dw
FROM (SELECT site, guild, CAST(count AS DOUBLE) AS count, CAST(count - lag(count) OVER (PARTITION BY site, guild ORDER BY date) AS DOUBLE) AS d FROM gc) GROUP BY site, guild""", ["gc"])
def _(spark, sf):
    rows = clean.guild_counts(fx.tidy(spark, sf)).withColumn("e", F.col("count").cast("double"))
    return D.durbin_watson(rows, ["site", "guild"], "date_num", "e", width=7.0).drop("p_value")


@query("holm", """
SELECT pair, site, round(p, 9) AS p, round(least(1.0, max((m - k) * p) OVER (PARTITION BY pair ORDER BY p)), 9) AS p_adjusted FROM (
  SELECT *, count(*) OVER (PARTITION BY pair) AS m, rank() OVER (PARTITION BY pair ORDER BY p) - 1 AS k
  FROM (SELECT pair, site, 1.0 / (1.0 + CAST(sum(count) AS DOUBLE)) AS p FROM ord GROUP BY pair, site))""", ["ord"], places=9)
def _(spark, sf):
    p = F.lit(1.0) / (F.lit(1.0) + F.sum("count").cast("double"))
    return C.holm(fx.ord_surveys(spark, sf).groupBy("pair", "site").agg(p.alias("p")), "p", ["pair"])


# --- contrasts -------------------------------------------------------------------------------

_EST = "round({e}, 6) AS estimate, round(sqrt({v}), 6) AS se, round(({e}) - 1.959963984540054 * sqrt({v}), 6) AS lower, round(({e}) + 1.959963984540054 * sqrt({v}), 6) AS upper, round(({e}) / sqrt({v}), 6) AS statistic".format
_OUT = ["estimate", "se", "lower", "upper", "statistic"]


@query("contrast_linear", f"""
SELECT 'mean' AS kind, type AS name, {_EST(e='sum(est) / count(*)', v='sum(v) / (count(*) * count(*))')} FROM ({_CELLS}) GROUP BY type
UNION ALL SELECT 'difference', pair, {_EST(e="(sum(CASE WHEN type = 'Artificial' THEN est ELSE -est END)) * 2 / count(*)", v='sum(v) * 4 / (count(*) * count(*))')} FROM ({_CELLS}) GROUP BY pair""", ["gc"])
def _(spark, sf):
    fit = glm.closed_form(clean.guild_counts(fx.tidy(spark, sf)), CELL, "count")
    coef, vcov = glm.coefficients(fit), glm.covariance(fit)
    mean = C.contrast(coef, vcov, C.cell_weights(coef, "intercept", ["type"]), ["type"])
    diff = C.contrast(coef, vcov, C.cell_weights(coef, "intercept", ["pair"], {"type": ("Natural", "Artificial")}), ["pair"])
    return mean.select(F.lit("mean").alias("kind"), F.col("type").alias("name"), *_OUT).unionByName(
        diff.select(F.lit("difference").alias("kind"), F.col("pair").alias("name"), *_OUT)
    )


STEP = {"type": ("Natural", "Artificial")}
GROWTH = {"life_stage": ("juvenile", "adult")}
SLOPE_TABLES = {
    "by_type": results.ContrastTable(["type"], label=True),
    "types_apart": results.ContrastTable([], STEP),
    "by_pair_type": results.ContrastTable(["pair", "type"], label=True),
    "types_apart_by_pair": results.ContrastTable(["pair"], STEP),
    "by_cell": results.ContrastTable(["pair", "type", "guild"], adjust=True, label=True),
    "types_apart_by_guild": results.ContrastTable(["pair", "guild"], STEP, adjust=True),
}
TYPE_RATIO = results.ContrastTable(["life_stage", "pair"], STEP, ratio=True)
STAGE_RATIO = results.ContrastTable(["type", "pair"], GROWTH, ratio=True)
STAGE_BY_TYPE = results.ContrastTable(["pair"], {**GROWTH, **STEP}, ratio=True)


def _stage_ratio(fit, table, model_by=()):
    return results.contrast_tables(fit, "intercept", {"x": table}, model_by)["x"]


_SCELL = "SELECT life_stage, type, pair, ln(avg(stage_count)) AS est, 1 / sum(stage_count) AS v FROM sframe GROUP BY life_stage, type, pair"


_GAP = "(SELECT pair, type, guild, CASE WHEN pair = 'pair_0' AND type = 'Artificial' AND guild = 'browse' THEN 0 ELSE count END AS count FROM gc WHERE NOT (pair = 'pair_1' AND type = 'Artificial'))"


@query("contrast_gaps", f"""
SELECT pair, CASE WHEN pair = 'pair_2' THEN round(e, 6) END AS estimate, CASE WHEN pair = 'pair_2' THEN round(sqrt(s), 6) END AS se FROM (
  SELECT pair, sum(CASE WHEN type = 'Artificial' THEN est ELSE -est END) / count(DISTINCT guild) AS e, sum(v) / (count(DISTINCT guild) * count(DISTINCT guild)) AS s FROM (
    SELECT pair, type, guild, CASE WHEN sum(count) > 0 THEN ln(avg(count)) END AS est, CASE WHEN sum(count) > 0 THEN 1.0 / sum(count) END AS v FROM {_GAP} GROUP BY ALL) GROUP BY pair)""", ["gc"])
def _(spark, sf):
    """One cell all zero (pair_0) and one side absent (pair_1): both contrasts are unknown."""
    g = clean.guild_counts(fx.tidy(spark, sf)).where(~((F.col("pair") == "pair_1") & (F.col("type") == "Artificial")))
    zero = (F.col("pair") == "pair_0") & (F.col("type") == "Artificial") & (F.col("guild") == "browse")
    fit = glm.closed_form(g.withColumn("count", F.when(zero, 0).otherwise(F.col("count"))), CELL, "count")
    coef, vcov = glm.coefficients(fit), glm.covariance(fit)
    return C.contrast(coef, vcov, C.cell_weights(coef, "intercept", ["pair"], STEP), ["pair"]).select("pair", "estimate", "se")


@query("interaction_contrast", f"""
SELECT pair, round(e, 6) AS estimate, round(sqrt(s), 6) AS se, round(exp(e), 6) AS ratio FROM (
  SELECT pair, sum(CASE WHEN (life_stage = 'adult') = (type = 'Artificial') THEN est ELSE -est END) AS e, sum(v) AS s FROM ({_SCELL}) GROUP BY pair)""", ["sframe"])
def _(spark, sf):
    fit = glm.closed_form(fx.stage_counts_frame(spark, sf), STAGE_CELL, "stage_count")
    return _stage_ratio(fit, STAGE_BY_TYPE).select("pair", "estimate", "se", "ratio")


@query("ratio_contrast", f"""
SELECT life_stage, pair, round(exp(e), 6) AS ratio, round(exp(e - 1.959963984540054 * sqrt(s)), 6) AS ratio_lower, round(exp(e + 1.959963984540054 * sqrt(s)), 6) AS ratio_upper FROM (
  SELECT life_stage, pair, sum(CASE WHEN type = 'Artificial' THEN est ELSE -est END) AS e, sum(v) AS s FROM ({_SCELL}) GROUP BY life_stage, pair)""", ["sframe"])
def _(spark, sf):
    fit = glm.closed_form(fx.stage_counts_frame(spark, sf), STAGE_CELL, "stage_count")
    return _stage_ratio(fit, TYPE_RATIO).select("life_stage", "pair", "ratio", "ratio_lower", "ratio_upper")


@query("slope_tables")
def _(spark, sf):
    _, fit = _survey_fit(spark, sf)
    parts = []
    for name, t in results.contrast_tables(fit, "slope", SLOPE_TABLES).items():
        keep = [c for c in ("pair", "type", "guild", *_OUT, "p_value", "p_adjusted", "trajectory") if c in t.columns]
        parts.append(t.select(F.lit(name).alias("result"), *keep))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query("marginal_means")
def _(spark, sf):
    """Means per type and period, their interaction, and the types' difference at the first and last date."""
    div = _diversity(spark, sf)
    fit = fit_gaussian(div, SHANNON, "shannon", "type")
    ends = div.agg(F.min("date_s").alias("low"), F.max("date_s").alias("high"))
    one = lambda label, x: F.struct(F.lit(label).alias("label"), x.cast("double").alias("date_s"))
    ends = ends.select(F.inline(F.array(one("Start", F.col("low")), one("End", F.col("high")))))
    middle = spark.range(1).select(F.lit("at 0").alias("label"), F.lit(0.0).alias("date_s"))
    step = {"type": ("Natural", "Artificial")}
    periods = reference_grid(middle, SHANNON)
    times = reference_grid(ends, SHANNON, {"period": ["Post"]})
    named = lambda w, *c: w.select(F.concat_ws(" ", *c).alias("name"), "term", "weight")
    weights = named(mean_weights(periods, SHANNON, ["type", "period"]), F.col("type"), F.col("period"))
    weights = weights.unionByName(named(mean_weights(periods, SHANNON, [], {**step, "period": ("Pre", "Post")}), F.lit("type x period")))
    weights = weights.unionByName(named(mean_weights(times, SHANNON, ["label", "type"]), F.col("label"), F.col("type")))
    weights = weights.unionByName(named(mean_weights(times, SHANNON, ["label"], step), F.col("label"), F.lit("difference")))
    return C.contrast(fit.coefficients(spark), fit.covariance(spark), weights, ["name"]).select("name", *_OUT, "df", "p_value")


@query("wald_terms")
def _(spark, sf):
    _, fit = _species_fit(spark, sf)
    tests = C.term_tests(spark, {"life_stage": ["adult", "juvenile"], "type": fx.TYPES, "pair": fx.PAIRS})
    return C.wald(glm.coefficients(fit, ["species"]), glm.covariance(fit, ["species"]), tests)


# --- figure frames ---------------------------------------------------------------------------


@query("fig_trajectory")
def _(spark, sf):
    g, fit = _survey_fit(spark, sf)
    return figures.trajectory_frame(fit, g, CELL, figures.time_line(g)).select(*CELL, "i", "day", "conditional_mean", "lower", "upper")


@query("fig_diversity")
def _(spark, sf):
    div = _diversity(spark, sf)
    fit = fit_gaussian(div, SHANNON, "shannon", "type")
    return figures.diversity_frame(fit, div, fx.deployments(spark), figures.time_line(div))


@query("fig_balance", f"""
SELECT pair, round(max(CASE WHEN type = 'Natural' THEN b END), 6) AS "log2_ratio_Natural", round(max(CASE WHEN type = 'Artificial' THEN b END), 6) AS "log2_ratio_Artificial" FROM (
  SELECT type, pair, sum(CASE WHEN life_stage = 'juvenile' THEN est ELSE -est END) / ln(2) AS b FROM ({_SCELL}) GROUP BY type, pair) GROUP BY pair""", ["sframe"])
def _(spark, sf):
    fit = glm.closed_form(fx.stage_counts_frame(spark, sf), STAGE_CELL, "stage_count")
    return figures.balance_segments(figures.balance_frame(_stage_ratio(fit, STAGE_RATIO)), fx.TYPES)


@query("fig_species")
def _(spark, sf):
    _, fit = _species_fit(spark, sf)
    by = ["species", "type", "pair"]
    predicted = results.predicted_stages(fit, by)
    shares = results.stage_proportions(predicted, by, "conditional_mean")
    return figures.species_frame(shares, _stage_ratio(fit, STAGE_RATIO, ["species"]), _stage_ratio(fit, STAGE_BY_TYPE, ["species"]))
