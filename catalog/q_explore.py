"""Effort, exploration, diversity and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog.views  # noqa: F401
from catalog.registry import query, r
from catalog import fixtures as fx
from surveyframe.operators import checks, effort, explore
from surveyframe.operators.diversity import diversity, diversity_summary
from surveyframe.plans import clean, figures
from surveyframe.session import checkpointed

D = "CAST({0} AS VARCHAR) AS {0}".format


def _header(spark, sf):
    return effort.survey_header(
        fx.tidy(spark, sf), ["survey_id", "site", "pair", "type", "period", "date", "n_observer_rows", "n_observers", "researchers"]
    )


def _surveys(spark, sf):
    return fx.tidy(spark, sf).select("survey_id", "site", "pair", "type", "period", "date", "date_num", "date_s", "t_since").distinct()


def _guilds(spark, sf):
    return clean.guild_counts(fx.tidy(spark, sf))


def _totals(spark, sf):
    return clean.survey_totals(_guilds(spark, sf))


_EFFORT = "count(DISTINCT survey_id) AS n_surveys, CAST(min(date) AS VARCHAR) AS first_survey, CAST(max(date) AS VARCHAR) AS last_survey"


@query("survey_header", f"SELECT survey_id, pair, type, period, {D('date')}, n_observer_rows, n_observers, researchers FROM ohdr", ["ohdr"])
def _(spark, sf):
    return _header(spark, sf).drop("site")


@query("effort", f"SELECT pair, type, period, {_EFFORT} FROM ohdr GROUP BY pair, type, period", ["ohdr"])
def _(spark, sf):
    return effort.effort(_header(spark, sf), ["pair", "type", "period"])


@query("effort_site", f"SELECT site, pair, type, period, {_EFFORT} FROM ohdr GROUP BY site, pair, type, period", ["ohdr"])
def _(spark, sf):
    return effort.effort(_header(spark, sf), ["site", "pair", "type", "period"])


@query("effort_sizes", f"SELECT site, pair, type, {_EFFORT} FROM stages GROUP BY site, pair, type", ["stages"])
def _(spark, sf):
    header = effort.survey_header(fx.stages(spark, sf), ["survey_id", "site", "pair", "type", "date"])
    return effort.effort(header, ["site", "pair", "type"])


@query("effort_pre", "SELECT count(DISTINCT survey_id) AS n_surveys FROM ohdr WHERE period = 'Pre'", ["ohdr"])
def _(spark, sf):
    table = effort.effort(_header(spark, sf), ["pair", "type", "period"])
    return table.where(F.col("period") == "Pre").agg(F.sum("n_surveys").alias("n_surveys"))


_BY_TYPE = "count(*) FILTER (WHERE type = 'Natural') AS \"Natural\", count(*) FILTER (WHERE type = 'Artificial') AS \"Artificial\""


@query("effort_year", f"SELECT CAST(year(date) AS VARCHAR) AS year, {_BY_TYPE} FROM ord GROUP BY 1", ["ord"])
def _(spark, sf):
    return effort.effort_by_type(effort.with_year(fx.ord_surveys(spark, sf)), ["year"], fx.TYPES)


@query("effort_one_year", f"SELECT pair, {_BY_TYPE} FROM ord WHERE year(date) = 1998 GROUP BY pair", ["ord"])
def _(spark, sf):
    rows = effort.with_year(fx.ord_surveys(spark, sf)).where(F.col("year") == "1998")
    return effort.effort_by_type(rows, ["pair"], fx.TYPES)


_SUMMARY = """count(DISTINCT survey_id) AS n_surveys, count(DISTINCT site) AS n_sites, count(DISTINCT pair) AS n_pairs,
 count(DISTINCT species) AS n_species, CAST(min(date) AS VARCHAR) AS first_survey, CAST(max(date) AS VARCHAR) AS last_survey,
 round(count(DISTINCT survey_id) * 8 / 60.0, 6) AS observation_hours"""


@query("dataset_summary", f"""SELECT 'counts' AS source, {_SUMMARY}, CAST(sum(count) AS BIGINT) AS total_individuals FROM tidy
UNION ALL BY NAME SELECT 'sizes' AS source, {_SUMMARY}, CAST(sum(stage_count) AS BIGINT) AS total_individuals FROM stages""", ["tidy", "stages"])
def _(spark, sf):
    counts = effort.dataset_summary(fx.tidy(spark, sf), "count").withColumn("source", F.lit("counts"))
    sizes = effort.dataset_summary(fx.stages(spark, sf), "stage_count").withColumn("source", F.lit("sizes"))
    return counts.unionByName(sizes)


@query("observer_summary", """
SELECT count(DISTINCT survey_id) AS n_surveys, count(*) FILTER (WHERE n_observer_rows > 1) AS multiple_row_surveys,
 count(*) FILTER (WHERE n_observers > 1) AS multiple_observer_surveys,
 count(*) FILTER (WHERE n_observer_rows > n_observers) AS repeated_observer_surveys,
 max(n_observer_rows) AS max_observer_rows, max(n_observers) AS max_observers,
 CAST(median(n_observer_rows) AS DOUBLE) AS median_observer_rows, CAST(median(n_observers) AS DOUBLE) AS median_observers FROM ohdr""", ["ohdr"])
def _(spark, sf):
    return effort.observer_summary(_header(spark, sf))


@query("guild_totals", """
SELECT pair, type, period, guild, count(DISTINCT survey_id) AS n_surveys, CAST(sum(count) AS BIGINT) AS total_individuals,
 round(avg(count), 6) AS mean_count_per_survey, round(stddev_samp(count), 6) AS sd_count_per_survey FROM gc GROUP BY pair, type, period, guild""", ["gc"])
def _(spark, sf):
    return effort.group_totals(_guilds(spark, sf), ["pair", "type", "period", "guild"], "count")


@query("stage_totals", """
SELECT pair, type, life_stage, count(DISTINCT survey_id) AS n_surveys, CAST(sum(stage_count) AS BIGINT) AS total_individuals,
 round(avg(stage_count), 6) AS mean_count_per_survey, round(stddev_samp(stage_count), 6) AS sd_count_per_survey
FROM (SELECT survey_id, pair, type, life_stage, sum(stage_count) AS stage_count FROM stages GROUP BY ALL) GROUP BY pair, type, life_stage""", ["stages"])
def _(spark, sf):
    return effort.group_totals(effort.stage_by_survey(fx.stages(spark, sf)), ["pair", "type", "life_stage"], "stage_count")


@query("species_stage_totals", """
SELECT species, sci_name, guild, life_stage, count(DISTINCT survey_id) AS n_surveys, CAST(sum(stage_count) AS BIGINT) AS total_individuals
FROM stages GROUP BY ALL ORDER BY species, life_stage""", ["stages"])
def _(spark, sf):
    return effort.species_stage_totals(fx.stages(spark, sf)).orderBy("species", "life_stage")


@query("count_distribution", """
SELECT pair, type, guild, count(*) AS n, round(avg(count), 6) AS mean_count, round(var_samp(count), 6) AS variance,
 round(var_samp(count) / nullif(avg(count), 0), 6) AS variance_to_mean, round(median(count), 6) AS median_count, max(count) AS maximum_count,
 round(avg(CASE WHEN count = 0 THEN 100.0 ELSE 0.0 END), 6) AS zero_percent FROM gc GROUP BY pair, type, guild""", ["gc"])
def _(spark, sf):
    return explore.count_distribution(_guilds(spark, sf), ["pair", "type", "guild"])


@query("variance_groups", """
SELECT pair, type, guild, count(*) AS n, round(var_samp(count), 6) AS raw_variance, round(var_samp(ln(1 + count)), 6) AS log_variance FROM gc GROUP BY pair, type, guild
UNION ALL SELECT pair, type, NULL, count(*), round(var_samp(count), 6), round(var_samp(ln(1 + count)), 6) FROM tot GROUP BY pair, type""", ["gc", "tot"])
def _(spark, sf):
    by_guild = explore.variance_groups(_guilds(spark, sf), ["pair", "type", "guild"])
    by_type = explore.variance_groups(_totals(spark, sf), ["pair", "type"])
    return by_guild.unionByName(by_type, allowMissingColumns=True)


_BF = """SELECT '{name}' AS response, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_value, k - 1 AS df1, n - k AS df2, n FROM (
  SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(ss - s * s / n) AS ssw, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb FROM (
    SELECT g, count(*) AS n, sum(d) AS s, sum(d * d) AS ss FROM (
      SELECT {by} AS g, abs({y} - median({y}) OVER (PARTITION BY {by})) AS d FROM {src}) GROUP BY g))"""


@query("brown_forsythe", _BF.format(name="log_total", by="pair || type", y="ln(1 + count)", src="tot")
       + " UNION ALL " + _BF.format(name="log_guild", by="pair || type || guild", y="ln(1 + count)", src="gc")
       + " UNION ALL " + _BF.format(name="shannon", by="pair || type", y="shannon", src="divs"), ["tot", "gc", "divs"])
def _(spark, sf):
    log = F.log1p(F.col("count"))
    parts = {
        "log_total": explore.brown_forsythe(_totals(spark, sf).withColumn("y", log), ["pair", "type"], "y"),
        "log_guild": explore.brown_forsythe(_guilds(spark, sf).withColumn("y", log), ["pair", "type", "guild"], "y"),
        "shannon": explore.brown_forsythe(_diversity(spark, sf).withColumnRenamed("shannon", "y"), ["pair", "type"], "y"),
    }
    frames = [df.withColumn("response", F.lit(name)).drop("p_value") for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("brown_forsythe_p")
def _(spark, sf):
    return explore.brown_forsythe(_totals(spark, sf).withColumn("y", F.log1p(F.col("count"))), ["pair", "type"], "y")


@query("temporal_support", """
SELECT pair, type, yr, count(*) AS n_surveys, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
 CAST(max(date) - min(date) AS BIGINT) AS date_span_days, CAST(median(gap) AS DOUBLE) AS median_gap_days, CAST(max(gap) AS BIGINT) AS maximum_gap_days
FROM (SELECT *, year(date) AS yr, date - lag(date) OVER (PARTITION BY pair, type, year(date) ORDER BY date) AS gap FROM ord) GROUP BY pair, type, yr""", ["ord"])
def _(spark, sf):
    rows = fx.ord_surveys(spark, sf).withColumn("yr", F.year("date"))
    return explore.temporal_support(rows, ["pair", "type", "yr"])


@query("temporal_support_z", f"""
SELECT pair, type, period, count(*) AS n_surveys, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
 CAST(max(date) - min(date) AS BIGINT) AS date_span_days, CAST(median(gap) AS DOUBLE) AS median_gap_days, CAST(max(gap) AS BIGINT) AS maximum_gap_days,
 {r('min(date_s)')} AS minimum_date_s, {r('max(date_s)')} AS maximum_date_s
FROM (SELECT *, date - lag(date) OVER (PARTITION BY pair, type, period ORDER BY date) AS gap FROM hdr) GROUP BY pair, type, period""", ["hdr"])
def _(spark, sf):
    return explore.temporal_support(_surveys(spark, sf), ["pair", "type", "period"])


@query("collinearity", f"""
SELECT pair, count(*) AS n_surveys, {r('corr(date_s, t_since)')} AS cor_date_t_since,
 CASE WHEN count(DISTINCT period) > 1 THEN {r("corr(date_s, CASE WHEN period = 'Post' THEN 1.0 ELSE 0.0 END)")} END AS cor_date_period
FROM hdr GROUP BY pair""", ["hdr"])
def _(spark, sf):
    post = F.when(F.col("period") == "Post", 1.0).otherwise(0.0)
    return explore.collinearity(_surveys(spark, sf), ["pair"], "date_s", {"cor_date_t_since": F.col("t_since"), "cor_date_period": post})


@query("extremes", """
SELECT survey_id, pair, type, CAST(date AS VARCHAR) AS date, count, round(q1, 6) AS q1, round(q3, 6) AS q3
FROM (SELECT *, quantile_cont(count, 0.25) OVER (PARTITION BY pair, type) AS q1, quantile_cont(count, 0.75) OVER (PARTITION BY pair, type) AS q3 FROM tot)
WHERE count > q3 + 3 * (q3 - q1)""", ["tot"])
def _(spark, sf):
    return explore.extremes(checkpointed(_totals(spark, sf)), ["pair", "type"]).select("survey_id", "pair", "type", "date", "count", "q1", "q3")


def _level_sql(name, src):
    return (f"SELECT '{name}' AS grouping_factor, count(*) AS levels, min(n) AS minimum_n, CAST(median(n) AS DOUBLE) AS median_n, max(n) AS maximum_n "
            f"FROM (SELECT {name}, count(*) AS n FROM {src} GROUP BY {name})")


@query("level_support", " UNION ALL ".join([_level_sql("site", "hdr"), _level_sql("pair", "hdr"), _level_sql("survey_id", "gc")]), ["hdr", "gc"])
def _(spark, sf):
    surveys = _surveys(spark, sf)
    return explore.level_support({"site": surveys, "pair": surveys, "survey_id": _guilds(spark, sf)})


@query("weak_cells", """
SELECT site, period, species, count(*) AS n FROM tidy WHERE NOT (pair = 'pair_2' AND period = 'Pre')
GROUP BY site, period, species HAVING count(*) < 5""", ["tidy"])
def _(spark, sf):
    empty = (F.col("pair") == "pair_2") & (F.col("period") == "Pre")
    return explore.weak_cells(fx.tidy(spark, sf), ["site", "period", "species"], 5, empty)


def _diversity(spark, sf):
    return diversity(fx.tidy(spark, sf), ["survey_id", "site", "pair", "type", "period", "date", "date_num", "date_s"])


@query("diversity", f"SELECT survey_id, total_abundance, richness, {r('shannon')} AS shannon FROM divs", ["divs"])
def _(spark, sf):
    return diversity(fx.tidy(spark, sf), ["survey_id"])


@query("diversity_summary", f"""
SELECT pair, type, period, count(*) AS n, round(avg(shannon), 6) AS mean_shannon, round(var_samp(shannon), 6) AS variance_shannon,
 {r('min(shannon)')} AS minimum_shannon, round(max(shannon), 6) AS maximum_shannon,
 count(*) FILTER (WHERE total_abundance = 0) AS zero_abundance_surveys FROM divs GROUP BY pair, type, period""", ["divs"])
def _(spark, sf):
    return diversity_summary(_diversity(spark, sf), ["pair", "type", "period"])


@query("spearman", """
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
 SELECT rank() OVER (ORDER BY richness) + (count(*) OVER (PARTITION BY richness) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY total_abundance) + (count(*) OVER (PARTITION BY total_abundance) - 1) / 2.0 AS ry FROM divs)""", ["divs"])
def _(spark, sf):
    return explore.spearman(_diversity(spark, sf), "richness", "total_abundance")


@query("size_support", """
SELECT pair, type, count(DISTINCT survey_id) AS n_surveys, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
 count(DISTINCT CASE WHEN visibility_m IS NULL THEN survey_id END) AS missing_visibility_surveys,
 round(100.0 * count(DISTINCT CASE WHEN visibility_m IS NULL THEN survey_id END) / count(DISTINCT survey_id), 6) AS missing_visibility_percent
FROM stages GROUP BY pair, type""", ["stages"])
def _(spark, sf):
    return explore.size_support(fx.stages(spark, sf))


@query("species_support", """
SELECT *, occupied_types >= 2 AND occupied_surveys >= 12 AND occupied_dates >= 6 AND juvenile_surveys >= 4 AND adult_surveys >= 4 AS descriptive_support FROM (
 SELECT species, sci_name, guild, count(DISTINCT survey_id) AS occupied_surveys, count(DISTINCT date) AS occupied_dates, count(DISTINCT type) AS occupied_types,
  CAST(coalesce(sum(stage_count) FILTER (WHERE life_stage = 'juvenile'), 0) AS BIGINT) AS juvenile_individuals,
  CAST(coalesce(sum(stage_count) FILTER (WHERE life_stage = 'adult'), 0) AS BIGINT) AS adult_individuals,
  count(DISTINCT survey_id) FILTER (WHERE life_stage = 'juvenile') AS juvenile_surveys,
  count(DISTINCT survey_id) FILTER (WHERE life_stage = 'adult') AS adult_surveys FROM stages GROUP BY species, sci_name, guild)""", ["stages"])
def _(spark, sf):
    return explore.species_support(fx.stages(spark, sf), fx.SUPPORT)


@query("box_stats", """
SELECT pair, type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) FILTER (WHERE NOT inside) AS n_outside,
 min(CASE WHEN inside THEN count END) AS whisker_low, max(CASE WHEN inside THEN count END) AS whisker_high
FROM (SELECT *, count >= q1 - 1.5 * (q3 - q1) AND count <= q3 + 1.5 * (q3 - q1) AS inside FROM tot JOIN
  (SELECT pair, type, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.5) AS median, quantile_cont(count, 0.75) AS q3 FROM tot GROUP BY pair, type) USING (pair, type))
GROUP BY ALL""", ["tot"])
def _(spark, sf):
    return explore.box_stats(checkpointed(_totals(spark, sf)), ["pair", "type"], "count")


@query("timeline", f"""
SELECT pair, site, type, {D('date')}, 'survey' AS kind FROM hdr
UNION ALL SELECT pair, NULL, NULL, '2024-01-15', 'event' FROM (SELECT DISTINCT pair FROM hdr WHERE pair <> 'pair_2')""", ["hdr"])
def _(spark, sf):
    return figures.timeline_frame(_surveys(spark, sf), fx.deployments(spark))


@query("check_survey_key", """
SELECT site AS survey_id, count(*) AS n FROM (SELECT DISTINCT site, date FROM ord) GROUP BY site HAVING count(*) > 1""", ["ord"])
def _(spark, sf):
    rows = fx.ord_surveys(spark, sf).withColumns({"survey_id": F.col("site"), "period": F.lit("Post")})
    return checks.multiple_metadata(rows)


@query("check_guild", "SELECT species, count(*) AS n FROM obs WHERE guild = 'fault' GROUP BY species", ["obs"])
def _(spark, sf):
    known = fx.guilds(spark).where(F.col("guild") != "fault")
    return checks.missing_guilds(fx.obs(spark, sf).join(known, "species", "left"))


@query("check_counts", """
SELECT survey_id, species, raw AS count FROM (SELECT site || '_' || CAST(date AS VARCHAR) AS survey_id, species, raw FROM obs)
WHERE raw IS NULL OR raw < 0 OR raw <> floor(raw)""", ["obs"])
def _(spark, sf):
    from surveyframe.functions.scalars import survey_key

    rows = fx.obs(spark, sf).select(survey_key("site", "date").alias("survey_id"), "species", "count")
    return checks.invalid_counts(rows)


@query("check_dupes", """
SELECT site || '_' || CAST(date AS VARCHAR) AS survey_id, species, count(*) AS n_rows FROM obs GROUP BY ALL HAVING count(*) > 1""", ["obs"])
def _(spark, sf):
    from surveyframe.functions.scalars import survey_key

    rows = fx.obs(spark, sf).select(survey_key("site", "date").alias("survey_id"), "species")
    return checks.duplicate_cells(rows)


_REPORT = {
    "survey_key": "SELECT survey_id FROM (SELECT DISTINCT survey_id, site, pair, type, period, date FROM tidy) GROUP BY survey_id HAVING count(*) > 1",
    "guild": "SELECT species FROM tidy WHERE guild IS NULL GROUP BY species",
    "counts": "SELECT 1 FROM tidy WHERE count IS NULL OR count < 0",
    "duplicates": "SELECT survey_id FROM tidy GROUP BY survey_id, species HAVING count(*) > 1",
    "missing_cells": "SELECT survey_id, species FROM (SELECT DISTINCT survey_id FROM tidy) CROSS JOIN (SELECT DISTINCT species FROM tidy) EXCEPT SELECT survey_id, species FROM tidy",
    "reconcile": "SELECT 1 FROM (SELECT survey_id, guild, sum(count) AS s FROM tidy GROUP BY ALL) a FULL JOIN gc b USING (survey_id, guild) WHERE s IS NULL OR count IS NULL OR s <> count",
    "observers": "SELECT DISTINCT survey_id, n_observer_rows, n_observers, researchers FROM tidy WHERE n_observer_rows > n_observers",
    "overdispersion": "SELECT 1 FROM gc GROUP BY pair, type, guild HAVING var_samp(count) / nullif(avg(count), 0) > 1.5",
    "zeros": "SELECT 1 FROM gc GROUP BY pair, type, guild HAVING avg(CASE WHEN count = 0 THEN 100.0 ELSE 0 END) >= 50",
    "extremes": "SELECT 1 FROM (SELECT *, quantile_cont(count, 0.25) OVER (PARTITION BY pair, type) AS q1, quantile_cont(count, 0.75) OVER (PARTITION BY pair, type) AS q3 FROM tot) WHERE count > q3 + 3 * (q3 - q1)",
    "weak_cells": "SELECT 1 FROM gc GROUP BY pair, type, period, guild HAVING count(*) < 5",
}


@query("check_report", " UNION ALL ".join(
    f"SELECT '{k}' AS \"check\", count(*) = 0 AS ok, count(*) AS n_bad FROM ({v})" for k, v in _REPORT.items()), ["tidy", "gc", "tot"])
def _(spark, sf):
    tidy = checkpointed(fx.tidy(spark, sf))
    guilds = clean.guild_counts(tidy)
    report = checks.check_report(tidy, guilds, clean.survey_totals(guilds), fx.EVENT_SPECIES)
    return report.drop("message")
