"""Cleaning, scalar, reshape and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog.views  # noqa: F401
from catalog.registry import query, r
from catalog import fixtures as fx
from surveyframe.functions import scalars as S
from surveyframe.operators import joins, reshape
from surveyframe.operators.keys import numbered
from surveyframe.plans import clean
from surveyframe.sources.tables import drop_empty


@query("drop_empty", """
SELECT site, CAST(date AS VARCHAR) AS date_text, visibility, species, CAST(b10_20 AS VARCHAR) AS bin_10_20
FROM (SELECT * REPLACE (nullif(visibility, '') AS visibility) FROM sizedt)""", ["sizedt"])
def _(spark, sf):
    blank = drop_empty(fx.sized(spark, sf))
    assert "bin_0_1" not in blank.columns and "bin_100" not in blank.columns
    return blank.select("site", S.parse_date("date_text").alias("date_text"), "visibility", "species", "bin_10_20")


@query("safe_cast", f"""
SELECT o_orderkey, TRY_CAST(t AS DOUBLE) AS as_double, CAST(trunc(TRY_CAST(t AS DOUBLE)) AS BIGINT) AS as_int
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'N/A' WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority
             ELSE CAST(o_totalprice AS VARCHAR) END AS t FROM orders)""")
def _(spark, sf):
    text = (
        F.when(F.col("o_orderstatus") == "P", "N/A")
        .when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority"))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", S.safe_double(text).alias("as_double"), S.safe_int(text).alias("as_int"))


@query("date_parse", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders""")
def _(spark, sf):
    shown = F.date_format("o_orderdate", "M/d/yyyy HH:mm")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("13/"), shown)).otherwise(shown)
    return fx.table(spark, sf, "orders").select("o_orderkey", S.parse_date(text).alias("date"))


@query("repair_year", """
SELECT o_orderkey, CAST(CASE WHEN d >= DATE '1997-01-01' THEN d
       WHEN month(d) = 2 AND day(d) = 29 THEN NULL
       ELSE make_date(2001, month(d), day(d)) END AS VARCHAR) AS date
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", S.repair_year(fx.day("o_orderdate"), "1997-01-01", 2001).alias("date"))


@query("recode", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BUDGET' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS species FROM part""")
def _(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", S.recode("p_type", {"ECONOMY": "BUDGET", "PROMO": "OFFER"}).alias("species"))


@query("visibility_filter", """
SELECT site, CAST(date AS VARCHAR) AS date, species, visibility, visibility_m FROM rec""", ["rec"])
def _(spark, sf):
    raw = fx.sized(spark, sf).where(S.visibility_kept("visibility"))
    return raw.select("site", S.parse_date("date_text").alias("date"), "species", "visibility", S.parse_number("visibility").alias("visibility_m"))


@query("in_list", """
SELECT site, species, count(*) AS n_out FROM obs WHERE species NOT IN ('error', 'view') AND coalesce(researcher, '') NOT IN ('obs_1')
GROUP BY ALL""", ["obs"])
def _(spark, sf):
    rows = fx.obs(spark, sf).where(~S.in_list("species", ["error", "view"]) & ~S.in_list("researcher", ["obs_1"]))
    return rows.groupBy("site", "species").agg(F.count(F.lit(1)).alias("n_out"))


@query("unpivot_counts", """
SELECT site, CAST(date AS VARCHAR) AS date, researcher, s.species, CASE WHEN o.species = s.species THEN raw END AS count
FROM obs o CROSS JOIN (SELECT DISTINCT species FROM obs WHERE species <> 'error') s""", ["obs"])
def _(spark, sf):
    rules = clean.CountRules(species=fx.EVENT_SPECIES, anchor=fx.DEPLOYED, end_date="2099-12-31", exclude_species=["error"])
    return clean.count_observations(fx.obs_wide(spark, sf), rules)


_CLEAN = ["site", "pair", "type", "period", "t_since", "date_num", "date", "date_s", "survey_id", "researchers",
          "n_observer_rows", "n_observers", "species", "guild", "count"]


@query("clean_counts", f"""
WITH w AS (SELECT site, pair, type, date, researcher, s.species,
             CASE WHEN s.species IN ('click','view') THEN 'browse' WHEN s.species IN ('purchase','signup') THEN 'convert' ELSE 'fault' END AS guild,
             ceil(coalesce(CASE WHEN o.species = s.species THEN raw END, 0)) AS c
           FROM obs_cut o CROSS JOIN (SELECT DISTINCT species FROM obs_cut) s WHERE s.species <> 'error'),
     sc AS (SELECT min(date) AS d0, avg(CAST(date - DATE '2024-01-01' AS DOUBLE)) AS m, stddev_samp(CAST(date - DATE '2024-01-01' AS DOUBLE)) AS s FROM w)
SELECT site, pair, type, CASE WHEN pair = 'pair_2' OR date >= DATE '2024-01-15' THEN 'Post' ELSE 'Pre' END AS period,
       round(greatest(0.0, CAST(date - DATE '2024-01-15' AS DOUBLE) / 31.0), 6) AS t_since,
       CAST(date - any_value(d0) AS BIGINT) AS date_num, CAST(date AS VARCHAR) AS date,
       {r("(CAST(date - DATE '2024-01-01' AS DOUBLE) - any_value(m)) / any_value(s)")} AS date_s,
       site || '_' || CAST(date AS VARCHAR) AS survey_id,
       nullif(string_agg(DISTINCT researcher, '; ' ORDER BY researcher), '') AS researchers,
       count(*) AS n_observer_rows, count(DISTINCT researcher) AS n_observers, species, guild, CAST(ceil(avg(c)) AS BIGINT) AS count
FROM w, sc GROUP BY site, pair, type, w.date, species, guild""".replace("WITH w AS", "WITH obs_cut AS (SELECT * FROM obs WHERE date <= DATE '2024-01-28'), w AS").replace("FROM obs WHERE", """FROM (SELECT 'site_' || CAST(user_id AS VARCHAR) AS site,
       'pair_' || CAST(user_id % 3 AS VARCHAR) AS pair,
       CASE WHEN (user_id // 3) % 2 = 1 THEN 'Artificial' ELSE 'Natural' END AS type,
       CAST(ts AS DATE) AS date, event_type AS species,
       CASE WHEN event_id % 13 <> 0 THEN 'obs_' || CAST(event_id % 4 AS VARCHAR) END AS researcher,
       CASE WHEN event_id % 17 <> 0 THEN value END AS raw FROM events) WHERE"""))
def _(spark, sf):
    rules = clean.CountRules(species=fx.EVENT_SPECIES, anchor=fx.DEPLOYED, end_date="2024-01-28", exclude_species=["error"])
    rows = clean.count_observations(fx.obs_wide(spark, sf), rules)
    cleaned = clean.clean_counts(rows, fx.guilds(spark), fx.obs_sites(spark, sf), fx.deployments(spark), rules)
    return clean.assert_counts(cleaned)


@query("observer_merge", """
SELECT survey_id, species, count, n_observer_rows, n_observers, researchers FROM tidy0""", ["tidy0"])
def _(spark, sf):
    merged = clean.merge_observers(fx.obs(spark, sf), ["site", "date", "species"])
    return merged.select(S.survey_key("site", "date").alias("survey_id"), "species", "count", "n_observer_rows", "n_observers", "researchers")


@query("period_flag", """
SELECT pair, CAST(date AS VARCHAR) AS date, CASE WHEN pair = 'pair_2' OR date >= DATE '2024-01-15' THEN 'Post' ELSE 'Pre' END AS period,
       count(*) AS n FROM obs GROUP BY pair, obs.date""", ["obs"])
def _(spark, sf):
    days = fx.placed_obs(spark, sf).groupBy("pair", "date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(fx.deployments(spark), "pair", "left").select(
        "pair", "date", S.period_flag("date", "deployment_date").alias("period"), "n"
    )


_MONTHS = """greatest(0.0, (year(date) - 1996) * 12 + month(date) - 1 + (day(date) - 1) / CAST(day(last_day(date)) AS DOUBLE))"""


@query("months_since", f"SELECT survey_id, CAST(date AS VARCHAR) AS date, round({_MONTHS}, 6) AS months FROM ord", ["ord"])
def _(spark, sf):
    return fx.ord_surveys(spark, sf).select("survey_id", "date", S.months_since("date", "1996-01-01").alias("months"))


@query("time_index", f"SELECT survey_id, date_num, {r('date_s')} AS date_s, round(t_since, 6) AS t_since FROM hdr", ["hdr"])
def _(spark, sf):
    rows = fx.obs(spark, sf)
    days = rows.select("site", "date").distinct()
    timed = clean.add_time_index(days, clean.date_scale(rows), fx.DEPLOYED)
    return timed.select(S.survey_key("site", "date").alias("survey_id"), "date_num", "date_s", "t_since")


@query("level_check", """
SELECT CASE WHEN species IN ('view', 'click', 'purchase') THEN species END AS species,
       CASE species WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS level,
       count(*) AS n FROM obs GROUP BY 1, 2""", ["obs"])
def _(spark, sf):
    levels = ["view", "click", "purchase"]
    rows = fx.obs(spark, sf).select(S.as_level("species", levels).alias("species"), S.level_index("species", levels).alias("level"))
    return rows.groupBy("species", "level").agg(F.count(F.lit(1)).alias("n"))


@query("survey_key", """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE CAST(o_custkey AS VARCHAR) END || '_' ||
       CASE WHEN o_orderpriority = '5-LOW' THEN 'NA' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS survey_id,
       count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    site = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    date = F.when(F.col("o_orderpriority") != "5-LOW", fx.day("o_orderdate"))
    rows = fx.table(spark, sf, "orders").select(S.survey_key(site, date).alias("survey_id"))
    return rows.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n"))


@query("near", """
SELECT l_orderkey, l_linenumber, abs(round(l_extendedprice * (1 - l_discount), 2) - l_extendedprice * (1 - l_discount)) < 1.5e-8 AS whole_cents
FROM lineitem""")
def _(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.near(F.round(net, 2), net).alias("whole_cents"))


@query("interaction_key", "SELECT pair || '.' || type || '.' || guild AS trajectory, count(*) AS n FROM gc GROUP BY 1", ["gc"])
def _(spark, sf):
    rows = clean.guild_counts(fx.tidy(spark, sf))
    return rows.groupBy(S.interaction_key(["pair", "type", "guild"]).alias("trajectory")).agg(F.count(F.lit(1)).alias("n"))


@query("row_id", """
SELECT survey_id, guild, row_number() OVER (PARTITION BY survey_id ORDER BY guild) AS row_in_survey FROM gc""", ["gc"])
def _(spark, sf):
    rows = clean.guild_counts(fx.tidy(spark, sf)).select("survey_id", "guild")
    return numbered(rows, ["survey_id"], ["guild"], "row_in_survey")


@query("signif", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0
  WHEN k <= 0 THEN round(x * pow(10.0, -k)) / pow(10.0, -k) ELSE round(x / pow(10.0, k)) * pow(10.0, k) END AS shown
FROM (SELECT *, l_extendedprice * l_tax AS x, floor(log10(abs(nullif(l_extendedprice * l_tax, 0)))) - 2 AS k FROM lineitem)""")
def _(spark, sf):
    x = F.col("l_extendedprice") * F.col("l_tax")
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.signif(x, 3).alias("shown"))


@query("date_grid", """
SELECT pair, type, i, round(a + i * ((b - a) / 99.0), 6) AS day
FROM (SELECT pair, type, CAST(min(date) - DATE '1970-01-01' AS DOUBLE) AS a, CAST(max(date) - DATE '1970-01-01' AS DOUBLE) AS b FROM ord GROUP BY ALL),
     (SELECT unnest(range(100)) AS i)""", ["ord"])
def _(spark, sf):
    return joins.date_grid(fx.ord_surveys(spark, sf), ["pair", "type"], "date", 100)


@query("linear_map", f"""
SELECT round(regr_slope(date_s, date_num), 6) AS slope, {r('regr_intercept(date_s, date_num)')} AS intercept
FROM (SELECT DISTINCT date_num, date_s FROM hdr)""", ["hdr"])
def _(spark, sf):
    return joins.linear_map(fx.tidy(spark, sf), "date_num", "date_s")


@query("lookup_join", """
SELECT species, guild, count(*) AS n FROM obs GROUP BY ALL""", ["obs"])
def _(spark, sf):
    rows = joins.lookup_join(fx.obs(spark, sf), fx.guilds(spark), ["species"])
    return rows.groupBy("species", "guild").agg(F.count(F.lit(1)).alias("n"))


@query("site_reject", """
SELECT site, species, count(*) AS n_lost FROM rec WHERE site NOT IN (SELECT site FROM szsite) GROUP BY ALL""", ["rec", "szsite"])
def _(spark, sf):
    lost = joins.rejected(clean.size_records(fx.sized(spark, sf), fx.SIZE_RULES), fx.sized_sites(spark, sf), ["site"])
    return lost.groupBy("site", "species").agg(F.count(F.lit(1)).alias("n_lost"))


@query("bin_split", """
SELECT site, CAST(date AS VARCHAR) AS date, species, b10_20 AS bin_10_20_orig, b10_15 AS bin_10_15, b15_20 AS bin_15_20 FROM split""", ["split"])
def _(spark, sf):
    placed = joins.matched(clean.size_records(fx.sized(spark, sf), fx.SIZE_RULES), fx.sized_sites(spark, sf), ["site"])
    done = clean.split_legacy_bin(placed, "bin_10_20", ("bin_10_15", "bin_15_20"), "species")
    return done.select("site", "date", "species", "bin_10_20_orig", "bin_10_15", "bin_15_20")


@query("bin_caps", """
SELECT site, CAST(date AS VARCHAR) AS date, species, CASE WHEN species <> 'ECONOMY' THEN b20_50 END AS bin_20_50,
       CASE WHEN species <> 'ECONOMY' THEN b50_100 END AS bin_50_100 FROM rec""", ["rec"])
def _(spark, sf):
    records = clean.cap_bins(clean.size_records(fx.sized(spark, sf), fx.SIZE_RULES), fx.SIZE_RULES.caps)
    return records.select("site", "date", "species", "bin_20_50", "bin_50_100")


def _binned(spark, sf):
    records = clean.size_records(fx.sized(spark, sf), fx.SIZE_RULES)
    return clean.binned_records(records, fx.sized_sites(spark, sf), fx.size_guilds(spark), fx.SIZE_RULES)


@query("unpivot_bins", """
SELECT site, CAST(date AS VARCHAR) AS date, species, size_class, lower,
       CASE WHEN size_class = '100+' THEN NULL ELSE upper END AS upper, size_class = '100+' AS open_ended, count FROM szlong""", ["szlong"])
def _(spark, sf):
    long = clean.bins_long(_binned(spark, sf), fx.BINS)
    open_ended = F.col("upper") == float("inf")
    return long.select("site", "date", "species", "size_class", "lower", F.when(~open_ended, F.col("upper")).alias("upper"), open_ended.alias("open_ended"), "count")


@query("life_stage", """
SELECT survey_id, species, size_class, life_stage, count, round(p_juv, 6) AS p_juv, stage_count FROM stages""", ["stages"])
def _(spark, sf):
    return fx.stages(spark, sf).select("survey_id", "species", "size_class", "life_stage", "count", "p_juv", "stage_count")


@query("life_stage_rejects", """
SELECT species, species AS sci_name, CAST(sum(count) AS BIGINT) AS lost_count FROM szlong
WHERE count > 0 AND species NOT IN (SELECT species FROM mat) GROUP BY ALL""", ["szlong", "mat"])
def _(spark, sf):
    return clean.life_stage_rejects(clean.bins_long(_binned(spark, sf), fx.BINS, keep_zero=False), fx.maturity(spark))


@query("guild_counts", f"""
SELECT survey_id, guild, period, date_num, {r('date_s')} AS date_s, round(t_since, 6) AS t_since, count FROM gc""", ["gc"])
def _(spark, sf):
    return clean.guild_counts(fx.tidy(spark, sf)).select("survey_id", "guild", "period", "date_num", "date_s", "t_since", "count")


@query("survey_total", "SELECT survey_id, pair, type, period, count FROM tot", ["tot"])
def _(spark, sf):
    return clean.survey_totals(clean.guild_counts(fx.tidy(spark, sf))).select("survey_id", "pair", "type", "period", "count")


@query("community_wide", """
SELECT survey_id, """ + ", ".join(f"CAST(coalesce(sum(CASE WHEN species = '{s}' THEN count END), 0) AS BIGINT) AS {s}" for s in fx.EVENT_SPECIES) + """
FROM tidy0 GROUP BY survey_id""", ["tidy0"])
def _(spark, sf):
    return reshape.to_wide(fx.tidy(spark, sf), ["survey_id"], "species", fx.EVENT_SPECIES, F.sum("count"))


@query("stage_proportions", """
SELECT pair, type, round(j, 6) AS juvenile, round(a, 6) AS adult, round(j + a, 6) AS total,
       round(j / (j + a), 6) AS juvenile_prop, round(a / (j + a), 6) AS adult_prop
FROM (SELECT pair, type, avg(CASE WHEN life_stage = 'juvenile' THEN stage_count END) AS j,
             avg(CASE WHEN life_stage = 'adult' THEN stage_count END) AS a FROM sframe GROUP BY ALL)""", ["sframe"])
def _(spark, sf):
    from surveyframe.plans.results import stage_proportions

    frame = fx.stage_counts_frame(spark, sf)
    means = frame.groupBy("pair", "type", "life_stage").agg(F.avg("stage_count").alias("response"))
    return stage_proportions(means, ["pair", "type"])


@query("zero_fill", "SELECT survey_id, species, life_stage, stage_count FROM sframe", ["sframe"])
def _(spark, sf):
    return fx.stage_counts_frame(spark, sf).select("survey_id", "species", "life_stage", "stage_count")


@query("stage_counts", "SELECT survey_id, species, life_stage, stage_count FROM ssum", ["ssum"])
def _(spark, sf):
    from surveyframe.operators.effort import stage_by_survey

    return stage_by_survey(fx.stages(spark, sf), ["species"]).select("survey_id", "species", "life_stage", "stage_count")


@query("raw_stage_prop", """
SELECT survey_id, species, j AS juvenile, a AS adult, j + a AS total_count, round(CAST(j AS DOUBLE) / (j + a), 6) AS raw_juvenile_prop
FROM (SELECT survey_id, species, CAST(sum(CASE WHEN life_stage = 'juvenile' THEN stage_count ELSE 0 END) AS BIGINT) AS j,
             CAST(sum(CASE WHEN life_stage = 'adult' THEN stage_count ELSE 0 END) AS BIGINT) AS a FROM sframe GROUP BY ALL)
WHERE j + a > 0""", ["sframe"])
def _(spark, sf):
    from surveyframe.plans.figures import raw_stage_proportions

    return raw_stage_proportions(fx.stage_counts_frame(spark, sf), ["survey_id", "species"])


@query("pivot_multi", """
SELECT pair, max(CASE WHEN type = 'Natural' THEN n END) AS n_Natural, max(CASE WHEN type = 'Artificial' THEN n END) AS n_Artificial,
       max(CASE WHEN type = 'Natural' THEN total END) AS total_Natural, max(CASE WHEN type = 'Artificial' THEN total END) AS total_Artificial
FROM (SELECT pair, type, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM ord GROUP BY ALL) GROUP BY pair""", ["ord"])
def _(spark, sf):
    per = fx.ord_surveys(spark, sf).groupBy("pair", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))
    return reshape.to_wide_many(per, ["pair"], "type", fx.TYPES, ["n", "total"])


@query("missing_cells", """
SELECT survey_id, species FROM (SELECT DISTINCT survey_id FROM tidy0) CROSS JOIN (SELECT DISTINCT species FROM tidy0)
EXCEPT SELECT survey_id, species FROM tidy0""", ["tidy0"])
def _(spark, sf):
    return reshape.missing_cells(fx.tidy(spark, sf), ["survey_id"], "species", fx.EVENT_SPECIES)


@query("reconcile", """
SELECT coalesce(a.survey_id, b.survey_id) AS survey_id, coalesce(a.guild, b.guild) AS guild, part_sum, stated_total, part_sum - stated_total AS difference
FROM (SELECT survey_id, guild, CAST(sum(count) AS BIGINT) AS part_sum FROM tidy0 GROUP BY ALL) a
FULL JOIN (SELECT site || '_' || CAST(date AS VARCHAR) AS survey_id, guild, CAST(sum(ceil(coalesce(raw, 0))) AS BIGINT) AS stated_total FROM obs GROUP BY ALL) b
ON a.survey_id = b.survey_id AND a.guild = b.guild""", ["tidy0", "obs"])
def _(spark, sf):
    raw = fx.placed_obs(spark, sf).groupBy(S.survey_key("site", "date").alias("survey_id"), "guild").agg(
        F.sum(S.up_count("count").cast("bigint")).alias("raw_total")
    )
    return joins.reconcile(fx.tidy(spark, sf), raw, ["survey_id", "guild"], "count", "raw_total")


@query("nearest_date", """
SELECT r.pair, r.type AS focal_type, CAST(r.date AS VARCHAR) AS focal_date, CAST(nearest_gap_days AS BIGINT) AS nearest_gap_days
FROM rare r JOIN gaps g ON g.pair = r.pair AND g.focal_type = r.type AND g.focal_date = r.date""", ["rare", "gaps"])
def _(spark, sf):
    return joins.nearest_dates(fx.rare(spark, sf), ["pair"], "type", "date", tuple(fx.TYPES))


@query("match_summary", """
SELECT r.pair, r.type AS focal_type, count(*) AS n_dates, CAST(max(nearest_gap_days) AS BIGINT) AS maximum_nearest_gap_days,
       round(avg(CASE WHEN nearest_gap_days <= 0 THEN 100.0 ELSE 0.0 END), 6) AS percent_same_day,
       round(avg(CASE WHEN nearest_gap_days <= 7 THEN 100.0 ELSE 0.0 END), 6) AS percent_within_7_days,
       round(avg(CASE WHEN nearest_gap_days <= 30 THEN 100.0 ELSE 0.0 END), 6) AS percent_within_30_days,
       round(CAST(median(nearest_gap_days) AS DOUBLE), 6) AS median_nearest_gap_days
FROM rare r JOIN gaps g ON g.pair = r.pair AND g.focal_type = r.type AND g.focal_date = r.date GROUP BY ALL""", ["rare", "gaps"])
def _(spark, sf):
    gaps = joins.nearest_gaps(fx.rare(spark, sf), ["pair"], "type", "date", tuple(fx.TYPES))
    return joins.match_summary(gaps, ["pair"], {"percent_same_day": 0, "percent_within_7_days": 7, "percent_within_30_days": 30})


@query("holdout_split", """
SELECT site, survey_id, CAST(date AS VARCHAR) AS date,
       row_number() OVER (PARTITION BY site ORDER BY date, survey_id) > floor(0.8 * count(*) OVER (PARTITION BY site)) AS test FROM ord""", ["ord"])
def _(spark, sf):
    return joins.time_holdout(fx.ord_surveys(spark, sf), "site", "date", "survey_id")


@query("first_after", """
SELECT pair, type, survey_id, CAST(date AS VARCHAR) AS date, CAST(date - DATE '2024-01-15' AS BIGINT) AS days_after
FROM (SELECT *, row_number() OVER (PARTITION BY pair, type ORDER BY date, survey_id) AS k FROM rare WHERE date > DATE '2024-01-14') WHERE k = 1""", ["rare"])
def _(spark, sf):
    event = F.lit("2024-01-15").cast("date")
    later = fx.rare(spark, sf).where(F.col("date") >= event)
    first = joins.first_per_group(later, ["pair", "type"], ["date", "survey_id"], ["survey_id", "date"])
    return first.withColumn("days_after", F.datediff("date", event))


@query("trajectory_label", """
SELECT pair, type, round(s, 6) AS slope, CASE WHEN p < 0.05 AND s > 0 THEN 'increase' WHEN p < 0.05 AND s < 0 THEN 'decrease'
       ELSE 'no significant change' END AS trajectory, CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Non-significant' END AS significance
FROM (SELECT pair, type, regr_slope(count, CAST(date - DATE '1995-01-01' AS DOUBLE)) AS s, 1 - regr_r2(count, CAST(date - DATE '1995-01-01' AS DOUBLE)) * 100 AS p
      FROM ord GROUP BY ALL)""", ["ord"])
def _(spark, sf):
    x = F.datediff("date", F.lit("1995-01-01").cast("date")).cast("double")
    rows = fx.ord_surveys(spark, sf).withColumn("x", x)
    fit = rows.groupBy("pair", "type").agg(F.regr_slope("count", "x").alias("slope"), (1 - F.regr_r2("count", "x") * 100).alias("p"))
    return fit.select("pair", "type", "slope", S.trajectory_label("slope", "p").alias("trajectory"), S.significance_label("p").alias("significance"))


@query("ratio_invert", """
SELECT pair, type, round(n / CAST(a AS DOUBLE), 6) AS ratio, round(n / (a + 2 * sqrt(a)), 6) AS lower, round(n / (a - 2 * sqrt(a)), 6) AS upper,
       round(log2(n / CAST(a AS DOUBLE)), 6) AS log2_ratio
FROM (SELECT pair, type, CAST(sum(CASE WHEN life_stage = 'juvenile' THEN stage_count ELSE 0 END) AS DOUBLE) AS n,
             CAST(sum(CASE WHEN life_stage = 'adult' THEN stage_count ELSE 0 END) AS DOUBLE) AS a FROM stages GROUP BY ALL)""", ["stages"])
def _(spark, sf):
    n, a = F.col("n"), F.col("a")
    sums = fx.stages(spark, sf).groupBy("pair", "type").agg(
        F.sum(F.when(F.col("life_stage") == "juvenile", F.col("stage_count")).otherwise(0)).cast("double").alias("n"),
        F.sum(F.when(F.col("life_stage") == "adult", F.col("stage_count")).otherwise(0)).cast("double").alias("a"),
    )
    ratio, low, high = S.invert_ratio(a / n, (a - 2 * F.sqrt(a)) / n, (a + 2 * F.sqrt(a)) / n)
    return sums.select("pair", "type", ratio.alias("ratio"), low.alias("lower"), high.alias("upper"), F.log2(ratio).alias("log2_ratio"))


@query("back_transform", """
SELECT pair, type, round(exp(l), 6) AS predicted, round(exp(l - 1.96 * s), 6) AS lower, round(exp(l + 1.96 * s), 6) AS upper,
       round((exp(l) - 1) / exp(l), 6) AS proportion
FROM (SELECT pair, type, avg(ln(1 + count)) AS l, stddev_samp(ln(1 + count)) / sqrt(count(*)) AS s FROM ord GROUP BY ALL)""", ["ord"])
def _(spark, sf):
    link = fx.ord_surveys(spark, sf).groupBy("pair", "type").agg(
        F.avg(F.log1p("count")).alias("l"), (F.stddev_samp(F.log1p("count")) / F.sqrt(F.count(F.lit(1)))).alias("s")
    )
    mid, low, high = S.back_transform("l", "s")
    return link.select("pair", "type", mid.alias("predicted"), low.alias("lower"), high.alias("upper"), S.odds_to_prop(mid - 1).alias("proportion"))
