"""SQL statements of the adapters and of the cleaned tables, shared by the oracles."""

from catalog.registry import cte

cte("obs", """
SELECT 'site_' || CAST(user_id AS VARCHAR) AS site,
       'pair_' || CAST(user_id % 3 AS VARCHAR) AS pair,
       CASE WHEN (user_id // 3) % 2 = 1 THEN 'Artificial' ELSE 'Natural' END AS type,
       CAST(ts AS DATE) AS date,
       event_type AS species,
       CASE WHEN event_type IN ('click','view') THEN 'browse'
            WHEN event_type IN ('purchase','signup') THEN 'convert' ELSE 'fault' END AS guild,
       CASE WHEN event_id % 13 <> 0 THEN 'obs_' || CAST(event_id % 4 AS VARCHAR) END AS researcher,
       CASE WHEN event_id % 17 <> 0 THEN value END AS raw
FROM events""")
cte("scale", """
SELECT min(date) AS d0, avg(n) AS m, stddev_samp(n) AS s
FROM (SELECT date, CAST(date - (SELECT min(date) FROM obs) AS DOUBLE) AS n FROM obs)""", ["obs"])
cte("tidy0", """
SELECT site, pair, type, date, species, guild, site || '_' || CAST(date AS VARCHAR) AS survey_id,
       CASE WHEN pair = 'pair_2' OR date >= DATE '2024-01-15' THEN 'Post' ELSE 'Pre' END AS period,
       CAST(ceil(avg(ceil(coalesce(raw, 0)))) AS BIGINT) AS count,
       count(*) AS n_observer_rows, count(DISTINCT researcher) AS n_observers,
       nullif(string_agg(DISTINCT researcher, '; ' ORDER BY researcher), '') AS researchers
FROM obs GROUP BY site, pair, type, date, species, guild""", ["obs"])
cte("tidy", """
SELECT t.*, CAST(date - d0 AS BIGINT) AS date_num, (CAST(date - d0 AS DOUBLE) - m) / s AS date_s,
       greatest(0.0, CAST(date - DATE '2024-01-15' AS DOUBLE) / 31.0) AS t_since
FROM tidy0 t, scale""", ["tidy0", "scale"])
cte("gc", """
SELECT site, pair, type, period, t_since, date_num, date, date_s, survey_id, guild, CAST(sum(count) AS BIGINT) AS count
FROM tidy GROUP BY ALL""", ["tidy"])
cte("tot", """
SELECT survey_id, site, pair, type, period, date, date_num, date_s, t_since, CAST(sum(count) AS BIGINT) AS count
FROM gc GROUP BY ALL""", ["gc"])
cte("hdr", """
SELECT DISTINCT survey_id, site, pair, type, period, date, date_num, date_s, t_since FROM tidy""", ["tidy"])
cte("ohdr", """
SELECT DISTINCT survey_id, site, pair, type, period, date, n_observer_rows, n_observers, researchers FROM tidy""", ["tidy"])
cte("divs", """
SELECT survey_id, site, pair, type, period, date, date_num, date_s,
       CAST(sum(count) AS BIGINT) AS total_abundance, count(*) FILTER (WHERE count > 0) AS richness,
       coalesce(-sum(CASE WHEN count > 0 THEN (count / n) * ln(count / n) END), 0) AS shannon
FROM (SELECT *, CAST(sum(count) OVER (PARTITION BY survey_id) AS DOUBLE) AS n FROM tidy)
GROUP BY ALL""", ["tidy"])

cte("sized", """
SELECT 'sup_' || CAST(l_suppkey AS VARCHAR) AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_type AS species,
       CAST(min(round(l_discount * 100)) AS INTEGER) AS clear,
       CAST(sum(CASE WHEN p_size = 1 THEN l_quantity ELSE 0 END) AS INTEGER) AS b1_2,
       CAST(sum(CASE WHEN p_size BETWEEN 2 AND 4 THEN l_quantity ELSE 0 END) AS INTEGER) AS b2_5,
       CAST(sum(CASE WHEN p_size BETWEEN 5 AND 9 THEN l_quantity ELSE 0 END) AS INTEGER) AS b5_10,
       CAST(sum(CASE WHEN p_size BETWEEN 10 AND 14 THEN l_quantity ELSE 0 END) AS INTEGER) AS q10_15,
       CAST(sum(CASE WHEN p_size BETWEEN 15 AND 19 THEN l_quantity ELSE 0 END) AS INTEGER) AS q15_20,
       CAST(sum(CASE WHEN p_size BETWEEN 20 AND 49 THEN l_quantity ELSE 0 END) AS INTEGER) AS b20_50,
       CAST(sum(CASE WHEN p_size BETWEEN 50 AND 99 THEN l_quantity ELSE 0 END) AS INTEGER) AS b50_100
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, date_trunc('month', l_shipdate), p_type""")
cte("sizedt", """
SELECT site, date, species, b1_2, b2_5, b5_10, b20_50, b50_100,
       CASE WHEN year(date) > 1998 THEN q10_15 END AS b10_15, CASE WHEN year(date) >= 1998 THEN q15_20 END AS b15_20,
       CASE WHEN year(date) <= 1998 THEN nullif(q10_15 + q15_20, 0) END AS b10_20,
       CASE WHEN clear = 0 THEN '<3 m' WHEN clear = 1 THEN NULL WHEN clear = 2 THEN '' WHEN clear = 3 THEN '2.5 m'
            ELSE CAST(clear AS VARCHAR) || ' m' END AS visibility
FROM sized""", ["sized"])
cte("rec", """
SELECT *, TRY_CAST(nullif(regexp_extract(visibility, '-?[0-9]+[.]?[0-9]*'), '') AS DOUBLE) AS visibility_m FROM sizedt
WHERE visibility IS NOT NULL AND NOT regexp_matches(visibility, '^<\\s*3')
  AND (nullif(regexp_extract(visibility, '-?[0-9]+[.]?[0-9]*'), '') IS NULL
       OR CAST(nullif(regexp_extract(visibility, '-?[0-9]+[.]?[0-9]*'), '') AS DOUBLE) >= 3)""", ["sizedt"])
cte("szsite", """
SELECT 'sup_' || CAST(s_suppkey AS VARCHAR) AS site, 'pair_' || CAST(s_suppkey % 3 AS VARCHAR) AS pair,
       CASE WHEN (s_suppkey // 3) % 2 = 1 THEN 'Artificial' ELSE 'Natural' END AS type
FROM supplier WHERE s_acctbal >= 0""")
cte("placed", "SELECT rec.*, szsite.pair, szsite.type FROM rec JOIN szsite USING (site)", ["rec", "szsite"])
cte("rates", """
SELECT species, CAST(sum(b10_15) AS DOUBLE) / sum(b10_15 + b15_20) AS p FROM placed
WHERE b10_15 IS NOT NULL AND b15_20 IS NOT NULL AND b10_15 + b15_20 > 0 GROUP BY species""", ["placed"])
cte("rate_all", """
SELECT CAST(sum(b10_15) AS DOUBLE) / sum(b10_15 + b15_20) AS pg FROM placed
WHERE b10_15 IS NOT NULL AND b15_20 IS NOT NULL AND b10_15 + b15_20 > 0""", ["placed"])
cte("split", """
SELECT site, pair, type, date, species, visibility_m, b1_2, b2_5, b5_10, b20_50, b50_100, b10_20,
       CASE WHEN need THEN part ELSE b10_15 END AS b10_15, CASE WHEN need THEN b10_20 - part ELSE b15_20 END AS b15_20
FROM (SELECT placed.*, b10_20 IS NOT NULL AND (b10_15 IS NULL OR b15_20 IS NULL) AS need,
             CAST(round_even(b10_20 * coalesce(p, pg), 0) AS INTEGER) AS part
      FROM placed LEFT JOIN rates USING (species), rate_all)""", ["placed", "rates", "rate_all"])
cte("capped", """
SELECT * REPLACE (CASE WHEN species <> 'ECONOMY' THEN b20_50 END AS b20_50, CASE WHEN species <> 'ECONOMY' THEN b50_100 END AS b50_100)
FROM split""", ["split"])
cte("mat", """
SELECT * FROM (VALUES ('ECONOMY', CAST(8.2 AS DOUBLE)), ('LARGE', 57), ('MEDIUM', 12.5), ('PROMO', 29), ('SMALL', 17.5)) v(species, lmat)""")
cte("szlong", """
SELECT site, pair, type, date, species, visibility_m, size_class, CAST(lo AS DOUBLE) AS lower, hi AS upper, CAST(coalesce(n, 0) AS BIGINT) AS count FROM (
  SELECT *, '0-1' AS size_class, 0 AS lo, CAST(1 AS DOUBLE) AS hi, NULL AS n FROM capped
  UNION ALL SELECT *, '1-2', 1, 2, b1_2 FROM capped UNION ALL SELECT *, '2-5', 2, 5, b2_5 FROM capped
  UNION ALL SELECT *, '5-10', 5, 10, b5_10 FROM capped UNION ALL SELECT *, '10-15', 10, 15, b10_15 FROM capped
  UNION ALL SELECT *, '15-20', 15, 20, b15_20 FROM capped UNION ALL SELECT *, '20-50', 20, 50, b20_50 FROM capped
  UNION ALL SELECT *, '50-100', 50, 100, b50_100 FROM capped
  UNION ALL SELECT *, '100+', 100, CAST('infinity' AS DOUBLE), NULL FROM capped)""", ["capped"])
cte("stagew", """
SELECT *, CAST(round_even(count * p_juv, 0) AS BIGINT) AS n_juv FROM (
  SELECT szlong.*, lmat, CASE WHEN lmat IS NULL THEN NULL WHEN upper <= lmat THEN 1.0 WHEN lower >= lmat THEN 0.0
         ELSE (lmat - lower) / (upper - lower) END AS p_juv
  FROM szlong LEFT JOIN mat USING (species))""", ["szlong", "mat"])
cte("stages", """
SELECT site || '_' || CAST(date AS VARCHAR) AS survey_id, site, pair, type, date, species, species AS sci_name,
       CASE WHEN species IN ('ECONOMY', 'SMALL') THEN 'grazer' WHEN species = 'STANDARD' THEN 'filter' ELSE 'hunter' END AS guild,
       visibility_m, size_class, lower, upper, count, lmat, p_juv, life_stage, stage_count
FROM (SELECT *, 'juvenile' AS life_stage, n_juv AS stage_count FROM stagew
      UNION ALL SELECT *, 'adult', count - n_juv FROM stagew) WHERE stage_count > 0""", ["stagew"])
cte("ssum", """
SELECT survey_id, site, pair, type, date, species, life_stage, CAST(sum(stage_count) AS BIGINT) AS stage_count
FROM stages GROUP BY ALL""", ["stages"])
cte("sframe", """
SELECT f.*, s.species, l.life_stage, coalesce(c.stage_count, 0) AS stage_count
FROM (SELECT DISTINCT survey_id, site, pair, type, date FROM stages) f
CROSS JOIN (SELECT DISTINCT species FROM stages) s
CROSS JOIN (SELECT 'juvenile' AS life_stage UNION ALL SELECT 'adult') l
LEFT JOIN ssum c ON c.survey_id = f.survey_id AND c.species = s.species AND c.life_stage = l.life_stage""", ["stages", "ssum"])

cte("ord", """
SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS site, 'pair_' || CAST(o_custkey % 3 AS VARCHAR) AS pair,
       CASE WHEN (o_custkey // 3) % 2 = 1 THEN 'Artificial' ELSE 'Natural' END AS type,
       CAST(o_orderdate AS DATE) AS date, 'order_' || CAST(o_orderkey AS VARCHAR) AS survey_id,
       CAST(floor(o_totalprice / 1000) AS BIGINT) AS count FROM orders""")
cte("rare", """
SELECT 'pair_' || CAST(user_id // 2 AS VARCHAR) || '_' || CAST(hour(ts) AS VARCHAR) AS pair,
       CASE WHEN user_id % 2 = 1 THEN 'Artificial' ELSE 'Natural' END AS type,
       event_id AS survey_id, CAST(ts AS DATE) AS date FROM events""")
cte("gaps", """
SELECT pair, type AS focal_type, date AS focal_date, min(gap) AS nearest_gap_days, any_value(n) AS n FROM (
  SELECT f.pair, f.type, f.date, f.n, abs(f.date - o.date) AS gap
  FROM (SELECT pair, type, date, count(*) AS n FROM rare GROUP BY ALL) f
  JOIN (SELECT DISTINCT pair, type, date FROM rare) o ON f.pair = o.pair AND f.type <> o.type) GROUP BY ALL""", ["rare"])
