"""The general order/event tables seen as count surveys, size records and date series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions import scalars as S
from surveyframe.plans.clean import CountRules, SizeRules
from surveyframe.session import checkpointed, literal_frame

EVENT_SPECIES = ["click", "error", "purchase", "signup", "view"]
GUILDS = [("click", "browse"), ("view", "browse"), ("purchase", "convert"), ("signup", "convert"), ("error", "fault")]
TYPES = ["Natural", "Artificial"]
PAIRS = ["pair_0", "pair_1", "pair_2"]
PERIODS = ["Pre", "Post"]
DEPLOYED = "2024-01-15"
SIZE_SPECIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
MATURITY = [("ECONOMY", 8.2), ("LARGE", 57.0), ("MEDIUM", 12.5), ("PROMO", 29.0), ("SMALL", 17.5)]
SIZE_GUILDS = [("ECONOMY", "grazer"), ("SMALL", "grazer"), ("MEDIUM", "hunter"), ("LARGE", "hunter"), ("PROMO", "hunter"), ("STANDARD", "filter")]
BINS = [
    ("bin_0_1", "0-1", 0.0, 1.0),
    ("bin_1_2", "1-2", 1.0, 2.0),
    ("bin_2_5", "2-5", 2.0, 5.0),
    ("bin_5_10", "5-10", 5.0, 10.0),
    ("bin_10_15", "10-15", 10.0, 15.0),
    ("bin_15_20", "15-20", 15.0, 20.0),
    ("bin_20_50", "20-50", 20.0, 50.0),
    ("bin_50_100", "50-100", 50.0, 100.0),
    ("bin_100", "100+", 100.0, float("inf")),
]
LEGACY = ("bin_10_20", "bin_10_15", "bin_15_20")

COUNT_RULES = CountRules(species=EVENT_SPECIES, anchor=DEPLOYED)
SIZE_RULES = SizeRules(
    bins=BINS, legacy=LEGACY, caps={"ECONOMY": ["bin_20_50", "bin_50_100", "bin_100"]}, date_floor="1900-01-01", repair_to=2000
)


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


#: Least support of a species comparison on the size records of this catalogue.
SUPPORT = {"occupied_types": 2, "occupied_surveys": 12, "occupied_dates": 6, "juvenile_surveys": 4, "adult_surveys": 4}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table under its stated schema, so that no job runs to infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def day(c: str) -> Column:
    return F.to_date(F.col(c))


def _pair(i: Column) -> Column:
    return F.concat(F.lit("pair_"), (i % 3).cast("string"))


def _type(i: Column, width: int = 3) -> Column:
    return F.when(F.floor(i / width) % 2 == 1, "Artificial").otherwise("Natural")


# --- OBS: events as observer rows --------------------------------------------------------


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """site, date, researcher, species, count: one row per event."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("site_"), F.col("user_id").cast("string")).alias("site"),
        day("ts").alias("date"),
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("obs_"), (F.col("event_id") % 4).cast("string"))).alias("researcher"),
        F.col("event_type").alias("species"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("count"),
    )


def obs_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows as a field sheet: text cells, one column per species."""
    e = table(spark, sf, "events")
    cell = F.when(F.col("event_id") % 17 != 0, F.col("value").cast("string"))
    return e.select(
        F.concat(F.lit("site_"), F.col("user_id").cast("string")).alias("site"),
        F.date_format(day("ts"), "M/d/yyyy").alias("date"),
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("obs_"), (F.col("event_id") % 4).cast("string"))).alias("researcher"),
        *[F.when(F.col("event_type") == s, cell).alias(s) for s in EVENT_SPECIES],
    )


def obs_sites(spark: SparkSession, sf: str) -> DataFrame:
    """site, type, pair: as long as the list of users."""
    u = table(spark, sf, "events").select("user_id").distinct()
    return u.select(
        F.concat(F.lit("site_"), F.col("user_id").cast("string")).alias("site"),
        _type(F.col("user_id")).alias("type"),
        _pair(F.col("user_id")).alias("pair"),
    )


def guilds(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, GUILDS, "species string, guild string")


def deployments(spark: SparkSession) -> DataFrame:
    import datetime

    at = datetime.date.fromisoformat(DEPLOYED)
    return literal_frame(spark, [("pair_0", at), ("pair_1", at), ("pair_2", None)], "pair string, deployment_date date")


def placed_obs(spark: SparkSession, sf: str) -> DataFrame:
    """OBS rows with the pair, type and guild of their lookups."""
    rows = obs(spark, sf).join(obs_sites(spark, sf), "site", "inner")
    return rows.join(guilds(spark), "species", "left")


def tidy(spark: SparkSession, sf: str) -> DataFrame:
    """OBS through the count-cleaning plan."""
    from surveyframe.plans.clean import clean_counts

    return clean_counts(obs(spark, sf), guilds(spark), obs_sites(spark, sf), deployments(spark), COUNT_RULES)


# --- SIZED: line items as binned sizes ----------------------------------------------------


def sized(spark: SparkSession, sf: str) -> DataFrame:
    """Raw size records as text: one per supplier, ship month and part type."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", day("l_shipdate").alias("ship"))
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    size, qty = F.col("p_size"), F.col("l_quantity")
    edges = {"bin_1_2": (1, 2), "bin_2_5": (2, 5), "bin_5_10": (5, 10), "bin_10_15": (10, 15), "bin_15_20": (15, 20), "bin_20_50": (20, 50), "bin_50_100": (50, 100)}
    sums = {b: F.sum(F.when((size >= lo) & (size < hi), qty).otherwise(0.0)) for b, (lo, hi) in edges.items()}
    month = F.trunc("ship", "month")
    g = rows.groupBy("l_suppkey", month.alias("month"), F.col("p_type").alias("species")).agg(
        F.min(F.round(F.col("l_discount") * 100)).cast("int").alias("clear"), *[c.alias(b) for b, c in sums.items()]
    )
    year = F.year("month")
    old_10_20 = F.when(year <= 1998, F.nullif(F.col("bin_10_15") + F.col("bin_15_20"), F.lit(0.0)))
    text = lambda c: c.cast("int").cast("string")
    m = F.col("clear")
    return g.select(
        F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("site"),
        F.date_format("month", "M/d/yyyy").alias("date_text"),
        F.when(m == 0, "<3 m").when(m == 1, None).when(m == 2, "").when(m == 3, "2.5 m").otherwise(F.concat(m.cast("string"), F.lit(" m"))).alias("visibility"),
        "species",
        F.col("species").alias("sci_name"),
        F.lit(None).cast("string").alias("bin_0_1"),
        *[text(F.col(b)).alias(b) for b in ("bin_1_2", "bin_2_5", "bin_5_10")],
        text(F.when(year > 1998, F.col("bin_10_15"))).alias("bin_10_15"),
        text(F.when(year >= 1998, F.col("bin_15_20"))).alias("bin_15_20"),
        *[text(F.col(b)).alias(b) for b in ("bin_20_50", "bin_50_100")],
        F.lit(None).cast("string").alias("bin_100"),
        text(old_10_20).alias("bin_10_20"),
    )


def sized_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Registered suppliers (balance not negative) as sites."""
    s = table(spark, sf, "supplier").where(F.col("s_acctbal") >= 0)
    return s.select(
        F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")).alias("site"),
        _type(F.col("s_suppkey")).alias("type"),
        _pair(F.col("s_suppkey")).alias("pair"),
    )


def size_guilds(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, SIZE_GUILDS, "species string, guild string")


def maturity(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, MATURITY, "sci_name string, lmat double")


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """SIZED through the size-cleaning plan."""
    from surveyframe.plans.clean import clean_sizes, size_records

    records = size_records(sized(spark, sf), SIZE_RULES)
    return clean_sizes(records, sized_sites(spark, sf), size_guilds(spark), maturity(spark), SIZE_RULES)


def stored_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned stage table stored once, for plans that read it several times."""
    return checkpointed(stages(spark, sf))


def stage_counts_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-filled survey × species × stage counts of the stored stage table."""
    from surveyframe.operators.keys import level_values
    from surveyframe.plans.clean import stage_frame

    staged = stored_stages(spark, sf)
    return stage_frame(staged, level_values(staged, "species"))


# --- ORD and RARE -------------------------------------------------------------------------


def ord_surveys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a long date range: site = customer."""
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("site"),
        _pair(F.col("o_custkey")).alias("pair"),
        _type(F.col("o_custkey")).alias("type"),
        day("o_orderdate").alias("date"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("survey_id"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("count"),
    )


def rare(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user pair within one hour of the day: dates with gaps."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("pair_"), F.floor(F.col("user_id") / 2).cast("string"), F.lit("_"), F.hour("ts").cast("string")).alias("pair"),
        F.when(F.col("user_id") % 2 == 1, TYPES[1]).otherwise(TYPES[0]).alias("type"),
        F.col("event_id").alias("survey_id"),
        day("ts").alias("date"),
    )
