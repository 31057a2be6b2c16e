"""Cleaning plans: wide counts to survey × species, binned sizes to life stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions import scalars as S
from surveyframe.operators.keys import attach_scalars
from surveyframe.operators.reshape import to_long
from surveyframe.session import compiled_steps, stored

LIFE_STAGES = ("juvenile", "adult")


@dataclass(frozen=True)
class CountRules:
    """Choices of the count cleaning that belong to a data set."""

    species: Sequence[str]
    anchor: str
    end_date: str | None = None
    exclude_species: Sequence[str] = ()
    site_aliases: Mapping[str, str] = field(default_factory=dict)
    guild_levels: Sequence[str] = ()


def count_observations(wide: DataFrame, rules: CountRules) -> DataFrame:
    """Wide text table (date, site, researcher, one column per species) to typed rows.

    Excluded species are left out of the unpivot instead of being filtered after it.
    """
    kept = [s for s in rules.species if s in wide.columns and s not in set(rules.exclude_species)]
    dated = wide.withColumns({"date": S.parse_date("date"), "site": S.recode("site", rules.site_aliases)})
    in_period = F.col("date").isNotNull()
    if rules.end_date:
        in_period &= F.col("date") <= F.lit(rules.end_date).cast("date")
    typed = dated.where(in_period).select(
        "site", "date", "researcher", *[S.safe_double(f"`{s}`").alias(s) for s in kept]
    )
    return to_long(typed, ["site", "date", "researcher"], kept, "species", "count")


def merge_observers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per survey and species: rounded-up mean of the rounded-up counts, number of
    rows, of named observers, and their sorted names.

    The list of names is itself the result, so the collected set is as small as its cell.
    """
    names = F.sort_array(F.collect_set("researcher"))
    return rows.groupBy(*keys).agg(
        F.ceil(F.avg(S.up_count("count").cast("double"))).alias("count"),
        F.count(F.lit(1)).alias("n_observer_rows"),
        F.size(names).cast("bigint").alias("n_observers"),
        F.nullif(F.concat_ws("; ", names), F.lit("")).alias("researchers"),
    )


def date_scale(rows: DataFrame, date: str = "date", weight: str | None = None) -> DataFrame:
    """One row: first date, mean and n-1 standard deviation of days since it.

    Every observation row counts, once or ``weight`` times. Rows are counted per date first,
    so one narrow pass over the data is followed by sums over a calendar.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    days = rows.where(F.col(date).isNotNull()).groupBy(date).agg(count.cast("double").alias("n"))
    d = F.datediff(F.col(date), F.to_date(F.lit("1970-01-01"))).cast("double")
    n, w = F.sum("n"), F.col("n")
    sums = days.agg(
        F.min(date).alias("first_date"), F.min(d).alias("d0"), n.alias("n"), F.sum(w * d).alias("s"), F.sum(w * d * d).alias("ss")
    )
    square = F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    return sums.select(
        "first_date",
        (F.col("s") / F.col("n") - F.col("d0")).alias("date_mean"),
        F.sqrt(F.try_divide(square, F.col("n") - 1)).alias("date_sd"),
    )


def add_time_index(df: DataFrame, scale: DataFrame, anchor: str) -> DataFrame:
    """Days since the first date, their z-score, and months since ``anchor``."""
    with_scale = attach_scalars(df, scale)
    number = F.datediff("date", "first_date")
    return with_scale.withColumns(
        {
            "date_num": number,
            "date_s": F.try_divide(number - F.col("date_mean"), F.col("date_sd")),
            "t_since": S.months_since("date", anchor),
        }
    ).drop("first_date", "date_mean", "date_sd")


def clean_counts(
    observations: DataFrame, guilds: DataFrame, sites: DataFrame, deployments: DataFrame, rules: CountRules
) -> DataFrame:
    """Observation rows (site, date, researcher, species, count) to the tidy count table.

    ``guilds(species, guild)``, ``sites(site, type, pair)``, ``deployments(pair,
    deployment_date)``. Columns that follow from site and date are added after the
    observers are merged, on the smaller table. The z-score still weights every row.
    """
    kept = observations.where(~S.in_list("species", rules.exclude_species))
    placed = kept.join(sites.where(F.col("pair").isNotNull()), "site", "inner")
    merged = merge_observers(placed, ["site", "pair", "type", "date", "species"])
    # Absent species are zero rows of their survey already, so guilds join after merging.
    labelled = merged.join(guilds, "species", "left").join(deployments, "pair", "left")
    timed = add_time_index(labelled, date_scale(merged, weight="n_observer_rows"), rules.anchor)
    if rules.guild_levels:
        timed = timed.withColumn("guild", S.as_level("guild", rules.guild_levels))
    return timed.select(
        "site", "pair", "type", S.period_flag("date", "deployment_date").alias("period"),
        "t_since", "date_num", "date", "date_s", S.survey_key("site", "date").alias("survey_id"),
        "researchers", "n_observer_rows", "n_observers", "species", "guild", "count",
    )


def assert_counts(df: DataFrame, count: str = "count", required: Sequence[str] = ("guild",)) -> DataFrame:
    """Fail the job that meets a missing, negative or fractional count or a missing label."""
    c = F.col(count)
    bad = c.isNull() | (c < 0) | (c != F.floor(c))
    for name in required:
        bad = bad | F.col(name).isNull()
    message = F.concat(F.lit("invalid row: "), F.to_json(F.struct(*df.columns)))
    return df.withColumn(count, F.when(bad, F.raise_error(message).cast(df.schema[count].dataType)).otherwise(c))


def guild_counts(tidy: DataFrame) -> DataFrame:
    keys = ["site", "pair", "type", "period", "t_since", "date_num", "date", "date_s", "survey_id", "guild"]
    return tidy.groupBy(*keys).agg(F.sum("count").alias("count"))


def survey_totals(guilds: DataFrame) -> DataFrame:
    keys = ["survey_id", "site", "pair", "type", "period", "date", "date_num", "date_s", "t_since"]
    return guilds.groupBy(*keys).agg(F.sum("count").alias("count"))


# --- sizes -----------------------------------------------------------------------------


@dataclass(frozen=True)
class SizeRules:
    """Choices of the size cleaning that belong to a data set.

    ``bins``: (column, label, lower, upper); ``caps``: bin columns to empty per species;
    ``legacy``: the old bin and the two it covers.
    """

    bins: Sequence[tuple[str, str, float, float]]
    legacy: tuple[str, str, str] | None = None
    caps: Mapping[str, Sequence[str]] = field(default_factory=dict)
    site_aliases: Mapping[str, str] = field(default_factory=dict)
    sci_aliases: Mapping[str, str] = field(default_factory=dict)
    date_floor: str = "1900-01-01"
    repair_to: int = 2000
    carried: Sequence[str] = ()


def size_records(raw: DataFrame, rules: SizeRules, blank_is_null: bool = False) -> DataFrame:
    """Typed, repaired and visibility-filtered records; site and lookup columns untouched.

    ``raw`` has site, date_text, visibility, species, sci_name and bin columns as text.
    """
    compiled_steps(raw.sparkSession)
    visibility = S.visibility_text("visibility") if blank_is_null else F.trim("visibility")
    columns = [b[0] for b in rules.bins] + ([rules.legacy[0]] if rules.legacy else [])
    present = [c for c in columns if c in raw.columns]
    date = S.repair_year("__date", rules.date_floor, rules.repair_to)
    kept = raw.withColumn("visibility", visibility).where(S.visibility_kept("visibility"))
    return kept.withColumn("__date", S.parse_date("date_text")).select(
        S.recode("site", rules.site_aliases).alias("site"),
        date.alias("date"),
        S.parse_number("visibility").alias("visibility_m"),
        "species",
        S.recode("sci_name", rules.sci_aliases).alias("sci_name"),
        *[S.safe_int(c).alias(c) for c in present],
        *rules.carried,
    )


def legacy_rates(df: DataFrame, parts: tuple[str, str], by: str) -> tuple[DataFrame, Column]:
    """Share of the first part among later, fully binned records: by group, and overall as a
    scalar subquery over the same group sums."""
    a, b = (F.col(p) for p in parts)
    base = df.where(a.isNotNull() & b.isNotNull() & (a + b > 0))
    sums = base.groupBy(by).agg(F.sum(a).alias("__first"), F.sum(a + b).alias("__both"))
    overall = sums.agg((F.sum("__first") / F.sum("__both")).alias("p")).select("p").scalar()
    return sums.select(by, (F.col("__first") / F.col("__both")).alias("p_first")), overall


def split_legacy_bin(df: DataFrame, old: str, parts: tuple[str, str], by: str) -> DataFrame:
    """Divide a legacy bin into its two parts where either of them is missing.

    Both parts are overwritten there. Rates come from the group, else from all records.
    A job that meets a legacy count without any later record fails, because the fish of the
    old bin would be lost.
    """
    if old not in df.columns:
        return df
    for part in parts:
        if part not in df.columns:
            df = df.withColumn(part, F.lit(None).cast("int"))
    df = stored(df)  # read three times: rates by group, the overall rate, the rows
    by_group, p_overall = legacy_rates(df, parts, by)
    needed = F.col(old).isNotNull() & (F.col(parts[0]).isNull() | F.col(parts[1]).isNull())
    lost = F.raise_error(F.lit(f"no record with both {parts}: {old} cannot be split")).cast("double")
    first, second = S.split_count(old, F.coalesce(F.col("p_first"), p_overall, F.when(F.col(old).isNotNull(), lost)))
    joined = df.join(by_group, by, "left")
    return joined.select(
        *[c for c in df.columns if c not in (old, *parts)],
        F.col(old).alias(f"{old}_orig"),
        F.when(needed, first.cast("int")).otherwise(F.col(parts[0])).alias(parts[0]),
        F.when(needed, second.cast("int")).otherwise(F.col(parts[1])).alias(parts[1]),
    )


def cap_bins(df: DataFrame, caps: Mapping[str, Sequence[str]]) -> DataFrame:
    """Empty the bins a species cannot reach."""
    by_bin: dict[str, list[str]] = {}
    for species, bins in caps.items():
        for b in bins:
            by_bin.setdefault(b, []).append(species)
    return df.withColumns({b: S.null_where(b, F.col("species").isin(s)) for b, s in by_bin.items()})


def bins_long(df: DataFrame, bins: Sequence[tuple[str, str, float, float]], keep_zero: bool = True) -> DataFrame:
    """One row per record and bin with the bin's label and edges, missing count zero."""
    present = [b for b in bins if b[0] in df.columns]
    ids = [c for c in df.columns if c not in {b[0] for b in bins}]
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("size_bin"), F.lit(label).alias("size_class"),
                F.lit(float(low)).alias("lower"), F.lit(float(high)).alias("upper"),
                F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("count"),
            )
            for name, label, low, high in present
        ]
    )
    if not keep_zero:
        cells = F.filter(cells, lambda c: c.getField("count") > 0)
    return df.select(*ids, F.inline(cells))


def life_stages(long: DataFrame, maturity: DataFrame) -> DataFrame:
    """Split every bin count into juveniles and adults by the species' maturity length.

    A species without maturity length yields no rows; see ``life_stage_rejects``.
    """
    share = S.p_below("lower", "upper", "lmat")
    joined = long.join(maturity, "sci_name", "left").withColumn("p_juv", share)
    young, old = S.split_count("count", "p_juv")
    stages = F.array(
        F.struct(F.lit(LIFE_STAGES[0]).alias("life_stage"), young.alias("stage_count")),
        F.struct(F.lit(LIFE_STAGES[1]).alias("life_stage"), old.alias("stage_count")),
    )
    present = F.filter(stages, lambda s: s.getField("stage_count") > 0)
    return joined.withColumn("p_adult", 1 - F.col("p_juv")).select("*", F.inline(present))


def life_stage_rejects(long: DataFrame, maturity: DataFrame) -> DataFrame:
    """Species dropped for want of a maturity length, with the counts lost."""
    known = maturity.where(F.col("lmat").isNotNull())
    lost = long.where(F.col("count") > 0).join(known, "sci_name", "left_anti")
    return lost.groupBy("species", "sci_name").agg(F.sum("count").alias("lost_count"))


def binned_records(records: DataFrame, sites: DataFrame, guilds: DataFrame, rules: SizeRules) -> DataFrame:
    """Site-matched records with the legacy bin divided, caps applied and guild attached."""
    placed = records.join(sites.where(F.col("pair").isNotNull()), "site", "inner")
    if rules.legacy:
        old, first, second = rules.legacy
        placed = split_legacy_bin(placed, old, (first, second), "species")
    return cap_bins(placed, rules.caps).join(guilds, "species", "left")


def clean_sizes(
    records: DataFrame, sites: DataFrame, guilds: DataFrame, maturity: DataFrame, rules: SizeRules
) -> DataFrame:
    """Typed records to life-stage rows. Empty bins are left out before the stage split,
    since a stage count above zero needs a bin count above zero.

    Records are dealt by survey first: a stored table is so compact that a task would read more of them than
    it can hold groups of their many stage rows."""
    binned = binned_records(records, sites, guilds, rules).repartition("site", "date")
    long = bins_long(binned, rules.bins, keep_zero=False)
    staged = life_stages(long, maturity)
    return staged.select(
        "site", "pair", "type", "date", S.survey_key("site", "date").alias("survey_id"),
        "species", "sci_name", "guild", "size_class", "lower", "upper", "count", "lmat",
        "p_juv", "p_adult", "life_stage", "stage_count", "visibility_m", *rules.carried,
    )


def stage_frame(
    stages: DataFrame,
    species: Sequence,
    frame: DataFrame | None = None,
    extra: Sequence[str] = (),
    levels: Sequence[str] = LIFE_STAGES,
) -> DataFrame:
    """Zero-filled survey × species × life stage counts.

    ``frame`` defaults to the surveys that have at least one staged row, so a survey
    without any is absent unless the caller passes the full list.
    """
    from surveyframe.operators.reshape import complete

    ids = ["survey_id", "site", "pair", "type", "date"]
    category = ["species", *extra, "life_stage"]
    cells = stages.groupBy(*ids, *category).agg(F.sum("stage_count").alias("stage_count"))
    if frame is None:
        frame = stages.select(*ids).distinct()
    rows = [(*(s if isinstance(s, tuple) else (s,)), level) for s in species for level in levels]
    wanted = [r[0] for r in rows]
    cells = cells.where(F.col("species").isin(sorted(set(wanted))))
    return complete(cells, ids, rows, category, "stage_count", frame)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
