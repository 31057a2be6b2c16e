import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyframe.operators import checks, effort, explore, joins, ordering, reshape
from surveyframe.operators.diversity import diversity
from surveyframe.operators.keys import assert_unique, level_values
from surveyframe.plans import clean
from surveyframe.session import literal_frame, stored
from surveyframe.sources import tables

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.floats(-1e6, 1e6), st.integers(-3, 3).map(float))), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    got = ordering.exact_quantiles(frame(spark, rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).toPandas().set_index("k")
    for k in {r[0] for r in rows}:
        want = np.quantile([v for g, v in rows if g == k], [0.25, 0.5, 0.75])
        assert got.loc[k, ["q1", "q2", "q3"]].to_numpy(float) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_quantiles_with_weights_null_key_and_hot_group(spark):
    rows = [("hot", float(i % 997)) for i in range(3000)] + [(None, 1.0), (None, 2.0)]
    got = {r["k"]: r["m"] for r in ordering.exact_quantiles(frame(spark, rows, "k string, v double"), ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"hot": float(np.median([i % 997 for i in range(3000)])), None: 1.5}
    weighted = frame(spark, [("a", 1.0, 3), ("a", 5.0, 1)], "k string, v double, w int")
    assert ordering.exact_quantiles(weighted, ["k"], "v", {"m": 0.5}, "w").first()["m"] == 1.0


def test_ranks_and_running_max(spark):
    values = [0.5, -2.0, 0.5, 3.0, 0.0, 1e-9]
    got = {r["v"]: r["rank"] for r in ordering.average_ranks(frame(spark, [(v,) for v in values], "v double"), [], "v").collect()}
    assert got == pd.Series(values).rank().groupby(values).first().to_dict()
    top = ordering.running_max(frame(spark, [(1.0, 5.0), (2.0, 3.0), (9.0, 7.0)], "o double, v double"), [], "o", "v", "m")
    assert {r["o"]: r["m"] for r in top.collect()} == {1.0: 5.0, 2.0: 5.0, 9.0: 7.0}


@SLOW
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from(["A", "N"]), st.integers(0, 40)), min_size=1, max_size=40))
def test_nearest_dates_equal_brute_force(spark, rows):
    day0 = dt.date(2024, 1, 1)
    df = frame(spark, [(p, t, day0 + dt.timedelta(d)) for p, t, d in rows], "pair string, type string, date date")
    got = sorted((r[0], r[1], r[2], r[3]) for r in joins.nearest_dates(df, ["pair"], "type", "date", ("A", "N")).collect())
    want = []
    for p, t, d in rows:
        others = [e for q, u, e in rows if q == p and u != t]
        if others:
            want.append((p, t, day0 + dt.timedelta(d), min(abs(d - e) for e in others)))
    assert got == sorted(want)


def test_holdout_numbers_only_the_split_date(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [("s", f"k{i}", day(1 if i < 3 else 2)) for i in range(10)]
    got = {r["survey"]: r["test"] for r in joins.time_holdout(frame(spark, rows, "site string, survey string, date date"), "site", "date", "survey").collect()}
    assert [k for k in sorted(got) if got[k]] == ["k8", "k9"]


def test_complete_and_missing_agree(spark):
    cells = frame(spark, [("s1", "a", 4), ("s2", "b", 1)], "sid string, sp string, n int")
    surveys = frame(spark, [("s1",), ("s2",), ("s3",)], "sid string")
    got = {(r[0], r[1]): r[2] for r in reshape.complete(cells, ["sid"], ["a", "b"], ["sp"], "n", surveys).collect()}
    assert got == {("s1", "a"): 4, ("s1", "b"): 0, ("s2", "a"): 0, ("s2", "b"): 1, ("s3", "a"): 0, ("s3", "b"): 0}
    assert {tuple(r) for r in reshape.missing_cells(cells, ["sid"], "sp", ["a", "b"]).collect()} == {("s1", "b"), ("s2", "a")}


def test_result_does_not_depend_on_partitions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.random(), rnd.randint(0, 5)) for _ in range(300)]
    outs = []
    for parts in (1, 2, 7):
        df = frame(spark, rows, "k string, v double, c int", parts)
        outs.append([round(x, 9) for r in explore.count_distribution(df, ["k"], "c").orderBy("k").collect() for x in r[1:] if x is not None])
    assert outs[0] == outs[1] == outs[2]


def test_correlation_without_variance_is_null(spark):
    df = frame(spark, [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "pair string, x double, y double")
    got = {r["pair"]: r["c"] for r in explore.collinearity(df, ["pair"], "x", {"c": F.col("y")}).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_brown_forsythe_guards_and_value(spark):
    lonely = frame(spark, [("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, y double")
    assert explore.brown_forsythe(lonely, ["g"], "y").first()["f_value"] is None
    rows = [("a", v) for v in (1.0, 2.0, 4.0, 9.0)] + [("b", v) for v in (1.0, 1.5, 2.0)]
    r = explore.brown_forsythe(frame(spark, rows, "g string, y double"), ["g"], "y").first()
    a, b = np.abs(np.array([1, 2, 4, 9]) - 3.0), np.abs(np.array([1, 1.5, 2]) - 1.5)
    grand = np.concatenate([a, b]).mean()
    between = 4 * (a.mean() - grand) ** 2 + 3 * (b.mean() - grand) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert r["f_value"] == pytest.approx(between / (within / 5)) and 0 < r["p_value"] < 1


def test_temporal_support_counts_shared_dates(spark):
    day = lambda d: dt.date(2024, 1, d)
    df = frame(spark, [("a", day(1)), ("a", day(1)), ("a", day(4)), ("b", day(2))], "g string, date date")
    got = {r["g"]: r for r in explore.temporal_support(df, ["g"]).collect()}
    assert (got["a"]["median_gap_days"], got["a"]["maximum_gap_days"]) == (1.5, 3)
    assert got["b"]["median_gap_days"] is None


def test_shannon_limits(spark):
    df = frame(spark, [("s1", "a", 5), ("s1", "b", 5), ("s2", "a", 7), ("s3", "a", 0)], "sid string, sp string, count int")
    got = {r["sid"]: r for r in diversity(df, ["sid"]).collect()}
    assert got["s1"]["shannon"] == pytest.approx(np.log(2)) and got["s2"]["shannon"] == pytest.approx(0)
    assert got["s3"]["shannon"] == 0.0 and got["s3"]["richness"] == 0


def test_checks_flag_what_is_wrong(spark):
    tidy = frame(spark, [("s", "a", None, 1.5), ("s", "a", "g", 2.0)], "survey_id string, species string, guild string, count double")
    assert checks.missing_guilds(tidy).count() == 1 and checks.invalid_counts(tidy).count() == 1
    row = checks.verdict(checks.duplicate_cells(tidy), "d", "fine", "bad").first()
    assert (row["ok"], row["n_bad"], row["message"]) == (False, 1, "1 bad")
    with pytest.raises(Exception, match="invalid row"):
        clean.assert_counts(tidy).collect()


def test_lookup_keys_and_levels_are_checked(spark):
    with pytest.raises(ValueError, match="duplicate"):
        assert_unique(frame(spark, [("a", 1), ("a", 2)], "k string, v int"), ["k"])
    with pytest.raises(ValueError, match="more than"):
        level_values(spark.range(5).withColumn("c", F.col("id").cast("string")), "c", 3)


def test_stored_is_one_path_for_every_size(spark):
    for n in (0, 10, 100_000):
        kept = stored(spark.range(n))
        assert kept.count() == n and "parquet" in kept._jdf.queryExecution().executedPlan().toString().lower()


def test_effort_by_type_fills_zero(spark):
    df = frame(spark, [("2024", "N"), ("2024", "N")], "year string, type string")
    assert effort.effort_by_type(df, ["year"], ["N", "A"]).first().asDict() == {"year": "2024", "N": 2, "A": 0}


# --- cleaning ---------------------------------------------------------------------------------


def test_csv_to_clean_counts(spark, tmp_path):
    path = tmp_path / "counts.csv"
    path.write_text(
        "Date,Site,Type,Researcher,Ray,Wrasse-1,Empty.Col\n"
        " 1/2/2024 , North ,x,Ann,3,1.2,\n"
        "1/2/2024,North,x,Bob,9,,\n"
        "bad,North,x,Bob,9,4,\n"
        ",,,,,,\n"
        "1/5/2030,North,x,Bob,9,4,\n"
        "1/9/2024,Nowhere,x,Bob,9,4,\n"
        "1/9/2024,Old South,x,,9,junk,\n"
    )
    raw = tables.read_wide_csv(spark, str(path), {"Date": "date", "Site": "site", "Type": "type", "Researcher": "researcher"})
    raw = tables.drop_empty(raw)
    assert "Empty.Col" not in raw.columns and raw.count() == 6
    rules = clean.CountRules(["Ray", "Wrasse-1", "Absent"], anchor="2024-01-01", end_date="2025-01-01", exclude_species=["Ray"], site_aliases={"Old South": "South"})
    sites = tables.lookup(spark, [("North", "N", "p"), ("South", "A", "p")], "site string, type string, pair string", ["site"])
    guilds = tables.lookup(spark, [("Wrasse-1", "g")], "species string, guild string", ["species"])
    deploy = tables.lookup(spark, [("p", dt.date(2024, 1, 5))], "pair string, deployment_date date", ["pair"])
    rows = clean.clean_counts(clean.count_observations(raw, rules), guilds, sites, deploy, rules).orderBy("site").collect()
    north, south = rows
    assert (north["count"], north["n_observer_rows"], north["researchers"], north["period"]) == (1, 2, "Ann; Bob", "Pre")
    assert (south["count"], south["researchers"], south["n_observers"], south["date_num"]) == (0, None, 0, 7)
    assert north["survey_id"] == "North_2024-01-02"
    mean, sd = np.mean([0, 0, 7]), np.std([0, 0, 7], ddof=1)
    assert south["date_s"] == pytest.approx((7 - mean) / sd)


def test_header_aliases_only_where_present(spark):
    df = spark.createDataFrame([("1", "2")], "`X0.1` string, keep string")
    assert tables.rename_aliases(df, {"X0.1": "bin_0_1", "X.1.2": "bin_1_2"}).columns == ["bin_0_1", "keep"]
    with pytest.raises(ValueError):
        tables.rename_aliases(spark.createDataFrame([("1", "2")], "a string, b string"), {"a": "c", "b": "c"})


def test_legacy_bin_halves_fallback_and_missing_rates(spark):
    rows = [("a", 1, 1, None), ("a", None, None, 5), ("a", None, None, 7), ("b", 4, None, 3), ("b", None, None, None)]
    df = frame(spark, rows, "species string, lo int, hi int, old int")
    got = sorted(((r["species"], r["old_orig"], r["lo"], r["hi"]) for r in clean.split_legacy_bin(df, "old", ("lo", "hi"), "species").collect()), key=str)
    assert got == sorted([("a", None, 1, 1), ("a", 5, 2, 3), ("a", 7, 4, 3), ("b", 3, 2, 1), ("b", None, None, None)], key=str)
    with pytest.raises(Exception, match="cannot be split"):  # the job fails, building the plan runs none
        clean.split_legacy_bin(df.where("old is not null"), "old", ("lo", "hi"), "species").collect()
    assert clean.split_legacy_bin(df.drop("old"), "old", ("lo", "hi"), "species").columns == ["species", "lo", "hi"]


def test_sizes_to_life_stages(spark):
    raw = spark.createDataFrame(
        [("s", "3/1/2024", "<3", "x", "X x", "5", "5"), ("s", "3/1/2024", None, "x", "X old", "5", "4"), ("s", "3/1/24", "9", "y", "Y", "1", "1")],
        "site string, date_text string, visibility string, species string, sci_name string, small string, big string")
    rules = clean.SizeRules(bins=[("small", "0-10", 0, 10), ("big", "10+", 10, float("inf"))], caps={"y": ["big"]}, sci_aliases={"X old": "X x"}, date_floor="2024-01-01", repair_to=2025)
    sites = literal_frame(spark, [("s", "N", "p")], "site string, type string, pair string")
    guilds = literal_frame(spark, [("x", "g"), ("y", "g")], "species string, guild string")
    maturity = literal_frame(spark, [("X x", 5.0)], "sci_name string, lmat double")
    records = clean.size_records(raw, rules, blank_is_null=True)
    assert {(r["species"], r["date"]) for r in records.collect()} == {("x", dt.date(2024, 3, 1)), ("y", dt.date(2025, 3, 1))}
    got = sorted((r["size_class"], r["life_stage"], r["stage_count"]) for r in clean.clean_sizes(records, sites, guilds, maturity, rules).collect())
    assert got == [("0-10", "adult", 3), ("0-10", "juvenile", 2), ("10+", "adult", 4)]
    long = clean.bins_long(clean.binned_records(records, sites, guilds, rules), rules.bins)
    assert [tuple(r) for r in clean.life_stage_rejects(long, maturity).collect()] == [("y", "Y", 1)]


def test_tables_are_written_with_their_date(spark, tmp_path):
    df = spark.range(3).withColumn("k", F.lit("a"))
    path = tables.write_table(df, str(tmp_path), "counts", "2024.01.01", ["k"])
    assert spark.read.parquet(path).count() == 3
    paths = tables.write_tables({"one": df}, str(tmp_path), "2024.01.01")
    assert spark.read.csv(paths["one"], header=True).count() == 3


def test_first_per_group_puts_null_last(spark):
    rows = [("a", None, 1), ("a", 5, 2), ("a", 3, 3), ("b", None, 4)]
    found = joins.first_per_group(spark.createDataFrame(rows, "g string, d int, k int"), ["g"], ["d"], ["k"])
    assert {r["g"]: r["k"] for r in found.collect()} == {"a": 3, "b": 4}


def test_ranges_follow_the_data(spark):
    """Values of one narrow octave still fall into several ranges of similar size."""
    df = spark.range(20_000).select((F.lit(1.7e9) + F.col("id") / 100).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be merged
    try:
        counts = ordering.value_counts(df, [], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in counts.groupBy("__bucket").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ordering.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(1.7e9 + 99.995)


def test_weak_cells_see_absent_combinations(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "y")] * 2, "f string, g string")
    found = explore.weak_cells(df, ["f", "g"], complete=True)
    assert {(r["f"], r["g"]): r["n"] for r in found.collect()} == {("b", "y"): 2, ("a", "y"): 0, ("b", "x"): 0}
