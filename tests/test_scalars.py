import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from surveyframe.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def column_of(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def mapped(spark, values, fn, kind="string"):
    return [r[0] for r in column_of(spark, values, kind).select(fn("v").alias("out")).collect()]


def test_safe_double_keeps_only_plain_numbers(spark):
    assert mapped(spark, ["3", " 2.5 ", "x", "", None, "1e2", "4d", "NaN", "-.5"], S.safe_double) == [3.0, 2.5, None, None, None, 100.0, None, None, -0.5]


def test_safe_int_cuts_decimals_and_nulls_tokens(spark):
    assert mapped(spark, ["3.7", "-3.7", "NA", "n/a", " ", "99999999999", "12"], S.safe_int) == [3, -3, None, None, None, None, 12]
    assert mapped(spark, ["-99", "5"], lambda c: S.safe_int(c, ["-99"])) == [None, 5]


def test_dates_with_short_years_trailing_text_and_junk(spark):
    got = mapped(spark, ["7/3/2023", "07/03/2023 10:15", "2/30/2024", "x", None, "07/03/23"], S.parse_date)
    assert got == [dt.date(2023, 7, 3), dt.date(2023, 7, 3), None, None, None, dt.date(23, 7, 3)]


def test_short_year_is_repaired_and_leap_day_is_lost(spark):
    fix = lambda c: S.repair_year(S.parse_date(c), "2024-01-01", 2025)
    assert mapped(spark, ["07/03/23", "07/03/24", "3/1/2024", "02/29/20"], fix) == [
        dt.date(2025, 7, 3), dt.date(2025, 7, 3), dt.date(2024, 3, 1), None]


def test_visibility_blank_is_kept_and_missing_is_dropped(spark):
    values = ["<3", "< 3 m", "2.5", "3", "10 m", "unknown", "", None]
    assert mapped(spark, values, S.visibility_kept) == [False, False, False, True, True, True, True, False]
    scanned = lambda c: S.visibility_kept(S.visibility_text(c))
    assert mapped(spark, [None, "NA", "5"], scanned) == [True, False, True]


def test_parse_number_takes_first_number(spark):
    assert mapped(spark, ["1,234.5 m", "about -7", "none", "5-10"], S.parse_number) == [1234.5, -7.0, None, 5.0]


def test_recode_and_membership_never_lose_rows(spark):
    assert mapped(spark, ["a", "b", None], lambda c: S.recode(c, {"a": "z"})) == ["z", "b", None]
    assert mapped(spark, ["a", "b", None], lambda c: S.in_list(c, ["a"])) == [True, False, False]


def test_split_rounds_half_to_even_and_adds_up(spark):
    rows = spark.createDataFrame([(5, 0.5), (7, 0.5), (3, 0.5), (10, 0.333)], "n int, p double")
    young, old = S.split_count("n", "p")
    got = [(r[0], r[1]) for r in rows.select(young, old).collect()]
    assert got == [(2, 3), (4, 3), (2, 1), (3, 7)]


def test_p_below_order_and_open_bin(spark):
    rows = spark.createDataFrame(
        [(0.0, 5.0, 5.0), (5.0, 10.0, 5.0), (5.0, 10.0, 8.0), (100.0, math.inf, 50.0), (100.0, math.inf, 120.0), (0.0, 5.0, None)],
        "lo double, hi double, cut double")
    assert [r[0] for r in rows.select(S.p_below("lo", "hi", "cut")).collect()] == [1.0, 0.0, 0.6, 0.0, 0.0, None]


def test_months_use_the_length_of_the_month(spark):
    day = lambda t: F.lit(t).cast("date")
    assert one(spark, S.months_since(day("2024-02-15"), "2023-09-01")) == pytest.approx(5 + 14 / 29)
    assert one(spark, S.months_since(day("2023-08-01"), "2023-09-01")) == 0.0
    assert one(spark, S.months_since(day("2023-10-14"), "2023-09-15")) == pytest.approx(29 / 30)
    assert one(spark, S.months_since(F.lit(None).cast("date"), "2023-09-01")) is None


def test_survey_key_keeps_missing_parts(spark):
    assert one(spark, S.survey_key(F.lit("a"), F.lit(None).cast("date"))) == "a_NA"


def test_signif_and_p_text(spark):
    assert mapped(spark, [0.012345, 1234.5, -0.00098765, 0.0], S.signif, "double") == pytest.approx([0.0123, 1230.0, -0.000988, 0.0])
    assert mapped(spark, [0.0004, 0.04567, None], S.format_p, "double") == ["<0.001", "0.046", None]


def test_labels(spark):
    rows = spark.createDataFrame([(1.0, 0.01), (-1.0, 0.01), (1.0, 0.5), (1.0, None)], "e double, p double")
    got = [(r[0], r[1]) for r in rows.select(S.trajectory_label("e", "p"), S.significance_label("p")).collect()]
    assert got == [("increase", "Significant"), ("decrease", "Significant"), ("no significant change", "Non-significant"), ("no significant change", None)]


def test_ratio_inverse_swaps_bounds(spark):
    r = spark.range(1).select(*S.invert_ratio(F.lit(2.0), F.lit(1.0), F.lit(4.0))).first()
    assert tuple(r) == (0.5, 0.25, 1.0)


def test_period_levels_and_guards(spark):
    day = lambda t: F.lit(t).cast("date")
    assert one(spark, S.period_flag(day("2020-01-01"), F.lit(None).cast("date"))) == "Post"
    assert one(spark, S.period_flag(day("2020-01-01"), day("2020-01-02"))) == "Pre"
    assert one(spark, S.level_index(F.lit("b"), ["a", "b"])) == 2
    assert one(spark, S.level_index(F.lit("q"), ["a", "b"])) is None
    assert one(spark, S.safe_ratio(F.lit(1.0), F.lit(0.0))) is None


def test_plain_dates_and_integers_read_as_by_the_patterns(spark):
    import datetime

    from surveyframe.plans import clean

    dates = {"1/2/2023": (2023, 1, 2), "01/2/2023": (2023, 1, 2), "2/29/2024": (2024, 2, 29), "2/30/2023": None, "13/1/2023": None, "1/2/23": (23, 1, 2),
             "1/2/2023 10:00": (2023, 1, 2), "0/1/2023": None, "1/2": None, "": None}
    got = spark.createDataFrame([(k,) for k in dates], "t string").select("t", S.parse_date("t").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == {k: v and datetime.date(*v) for k, v in dates.items()}
    numbers = {"37": 37, "-5": -5, "+1": 1, "01": 1, "1.9": 1, "1e3": 1000, "\t1": None, "1d": None, "2147483648": None, "NA": None}
    got = spark.createDataFrame([(k,) for k in numbers], "t string").select("t", S.safe_int("t").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == numbers
    # Records are dealt by survey before their bins become rows.
    records = spark.createDataFrame([("s", datetime.date(2024, 1, 1), 5.0, "a", "a", 3)], "site string, date date, visibility_m double, species string, sci_name string, bin_1_2 int")
    frames = [spark.createDataFrame(r, s) for r, s in (([("s", "T", "p")], "site string, type string, pair string"), ([("a", "g")], "species string, guild string"), ([("a", 1.5)], "sci_name string, lmat double"))]
    staged = clean.clean_sizes(records, *frames, clean.SizeRules(bins=[("bin_1_2", "1-2", 1.0, 2.0)]))
    assert "RepartitionByExpression [site" in staged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["life_stage"], r["stage_count"]) for r in staged.collect()) == [("adult", 1), ("juvenile", 2)]
