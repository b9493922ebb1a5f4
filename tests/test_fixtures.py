"""Stated and derived expectations of the reference's tests and fixtures (FIXTURES.md), one case each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wellspark.functions.numeric import round2
from wellspark.operators import nutrition as nu
from wellspark.operators import ppg, selecting as sel, trends as tr


def _days(n, start=dt.date(2023, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_sleep_average_two_days(spark):
    df = spark.createDataFrame(
        [(1, d, float(a), float(b)) for d, a, b in zip(_days(2), (480, 500), (20, 15))],
        "uid int, date date, total_sleep_time double, awake_duration double",
    )
    out = tr.summarise(df, ["uid"], "average", allowed=tr.HOW_SLEEP).first()
    assert out["total_sleep_time"] == 490.0 and out["awake_duration"] == 17.5


def test_sleep_rejects_other_analysis(spark):
    df = spark.createDataFrame([(1, dt.date(2023, 1, 1), 1.0)], "uid int, date date, x double")
    with pytest.raises(ValueError):
        tr.summarise(df, ["uid"], "sum", allowed=tr.HOW_SLEEP)


def test_slopes_plus_minus_one(spark):
    rows = [(1, d, float(i + 1), float(5 - i)) for i, d in enumerate(_days(5))]
    df = spark.createDataFrame(rows, "uid int, date date, up double, down double")
    out = tr.summarise(df, ["uid"], "trend", digits=6).first()
    assert out["up"] == 1.0 and out["down"] == -1.0


def test_one_row_trend_is_null(spark):
    df = spark.createDataFrame([(1, dt.date(2023, 1, 1), 500.0, 360.0)], "uid int, date date, steps_count double, rest_time double")
    out = tr.summarise(df, ["uid"], "trend").first()
    assert out["steps_count"] is None and out["rest_time"] is None


def test_nan_makes_slope_null_but_sum_skips(spark):
    rows = [(1, d, v) for d, v in zip(_days(3), (1.0, float("nan"), 3.0))]
    df = spark.createDataFrame(rows, "uid int, date date, y double")
    assert tr.summarise(df, ["uid"], "trend").first()["y"] is None
    assert tr.summarise(df, ["uid"], "sum").first()["y"] == 4.0
    assert tr.summarise(df, ["uid"], "average").first()["y"] == 2.0
    all_nan = spark.createDataFrame([(1, dt.date(2023, 1, 1), float("nan"))], "uid int, date date, y double")
    assert tr.summarise(all_nan, ["uid"], "sum").first()["y"] == 0.0


def test_seconds_to_minutes(spark):
    df = spark.createDataFrame([(120.0, 300.0), (180.0, 600.0), (240.0, 900.0)], "a double, b double")
    out = sel.seconds_to_minutes(df, ["a", "b", "missing"]).collect()
    assert [(r.a, r.b) for r in out] == [(2.0, 5.0), (3.0, 10.0), (4.0, 15.0)]


def test_round_half_even_like_numpy(spark):
    df = spark.createDataFrame([(0.285,), (0.125,), (2.675,)], "x double")
    got = [r[0] for r in df.select(round2("x")).collect()]
    import numpy as np

    assert got == [float(np.round(v, 2)) for v in (0.285, 0.125, 2.675)]


def test_range_filter_includes_next_midnight(spark):
    df = spark.createDataFrame([(d,) for d in _days(5)], "date date")
    got = sel.select_range(df, "date", "2023-01-02", "2023-01-03").count()
    assert got == 3  # 2nd, 3rd and the day after end (reference behaviour)
    assert sel.select_range(df, "date", "2023-01-02", "2023-01-03", upper="exclusive").count() == 2
    assert sel.select_day(df, "date", "2023-01-02").count() == 1


FOODS = [
    # food, cal, fat, sat, chol, sodium, carb, fiber, sugars, protein, potassium, p
    ("cheeseburger", 535.31, 28.66, 14.0, 95.52, 1176.09, 39.24, 2.39, 7.16, 30.27, 443.77, 364.17),
    ("milk", 122.0, 4.83, 3.07, 19.52, 114.68, 11.71, 0.0, 12.35, 8.05, 341.6, 224.48),
    ("eggs", 143.0, 9.51, 3.13, 372.0, 142.0, 0.72, 0.0, 0.37, 12.56, 138.0, 198.0),
]
FIELDS = ["nf_calories", "nf_total_fat", "nf_saturated_fat", "nf_cholesterol", "nf_sodium", "nf_total_carbohydrate",
          "nf_dietary_fiber", "nf_sugars", "nf_protein", "nf_potassium", "nf_p"]


def _foods_df(spark):
    rows = [(1, f[0], *f[1:]) for f in FOODS]
    return spark.createDataFrame(rows, "log int, food_name string, " + ", ".join(f"{c} double" for c in FIELDS))


def test_nutrition_totals_and_risks(spark):
    totals = nu.food_totals(_foods_df(spark), ["log"])
    totals = totals.withColumns({n: round2(n) for n in nu.NUTRIENT_FIELDS})
    t = totals.first()
    assert (t.Calories, t.Total_Fat, t.Saturated_Fat, t.Cholesterol) == (800.31, 43.0, 20.2, 487.04)
    assert (t.Sodium, t.Total_Carbohydrate, t.Dietary_Fiber, t.Sugars) == (1432.77, 51.67, 2.39, 19.88)
    assert (t.Protein, t.Potassium, t.Phosphorus) == (50.88, 923.37, 786.65)
    r = nu.risk_rules(totals).first()
    assert r.Total_Carbohydrate_Risk == "No Risk"
    assert r.Total_Fat_Risk.startswith("The percentage of total fat of total energy intake is 48% ")
    assert r.Saturated_Fat_Risk.startswith("The percentage of total saturated fat of total energy intake is 22% ")
    assert "is 22%" in r.Protein_Risk  # reference prints the saturated-fat share here
    assert "is 25%" in nu.risk_rules(totals, messages="corrected").first().Protein_Risk
    assert (r.Sodium_Risk, r.Sugars_Risk) == ("No Risk", "No Risk")
    assert r.Dietary_Fiber_Risk == "The total consumed fiber is 2.39g which is outside the recommended values of 20g-35g"
    f = nu.format_totals(totals, suffix="_text").first()
    assert (f.Total_Fat_text, f.Cholesterol_text) == ("43.0g", "487.04mg")


def test_nested_equals_flat_and_defaults(spark):
    flat = _foods_df(spark)
    docs = flat.groupBy("log").agg(F.collect_list(F.struct(*FIELDS)).alias("foods"))
    nested = nu.nested_totals(docs).withColumn("Calories", round2("Calories")).first()
    assert nested.Calories == 800.31
    # null nutrient, absent nutrient, empty foods, zero calories
    schema = "log int, foods array<struct<nf_calories:double,nf_total_fat:double>>"
    df = spark.createDataFrame([(1, [(100.0, None)]), (2, []), (3, [(0.0, 5.0)])], schema)
    out = {r.log: r for r in nu.nested_totals(df).collect()}
    assert out[1].Total_Fat == 0.0 and out[1].Sodium == 0.0
    assert out[2].Calories == 0.0
    risks = {r.log: r for r in nu.risk_rules(nu.nested_totals(df).drop("foods")).collect()}
    assert risks[3].fat_share is None and risks[3].Total_Fat_Risk is None


def test_ppg_segment_between_last_two_starts(spark):
    hr = [0, 0, 70, 71, 0, 0, 72, 0, 73]
    base = dt.datetime(2020, 8, 1, 0, 0, 0)
    rows = [("par_5", base + dt.timedelta(milliseconds=50 * i), i, float(h)) for i, h in enumerate(hr)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, sample_no int, hr double")
    starts = ppg.mark_run_starts(df, ["user_id"], ["ts", "sample_no"], F.col("hr") == 0)
    assert sorted(r.sample_no for r in starts.where("is_start").collect()) == [0, 4, 7]
    seg = ppg.last_segment(df, ["user_id"], ["ts", "sample_no"], F.col("hr") == 0)
    assert sorted(r.sample_no for r in seg.collect()) == [4, 5, 6, 7]


def test_segment_needs_two_starts(spark):
    rows = [("u", dt.datetime(2020, 1, 1, 0, 0, i), i, 0.0 if i == 0 else 70.0) for i in range(5)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, sample_no int, hr double")
    assert ppg.last_segment(df, ["user_id"], ["ts", "sample_no"], F.col("hr") == 0).count() == 0
