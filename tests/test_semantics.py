"""One test per behaviour of SURVEY §1.4 that the other test files do not already pin down."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wellspark.operators import hrv, nutrition as nu, ppg, selecting as sel


def _totals(spark, **over):
    base = {n: 0.0 for n in nu.NUTRIENT_FIELDS}
    base.update(over)
    cols = ["log_id"] + list(base)
    return spark.createDataFrame([tuple([1] + [float(base[c]) for c in cols[1:]])], cols)


def test_q4_empty_selection_flagged(spark):
    """Requested keys without rows stay, flagged ``has_data = false``."""
    req = spark.createDataFrame([("par_1",), ("par_2",)], "user_id string")
    res = spark.createDataFrame([("par_1", 3.0)], "user_id string, steps double")
    out = {r.user_id: (r.has_data, r.steps) for r in sel.with_requested_keys(req, res, ["user_id"]).collect()}
    assert out == {"par_1": (True, 3.0), "par_2": (False, None)}


def test_q11_first_selected_zero_row_is_a_start(spark):
    """Q11: the first selected row counts as a run start when its hr is 0 (its previous row is missing)."""
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    hr = [0, 0, 70, 0, 71]
    df = spark.createDataFrame(
        [("u", t0 + dt.timedelta(seconds=i), i, float(h)) for i, h in enumerate(hr)],
        "user_id string, ts timestamp, i int, hr double",
    )
    m = ppg.mark_run_starts(df, ["user_id"], ["ts", "i"], F.col("hr") == 0).orderBy("i")
    assert [r.is_start for r in m.collect()] == [True, False, False, True, False]
    seg = ppg.last_segment(df, ["user_id"], ["ts", "i"], F.col("hr") == 0, closing_flag="closing")
    rows = seg.orderBy("i").collect()
    assert [r.i for r in rows] == [0, 1, 2, 3]
    assert [r.closing for r in rows] == [False, False, False, True]


def test_q12_fixed_chunks_last_short(spark):
    """Q12: chunks of N rows in order; the last chunk holds the remainder."""
    df = spark.range(0, 25).select(F.lit("u").alias("user_id"), F.col("id").alias("i"),
                                   F.timestamp_seconds(F.col("id")).alias("ts"))
    c = ppg.fixed_chunks(df, ["user_id"], ["ts", "i"], rows=10)
    sizes = sorted((r.chunk_id, r["count"]) for r in c.groupBy("chunk_id").count().collect())
    assert sizes == [(0, 10), (1, 10), (2, 5)]


def test_q13_pss_slot_holds_lf(spark):
    df = spark.createDataFrame([(1.5, 9.0)], "HRV_LF double, HRV_PSS double")
    assert hrv.overwrite_pss(df).first().HRV_PSS == 1.5
    assert hrv.overwrite_pss(df, strict_pss=True).first().HRV_PSS == 9.0


def test_q14_minmax_constant_or_single_chunk_is_null(spark):
    """Q14: (mean - min) / (max - min) across chunks; a constant feature or one chunk gives NULL;
    Heart_Rate is the plain mean of the rate."""
    df = spark.createDataFrame(
        [("a", 0, 1.0, 5.0, 60.0), ("a", 1, 3.0, 5.0, 70.0), ("a", 2, 2.0, 5.0, 80.0), ("b", 0, 4.0, 1.0, 90.0)],
        "user string, chunk int, f1 double, f2 double, PPG_Rate_Mean double",
    )
    out = {r.user: r for r in hrv.minmax_mean(df, ["user"], ["f1", "f2"]).collect()}
    assert out["a"].f1 == pytest.approx(0.5) and out["a"].f2 is None and out["a"].Heart_Rate == 70.0
    assert out["b"].f1 is None and out["b"].n_chunks == 1


def test_q16_thresholds_are_strict(spark):
    """Q16: a share exactly at a threshold is not a risk; just beyond it is."""
    # shares 0.45 / 0.2 / 0.1 / 0.2 exactly (900 kcal: 101.25 g carb, 20 g fat, 10 g saturated, 45 g protein)
    at = nu.risk_rules(_totals(spark, Calories=900.0, Total_Carbohydrate=101.25, Total_Fat=20.0,
                               Saturated_Fat=10.0, Protein=45.0, Sodium=2300.0, Sugars=25.0,
                               Dietary_Fiber=20.0)).first()
    assert (at.carb_share, at.fat_share, at.saturated_fat_share, at.protein_share) == (0.45, 0.2, 0.1, 0.2)
    assert not any([at.is_carb_risk, at.is_fat_risk, at.is_saturated_fat_risk, at.is_protein_risk,
                    at.is_sodium_risk, at.is_sugars_risk, at.is_fiber_risk])
    assert at.Sodium_Risk == nu.NO_RISK
    over = nu.risk_rules(_totals(spark, Calories=1000.0, Total_Carbohydrate=113.0, Total_Fat=10.0,
                                 Saturated_Fat=12.0, Protein=60.0, Sodium=2301.0, Sugars=25.5,
                                 Dietary_Fiber=36.0)).first()
    assert all([over.is_carb_risk, over.is_fat_risk, over.is_saturated_fat_risk, over.is_protein_risk,
                over.is_sodium_risk, over.is_sugars_risk, over.is_fiber_risk])


def test_q17_protein_message_prints_saturated_share(spark):
    """Q17: the reference's protein message shows the saturated-fat percent; ``corrected`` shows protein's.
    Q18: percents are truncated, not rounded."""
    t = _totals(spark, Calories=1000.0, Saturated_Fat=100 / 9 + 0.1, Protein=62.4)  # sat 10.9 %, protein 24.96 %
    ref = nu.risk_rules(t, messages="reference").first().Protein_Risk
    fixed = nu.risk_rules(t, messages="corrected").first().Protein_Risk
    assert "10%" in ref and "24%" in fixed and "25%" not in fixed


def test_q18_zero_calories_gives_null_not_error(spark):
    out = nu.risk_rules(_totals(spark, Calories=0.0, Total_Fat=3.0)).first()
    assert out.fat_share is None and out.is_fat_risk is None and out.Total_Fat_Risk is None
    assert out.Sodium_Risk == nu.NO_RISK  # absolute rules still apply


def test_q10_unknown_analysis_rejected(spark):
    from wellspark.operators import trends

    df = spark.createDataFrame([("u", dt.date(2024, 1, 1), 1.0)], "user_id string, date date, v double")
    with pytest.raises(ValueError):
        trends.summarise(df, ["user_id"], "median")
