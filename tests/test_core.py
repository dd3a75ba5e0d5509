"""Golden and invariant tests for rollups, features, scoring and pricing."""
import math


from riskframe.functions.expr import clamp
from riskframe.operators.features import engineer_features
from riskframe.operators.pricing import adjust_premium, roi_grid
from riskframe.operators.scoring import risk_band, score_hrs


def test_clamp_preserves_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (50.0,)], "x double")
    got = [r[0] for r in df.select(clamp("x", 10.0, 20.0)).collect()]
    assert got == [None, 10.0, 20.0]


def _three_rows(spark):
    rows = [
        # healthy, medium, sick
        ("E1", "C1", 30, "M", 22.0, 0, 0, 0, 0, 11000.0, 300.0, 60.0, 0.0, 60.0, 7.5, 98.0, 0, 0, 0.2),
        ("E2", "C1", 45, "F", 28.0, 1, 0, 0, 1, 6000.0, 800.0, 72.0, 0.5, 30.0, 6.5, 96.0, 2, 0, 0.9),
        ("E3", "C1", 60, "M", 35.0, 1, 1, 1, 2, 2500.0, 1500.0, 88.0, 2.0, 10.0, 5.0, 93.0, 6, 2, 2.5),
    ]
    schema = ("employee_key string, company_id string, age int, gender string, bmi double, smoker int, "
              "diabetic int, hypertension int, chronic_count int, avg_daily_steps double, step_volatility double, "
              "avg_resting_hr double, hr_trend double, avg_active_mins double, avg_sleep_hours double, "
              "avg_spo2 double, visit_count int, hospitalized_count int, loss_ratio double")
    return spark.createDataFrame(rows, schema)


def test_engineered_columns(spark):
    f = {r.employee_key: r for r in engineer_features(_three_rows(spark)).collect()}
    assert f["E1"].activity_score > f["E2"].activity_score > f["E3"].activity_score
    assert f["E3"].health_composite > f["E1"].health_composite
    assert f["E3"].smoker_diabetic == 1 and f["E2"].smoker_diabetic == 0
    assert math.isclose(f["E2"].bmi_age_risk, (28 / 25) * (45 / 40))
    assert f["E3"].clinical_burden == 6 * 3
    assert f["E1"].lab_domain_count == 0 and f["E1"].lab_risk_score == 0.0
    assert math.isclose(f["E2"].loss_ratio_log, math.log1p(0.9))
    assert f["E1"].gender_male == 1 and f["E2"].gender_male == 0


def test_hrs_cap_floor_and_degenerate(spark):
    df = spark.createDataFrame([(-5.0,), (0.5,), (9.0,)], "log_pred double")
    sc = spark.createDataFrame([(0.0, 1.0)], "p05 double, p95 double")
    got = [r.hrs for r in score_hrs(df, sc).orderBy("log_pred").collect()]
    assert got == [0.0, 50.0, 100.0]
    deg = spark.createDataFrame([(0.3, 0.3)], "p05 double, p95 double")
    assert {r.hrs for r in score_hrs(df, deg).collect()} == {50.0}


def test_band_edges(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (59.9,), (60.0,), (79.9,), (80.0,)], "h double")
    got = [r[0] for r in df.select(risk_band("h")).collect()]
    assert got == ["Low", "Moderate", "Moderate", "High", "High", "Critical"]


def test_premium_zones(spark):
    df = spark.createDataFrame([(100000.0, 0.0), (100000.0, 50.0), (100000.0, 100.0)], "base_premium double, hrs double")
    r = adjust_premium(df).orderBy("hrs").collect()
    assert (r[0].zone, r[0].adjusted_premium, r[0].adjustment_pct) == ("discount", 85000.0, -15.0)
    assert (r[1].zone, r[1].adjusted_premium, r[1].adjustment_pct) == ("standard", 100000.0, 0.0)
    assert (r[2].zone, r[2].adjusted_premium, r[2].adjustment_pct) == ("loading", 130000.0, 30.0)


def test_roi_grid_monotone(spark):
    df = spark.createDataFrame([("C1", 100000.0, 75.0)], "company_id string, base_premium double, hrs double")
    g = roi_grid(df).orderBy("improvement").collect()
    assert g[0].annual_savings == 0.0
    s = [r.annual_savings for r in g]
    assert all(b >= a for a, b in zip(s, s[1:]))
    assert len(g) == 41
